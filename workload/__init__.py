"""The registered queries: each key has a Spark query and, where SQL can say it, an oracle text."""

import importlib

MODULES = ("rules", "relational", "quality", "profiles", "protection", "movement", "inout")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
