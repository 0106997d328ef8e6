"""Declarative data-pipeline, data-quality and replication operators on PySpark."""

__version__ = "0.1.0"
