"""Packing token sequences into windows of fixed size: best-fit decreasing.

Documents longer than a window are first cut into full windows. The rest of each document goes, longest first, into
the open window whose remaining capacity is the smallest that still fits; a segment tree over capacities finds it.
Documents are dealt at random into groups of about ``GROUP`` documents; each group is packed by one task.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.llm.frames import add_columns, ready, without, written
from millrace.llm.words import word_tokenizer

WINDOW = 2048
GROUP = 20_000  # documents per group: a group's last, unfilled windows are then a small share


class CapacityTree:
    """Open windows by remaining capacity: a segment tree that finds the smallest capacity of at least ``need``."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [0] * (2 * self.leaves)  # open windows below each node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = self.leaves + capacity
        while node:
            self.any[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest fit, or None."""
        node = self.leaves + need
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        sequence = self.open[capacity].pop()
        while node:
            self.any[node] -= 1
            node >>= 1
        return capacity, sequence


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset in it) of each length; lengths lie between 1 and ``window``."""
    tree, count = CapacityTree(window), 0
    sequences, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        found = tree.take(need) if need < window else None
        if found is None:
            capacity, sequence = window, count
            count += 1
        else:
            capacity, sequence = found
        sequences[i], offsets[i] = sequence, window - capacity
        if capacity > need:
            tree.add(capacity - need, sequence)
    return sequences, offsets


def token_pieces(df: DataFrame, vocabulary: str, text: str = "text", end_id: int = 1, window: int = WINDOW,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: full windows, then the rest.

    Adds ``start`` (the document's ids before the piece), ``length``, ``ids_crc32`` (of the piece's little-endian
    unsigned 32-bit ids), ``doc_tokens`` and, if asked, ``ids``. ``text`` is dropped. A null or empty text is the
    end id alone. Repeated rows are packed each on its own. Columns of these names are replaced.
    """
    fields = "start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def make():
        tokenizer, end = word_tokenizer(vocabulary), end_id.to_bytes(4, "little")

        def pieces(texts):
            cut, totals = [], []
            for value in texts:
                raw = tokenizer.encode(value) + end
                total = len(raw) // 4
                totals.append(total)
                own = []
                for begin in range(0, total, window):
                    part = raw[4 * begin:4 * (begin + window)]
                    piece = {"start": begin, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                    if with_ids:
                        piece["ids"] = part
                    own.append(piece)
                cut.append(own)
            return cut, totals

        return pieces

    cut = add_columns(df, [text], f"__pieces array<struct<{fields.replace(' long', ':long').replace(' binary', ':binary')}>>,"
                                  " doc_tokens long", make)
    names = [f.split()[0] for f in fields.split(", ")]
    rest = without(cut, [text, "__pieces", *names])
    return cut.select(*[f"`{c}`" for c in rest.columns], F.inline("__pieces"))


def pack(pieces: DataFrame, documents: int, length: str = "length", window: int = WINDOW,
         group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of pieces no longer than ``window``.

    ``documents`` (about how many documents there are) sets the number of groups. Only lengths go to the groups; the
    pieces, written once, are joined to their places, so ids of any size pass through no group. An empty table gives no rows. Pieces of equal length go in any order.
    """
    ready(pieces.sparkSession)
    groups = max(1, -(-documents // group))
    rows = written(without(pieces, ["sequence_id", "offset"]).withColumn("__piece", F.monotonically_increasing_id()), "pieces")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sequences, offsets = best_fit_decreasing(frame["need"].tolist(), window)
        first = int(frame["group"].iloc[0]) << 40
        return pd.DataFrame({"__piece": frame["piece"], "sequence_id": [first + s for s in sequences], "offset": offsets})

    dealt = rows.select(F.col("__piece").alias("piece"), F.col(f"`{length}`").alias("need"),
                        F.pmod(F.xxhash64("__piece"), F.lit(groups)).cast("int").alias("group"))
    placed = dealt.groupBy("group").applyInPandas(run, "__piece long, sequence_id long, offset long")
    return rows.join(placed, "__piece").drop("__piece")
