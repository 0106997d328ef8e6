"""Near-duplicate texts by SimHash fingerprints and pivot distance tables.

A table of the Hamming distances of each fingerprint to many reference fingerprints bounds every pair's distance from
below by the largest difference of their coordinates, so most pairs are discarded without being compared; survivors
are verified. Which pairs are tried follows from the pigeonhole: the 64 bits lie in six blocks, and of fingerprints
that differ in at most three bits three blocks are equal, so pairs are tried only where they share three blocks
(20 keys). A key with many fingerprints is refined in the same way: of four parts of its free bits one is equal.
Equal texts have one fingerprint and are handled once; within a key only links that join new fingerprints are made.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from millrace.llm.components import components
from millrace.llm.frames import add_columns, ready, without, written

DISTANCE = 3
SHINGLE = 3
SEED = 42
BLOCKS = 6
LARGE = 2048     # fingerprints per key beyond which the key is refined
PIVOTS = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little")) for i in range(32)], np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit integer; no words give 0."""
    words = (text or "").encode().lower().split()  # both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(size, len(words))
    spans = zip((ends - lengths)[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text as a long; a null text has no words."""
    return add_columns(df, [text], f"`{into}` long", lambda: lambda texts: ([fingerprint(t) for t in texts],))


def as_hex(column) -> F.Column:
    """16 lower-case hexadecimal digits of a long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(bits: list[int], count: int) -> list[list[int]]:
    return [bits[i * len(bits) // count:(i + 1) * len(bits) // count] for i in range(count)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def key_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks such that any two fingerprints within ``distance`` agree on all bits of at least one."""
    cut = _parts(list(range(64)), blocks)
    return [_mask([b for part in chosen for b in part]) for chosen in combinations(cut, blocks - distance)]


def finer_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """Masks that do the same for fingerprints that agree on ``mask``."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | _mask(part) for part in _parts(free, distance + 1)]


def near(one: np.ndarray, others: np.ndarray, table: np.ndarray, row: np.ndarray, distance: int) -> np.ndarray:
    """Which of ``others`` (with pivot distances ``table``) lie within ``distance`` of ``one`` (with ``row``)."""
    kept = np.flatnonzero(np.abs(table - row).max(axis=1) <= distance)
    return kept[np.bitwise_count(others[kept] ^ one) <= distance]


def spanning_links(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect exactly what all pairs within ``distance`` connect: a search from each fingerprint over
    those not reached yet."""
    table = np.bitwise_count(prints[:, None] ^ PIVOTS).astype(np.int8)
    left, links = np.arange(len(prints)), []
    while len(left) > 1:
        open_, left = [left[0]], left[1:]
        while open_ and len(left):
            x = open_.pop()
            hit = near(prints[x], prints[left], table[left], table[x], distance)
            reached = left[hit]
            links += [(x, y) for y in reached.tolist()]
            open_ += reached.tolist()
            left = np.delete(left, hit)
    return links


def links(prints: DataFrame, distance: int = DISTANCE, large: int = LARGE) -> DataFrame:
    """Links ``a``, ``b`` that connect distinct fingerprints (one long column) as all pairs within ``distance`` do."""
    ready(prints.sparkSession)
    name = prints.columns[0]
    masks = key_masks(distance)
    keys = prints.select(F.col(name).alias("f"), F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = None
    while True:
        keys = keys.withColumn("value", F.col("f").bitwiseAND(F.col("mask")))
        sizes = written(keys.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "keys")
        keys = written(keys.join(sizes, ["mask", "value"]), "keys")
        finer = {m: finer_masks(m, distance) for m in masks}
        few = max(64 - m.bit_count() for m in masks) <= 15  # such a key holds at most 2^15 fingerprints
        buckets = (keys if few else keys.filter(F.col("n") <= large)) \
            .groupBy("mask", "value").agg(F.collect_list("f").alias("members")).select("members")
        linked = buckets.mapInArrow(lambda batches: _bucket_links(batches, distance), "a long, b long")
        found = linked if found is None else found.unionByName(linked)
        crowded = keys.filter(F.col("n") > large)
        if few or sizes.filter(F.col("n") > large).isEmpty():
            return found.distinct()
        children = F.create_map(*[x for m in masks for x in
                                  (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in finer[m]]))])
        keys = crowded.select("f", F.explode(children[F.col("mask")]).alias("mask"))
        masks = sorted({c for cs in finer.values() for c in cs})


def _bucket_links(batches, distance):
    for batch in batches:
        members = batch.column(0)
        prints = members.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = members.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        two = starts[sizes == 2]
        a, b = prints[two], prints[two + 1]
        apart = np.zeros(len(two), np.int64)
        for pivot in PIVOTS:
            apart = np.maximum(apart, np.abs(np.bitwise_count(a ^ pivot).astype(np.int64) - np.bitwise_count(b ^ pivot)))
        kept = np.flatnonzero(apart <= distance)
        kept = kept[np.bitwise_count(a[kept] ^ b[kept]) <= distance]
        lefts, rights = [a[kept]], [b[kept]]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = prints[start:start + size]
            pairs = np.array(spanning_links(own, distance), np.int64).reshape(-1, 2)
            lefts.append(own[pairs[:, 0]])
            rights.append(own[pairs[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side).view(np.int64)) for side in (lefts, rights)],
                                         ["a", "b"])


def components_of(marked: DataFrame, doc_id: str, distance: int = DISTANCE) -> DataFrame:
    """One row per distinct ``__fp`` of a written table with ``__row``: ``__fp`` and ``first``, the struct
    (no_id, id, row) of the first row of its component: smallest id, null ids last."""
    first = F.min(F.struct(F.col(f"`{doc_id}`").isNull().alias("no_id"), F.col(f"`{doc_id}`").alias("id"),
                           F.col("__row").alias("row"))).alias("first")
    prints = written(marked.groupBy("__fp").agg(first), "fingerprints")
    grouped = components(links(prints.select("__fp"), distance))
    named = prints.join(grouped.withColumnRenamed("node", "__fp"), "__fp", "left") \
        .withColumn("component", F.coalesce("component", "__fp"))
    named = written(named, "fingerprints")
    least = written(named.groupBy("component").agg(F.min("first").alias("first")), "components")
    return written(named.drop("first").join(least, "component").select("__fp", "first"), "fingerprints")


def mark(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``__fp`` and a row number ``__row``, written once."""
    return written(fingerprints(df.withColumn("__row", F.monotonically_increasing_id()), text, "__fp"),
                   "marked")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Add ``fingerprint`` (hexadecimal) and ``component_id``: the smallest doc_id that links of at most ``distance``
    differing bits reach, itself included; null if none of them has an id. Repeated rows stay; texts without words
    (null, empty) have fingerprint zero and link like any other; an empty table gives none. ``text`` is dropped,
    columns of the new names are replaced."""
    marked = mark(without(df, ["component_id", "fingerprint"]), text)
    rows = without(marked, [text])
    return rows.join(components_of(rows, doc_id, distance), "__fp", "left") \
        .withColumns({"component_id": F.col("first.id"), "fingerprint": as_hex(F.col("__fp"))}) \
        .drop("first", "__row", "__fp")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each component: that of the smallest doc_id (of repeated ids the first read), null ids last.

    The rows to drop are found without their texts, and they are usually the fewer, so a text moves only if there are
    too many of them to broadcast."""
    columns = df.columns
    marked = mark(df, text)
    narrow = marked.select(doc_id, "__fp", "__row")
    dropped = narrow.join(components_of(narrow, doc_id, distance), "__fp").filter(F.col("first.row") != F.col("__row"))
    return marked.join(written(dropped.select("__row"), "dropped"), "__row", "left_anti").select(*[f"`{c}`" for c in columns])
