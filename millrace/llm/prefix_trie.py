"""The trie of conversation prefixes, by collapsing whole sequences.

A conversation is a sequence of turns (role, text); the trie has a node for every distinct sequence of first turns. Equal
whole conversations are collapsed into one weighted sequence with the list of its conversations; an anti-join against the
proper prefixes of all sequences leaves the leaves; then each sequence adds its weight to its own prefixes only.

A prefix is named by its length and the sum, over its turns, of a number drawn from the digest of turn and position. A
sum, unlike a chained digest, is a running total, so a conversation too long for one task is computed in chunks. Texts are
read once, as digests and sizes; they are never shuffled.

Sums over a subtree need no walk. A node's members pass through all nodes of its subtree that they own, where a node
belongs to its smallest conversation, so both the tokens of all members (weight times what follows of the sequence) and
the tokens kept once (what follows, as far as owned) are sums over the sequences through the node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.frames import ready, written
from millrace.operators import skew
from millrace.operators.windows import apply_window

ENDS = 8192  # conversations in a block of an end list
NODE = ["depth", "name"]


def turns_of(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """``conv_id`` (long), ``position`` (from 1, by turn, null first), ``digest`` of role and text, ``size`` (UTF-8 bytes
    of the text). Null roles and texts are empty; turns at one place go by their digest, repeated rows all count; rows
    without a conversation are left out."""
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    rows = df.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"),
                     F.octet_length(text_).cast("long").alias("size")).filter("conv_id IS NOT NULL")
    return apply_window(rows, "RowNumber", ["conv_id"], ["turn", "digest"], "position", max_group_rows=max_group_rows) \
        .select("conv_id", F.col("position").cast("long").alias("position"), "digest", "size")


def _number(hexadecimal: Column) -> Column:
    """88 bits of a digest as a decimal; 2^38 of them still add up below 38 digits."""
    high, low = (F.conv(F.substring(hexadecimal, 1 + 11 * i, 11), 16, 10).cast("decimal(14,0)") for i in range(2))
    return (high * F.lit(1 << 44).cast("decimal(14,0)") + low).cast("decimal(38,0)")


def prefixes(turns: DataFrame, convs: DataFrame, max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """A row per conversation and prefix, the empty one included: conv_id, depth, name, upto (bytes of its turns), size
    and ``step`` (size and number of its last turn). ``convs`` lists every conversation, with turns or without."""
    rows = turns.select("conv_id", F.col("position").alias("depth"), "size",
                        _number(F.sha2(F.concat(F.col("position").cast("string"), F.lit(":"), F.col("digest")), 256)).alias("step"))
    heavy = skew.heavy_groups(rows, ["conv_id"], max_group_rows)
    if heavy:
        rows = written(rows, "trie-turns")
    rows = apply_window(rows, "Sum", ["conv_id"], ["depth"], "name", "step", max_group_rows=max_group_rows, heavy=heavy)
    rows = apply_window(rows, "Sum", ["conv_id"], ["depth"], "upto", "size", max_group_rows=max_group_rows, heavy=heavy)
    number, zero = "decimal(38,0)", F.lit(0)
    rows = rows.select("conv_id", "depth", F.col("name").cast(number).alias("name"), F.col("upto").cast("long").alias("upto"), "size", "step")
    root = convs.select("conv_id", zero.cast("long").alias("depth"), zero.cast(number).alias("name"), zero.cast("long").alias("upto"),
                        zero.cast("long").alias("size"), zero.cast(number).alias("step"))
    return rows.unionByName(root)


def _blocks(batches):
    """Rows (depth, name, conv_id) in order, as blocks of ids: depth, name, first id, count of ids, ids as text."""
    held, ids = None, []

    def row():
        return (*held, ids[0], ",".join(map(str, ids)).encode())

    for batch in batches:
        out = []
        for depth, name, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held != (depth, name) or len(ids) == ENDS:
                if ids:
                    out.append(row())
                held, ids = (depth, name), []
            ids.append(conv)
        yield _arrow(out, (pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.binary()), ["depth", "name", "first", "ids"])
    if ids:
        yield _arrow([row()], (pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.binary()), ["depth", "name", "first", "ids"])


def _hashed(batches):
    """Blocks in order, as one digest per (depth, name); a block at a time is held."""
    held, state, out = None, None, []
    kinds = (pa.int64(), pa.decimal128(38, 0), pa.string())
    for batch in batches:
        for depth, name, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if held == (depth, name):
                state.update(b",")
            else:
                if held:
                    out.append((*held, state.hexdigest()))
                held, state = (depth, name), hashlib.sha256()
            state.update(ids)
        yield _arrow(out, kinds, [*NODE, "ends_sha256"])
        out = []
    if held:
        yield _arrow([(*held, state.hexdigest())], kinds, [*NODE, "ends_sha256"])


def _arrow(rows, kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def end_lists(whole: DataFrame) -> DataFrame:
    """``ends_sha256`` per sequence (depth, name) of the rows (depth, name, conv_id): of its ids in ascending order,
    joined by commas. The ids of a large group are put in order and joined to blocks by many tasks; only the digest,
    which no two tasks can share, is made block after block in one."""
    ready(whole.sparkSession)
    order = [*NODE, "conv_id"]
    blocks = whole.select(*order).repartitionByRange(*order).sortWithinPartitions(*order) \
        .mapInArrow(_blocks, "depth long, name decimal(38,0), first long, ids binary")
    return written(blocks, "trie-ends").repartition(*NODE).sortWithinPartitions(*NODE, "first") \
        .mapInArrow(_hashed, "depth long, name decimal(38,0), ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """The nodes of the trie, all numbers long: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's
    conv_id; null at the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (nodes without children in the
    subtree, its top included), ``saved_tokens`` (over the subtree, (n_convs - 1) times the bytes of the last text), and
    ``ends_sha256`` (of the conversations that end there, see :func:`end_lists`; of nothing if none does).

    ``turns`` as :func:`turns_of` gives them: conv_id, position (1, 2, ...), digest, size; ``convs``: one row per
    conv_id, with turns or without. Without conversations there are no nodes, not even a root. Other columns are ignored.
    """
    steps = written(prefixes(turns, convs, max_group_rows), "trie-prefixes")
    last = F.max_by(F.struct("depth", "name", "upto"), "depth").alias("s")
    whole = written(steps.groupBy("conv_id").agg(last).select("conv_id", "s.*"), "trie-whole")
    sequences = written(whole.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"),
                                                 F.max("upto").alias("total")), "trie-sequences")
    about = sequences.select("conv_id", "weight", "total", F.col("depth").alias("length"))
    collapsed = skew.join_per_key(steps, about, ["conv_id"], max_group_rows=max_group_rows)
    collapsed = written(collapsed, "trie-collapsed")
    proper = collapsed.filter("depth < length").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select(F.col("conv_id").alias("leaf_conv"))
    owned = collapsed.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max(F.col("upto") - F.col("size")).alias("before")) \
        .groupBy("conv_id").agg(F.min_by(F.struct("depth", "before"), "depth").alias("o")) \
        .select(F.col("conv_id").alias("own_conv"), F.col("o.depth").alias("own_from"), F.col("o.before").alias("own_before"))
    marks = sequences.select("conv_id").join(leaves, F.col("conv_id") == F.col("leaf_conv"), "left") \
        .join(owned, F.col("conv_id") == F.col("own_conv"), "left") \
        .select("conv_id", F.col("leaf_conv").isNotNull().cast("long").alias("leaf"), "own_from", "own_before")
    marked = skew.join_per_key(collapsed, written(marks, "trie-marks"), ["conv_id"], max_group_rows=max_group_rows)
    after = F.col("total") - F.col("upto") + F.col("size")  # bytes of the sequence from this node on
    kept = F.when(F.col("depth") >= F.col("own_from"), after).otherwise(F.col("total") - F.col("own_before"))
    kept = F.when(F.col("own_from").isNotNull(), kept).otherwise(F.lit(0).cast("long"))
    nodes = written(marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        (F.sum((F.col("weight") * after).cast("decimal(38,0)")) - F.sum(kept.cast("decimal(38,0)"))).cast("long").alias("saved_tokens"),
        F.max("step").alias("step")), "trie-nodes")
    parent = [(F.col("depth") - 1).alias("depth"), (F.col("name") - F.col("step")).cast("decimal(38,0)").alias("name")]
    children = nodes.filter("depth > 0").select(*parent).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    with_parent = nodes.select("*", *[c.alias(f"up_{n}") for c, n in zip(parent, NODE)])
    above = nodes.select(F.col("depth").alias("up_depth"), F.col("name").alias("up_name"), F.col("conv_id").alias("parent_conv_id"))
    named = skew.join_per_key(with_parent, above, ["up_depth", "up_name"], "left", max_group_rows=max_group_rows)
    nothing = hashlib.sha256(b"").hexdigest()
    return named.join(children, NODE, "left").join(end_lists(whole), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
