"""Reading large JSON arrays by many tasks.

Spark's text reader cuts a file into splits and, told that lines end at ``}``, into pieces that each end with that
character. What a piece does to the reader's state (inside a string or not, open braces, open brackets) can be said for
both ways it may begin, and such effects compose: within a split by running sums, from split to split by one row per
split. That tells where each object of the array ends without reading the file in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from millrace.session import new_folder

_PACKED = r"\.(gz|bz2|zst|deflate|snappy|lz4|xz)$"
_SPLIT = ["file", "block"]
_OPENING = r"\A\x{FEFF}?\s*(,|(\]\s*)?\[?)\s*"  # what parts an item from the one before


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark)))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every piece with its place and its effect: ``flip`` if it holds an odd number of quotes, and the change of open
    braces and brackets if it begins outside a string (0) or inside one (1). A brace at its end counts as closed."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("piece"))
    bare = raw.withColumn("bare", F.regexp_replace("piece", r"(?s)\\.", "")) \
        .withColumn("flip", _count(F.col("bare"), '"') % 2) \
        .withColumn("out0", F.regexp_replace("bare", r'"[^"]*("|\z)', "")) \
        .withColumn("out1", F.regexp_replace(F.regexp_replace("bare", r'\A[^"]*("|\z)', ""), r'"[^"]*("|\z)', ""))
    effects = [e for i in (0, 1) for e in (
        (_count(F.col(f"out{i}"), "{") - F.when(F.col("flip") == i, 1).otherwise(0)).alias(f"braces{i}"),
        (_count(F.col(f"out{i}"), "[") - _count(F.col(f"out{i}"), "]")).alias(f"brackets{i}"))]
    return bare.select("file", "block", "size", "seq", "piece", "flip", *effects)


def _by_state(inside: Column, name: str) -> Column:
    return F.when(inside == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))


def _starts(pieces: DataFrame) -> DataFrame:
    """The state in which each split begins, and whether it is its file's last and ends without a brace."""
    within = Window.partitionBy(*_SPLIT).orderBy("seq")
    before = F.sum("flip").over(within) - F.col("flip")
    totals = pieces.select(*_SPLIT, "size", "flip", F.octet_length("piece").alias("bytes"), *[
        _by_state((before + i) % 2, name).alias(f"{name}_{i}") for i in (0, 1) for name in ("braces", "brackets")]) \
        .groupBy(*_SPLIT).agg(F.first("size").alias("size"), (F.sum("flip") % 2).alias("flip"), F.sum(F.col("bytes") + 1).alias("bytes"), *[
            F.sum(f"{name}_{i}").alias(f"{name}{i}") for i in (0, 1) for name in ("braces", "brackets")])
    along = Window.partitionBy("file").orderBy("block")
    chosen = totals.withColumn("inside", (F.sum("flip").over(along) - F.col("flip")) % 2) \
        .withColumn("braces", _by_state(F.col("inside"), "braces")).withColumn("brackets", _by_state(F.col("inside"), "brackets"))
    # a byte order mark is not part of any piece
    whole = F.sum("bytes").over(Window.partitionBy("file"))
    cut = ~F.col("file").rlike(_PACKED) & (whole != F.col("size")) & (whole != F.col("size") - 3)
    return chosen.select(*_SPLIT, "inside", *[
        (F.sum(name).over(along) - F.col(name)).alias(f"open_{name}") for name in ("braces", "brackets")],
        (cut & F.lead("block").over(along).isNull()).alias("cut"))


def _elements(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """text, whole: the pieces from one object's end to the next joined; ``whole`` is false for a file's torn rest."""
    within = Window.partitionBy(*_SPLIT).orderBy("seq")
    known = pieces.drop("size").join(starts, _SPLIT)
    # the state after each piece
    seen = known.withColumn("parity", F.col("inside") + F.sum("flip").over(within)) \
        .withColumn("begin", (F.col("parity") - F.col("flip")) % 2) \
        .withColumn("change_braces", _by_state(F.col("begin"), "braces")) \
        .withColumn("change_brackets", _by_state(F.col("begin"), "brackets")) \
        .withColumn("braces", F.col("open_braces") + F.sum("change_braces").over(within)) \
        .withColumn("brackets", F.col("open_brackets") + F.sum("change_brackets").over(within)) \
        .withColumn("within", F.col("parity") % 2 == 1) \
        .withColumn("last", F.col("cut") & F.lead("seq").over(within).isNull())
    ends = ~F.col("within") & (F.col("braces") == 0) & (F.col("brackets") <= 1) & ~F.col("last")
    marked = seen.withColumn("ends", ends.cast("int")).withColumn("part", F.sum("ends").over(within) - F.col("ends"))
    # grouped by more than the split: the pieces are where they must be already
    grouped = marked.groupBy(*_SPLIT, "part").agg(
        F.sort_array(F.collect_list(F.struct("seq", "piece", "last"))).alias("pieces"), F.max("ends").alias("ends"),
        F.first(~((F.col("inside") == 0) & (F.col("open_braces") == 0) & (F.col("open_brackets") <= 1))).alias("late"),
        # braces still open, without the one that a missing end would have closed
        F.max_by(F.col("within") | (F.col("braces") + F.col("last").cast("int") > 0), "seq").alias("open"))
    joined = F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["piece"], F.when(p["last"], "").otherwise("}"))))
    texts = grouped.select(*_SPLIT, "part", "ends", "open", ((F.col("part") == 0) & F.col("late")).alias("late"), joined.alias("text"))
    complete = texts.filter((F.col("ends") == 1) & ~F.col("late")).select("text", F.lit(True).alias("whole"))
    # at most two of a split: its first, begun in an earlier one, and its last
    torn = texts.filter((F.col("ends") == 0) | F.col("late"))
    along = Window.partitionBy("file").orderBy("block", "part")
    stitched = torn.withColumn("element", F.sum("ends").over(along) - F.col("ends")).groupBy("file", "element").agg(
        F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("pieces"), F.max("ends").alias("ends"),
        F.max_by("open", F.struct("block", "part")).alias("open"))
    rest = stitched.filter((F.col("ends") == 1) | F.col("open")).select(
        F.concat_ws("", F.col("pieces.text")).alias("text"), (F.col("ends") == 1).alias("whole"))
    return complete.unionByName(rest)


def read(spark: SparkSession, path: str, schema: T.StructType, corrupt: str) -> DataFrame:
    """One row per object of the arrays in the files of ``path``, in ``schema`` (which names ``corrupt``).

    Each file is UTF-8 text: an array whose items stand at its top level, a single object, or objects one after the
    other. Items that are not objects give no rows. An object that does not fit the schema, and what is left of a file
    that ends inside an object, become rows of nulls with their text in ``corrupt``. An empty file gives no rows. The
    largest object must fit in a task, the array need not.

    The pieces are written once to the shared folder, so that every pass sees the same splits; they are shuffled once,
    by split. Of each split one row of state, and at most two torn objects, meet those of its file's other splits.
    """
    folder = new_folder(spark, "json-array")
    _pieces(spark, path).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    found = _elements(pieces, _starts(pieces)).withColumn("text", F.regexp_replace("text", _OPENING, ""))
    # other items before the object: read the text as an array and take its last item
    items = F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), T.ArrayType(T.StringType()))
    item = F.when(~F.col("whole") | F.col("text").startswith("{"), F.col("text")).otherwise(F.coalesce(F.try_element_at(items, F.lit(-1)), "text"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    parsed = found.filter(F.col("text") != "").select("whole", item.alias("text")) \
        .select("whole", "text", F.from_json("text", schema, options).alias("row"))
    nothing = F.struct(*[(F.col("text") if f.name == corrupt else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
    return parsed.select(F.when(F.col("whole"), F.col("row")).otherwise(nothing).alias("row")).select(*[
        F.col("row").getField(f.name).alias(f.name) for f in schema.fields])
