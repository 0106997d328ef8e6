"""Token counts maintained by deltas.

A batch of signed changes (inserts, deletes, revised counts) becomes additive rows per source, language and tokenizer
version. A batch is committed by one row in the table of commits, after its rows are written: a batch that ran before
changes nothing, and rows of an attempt that never committed are not counted. Totals are the sums over commits.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.frames import add_columns, written
from millrace.llm.words import count_tokens, word_tokenizer

KEYS = ["source", "lang", "tokenizer"]
_DELTA = "batch string, attempt string, source string, lang string, tokenizer string, docs long, tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Additive rows of a batch of changes: source, lang, tokenizer, docs, tokens.

    ``changes`` has op (``insert``, ``delete`` or ``revise``), source, lang, tokenizer, n_tokens and, for revisions,
    old_tokens. Null counts are 0; a null source, language or tokenizer is a group of its own; rows with another or a
    null op are an error, so no change is lost unseen. Repeated rows are changes of their own.
    """
    before = F.col("old_tokens") if "old_tokens" in changes.columns else F.lit(None).cast("long")
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce(before, F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null"))))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0) \
        .otherwise(wrong.cast("int"))
    tokens = F.when(F.col("op") == "delete", -n).when(F.col("op") == "revise", n - old).otherwise(n)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class Rollup:
    """Totals in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> DataFrame:
        """One attempt per batch: the first by name, should two have committed at once."""
        try:
            rows = self.spark.read.schema("batch string, attempt string").parquet(f"{self.folder}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], "batch string, attempt string")
        return rows.groupBy("batch").agg(F.min("attempt").alias("attempt"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been applied before."""
        if not self._commits().filter(F.col("batch") == batch).isEmpty():
            return False
        attempt = uuid.uuid4().hex
        deltas(changes).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), *KEYS, "docs", "tokens") \
            .write.mode("append").parquet(f"{self.folder}/deltas")
        self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt")) \
            .write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches; groups without documents or tokens left
        are not listed."""
        commits = self._commits()
        if commits.isEmpty():
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        rows = self.spark.read.schema(_DELTA).parquet(f"{self.folder}/deltas")
        return rows.join(commits, ["batch", "attempt"], "left_semi").groupBy(*KEYS) \
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")


def count_documents(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, n_bytes, digest (of the text) and a row number ``row``, written once; a null
    text is empty."""

    def make():
        tokenizer = word_tokenizer(vocabulary)
        return lambda texts: ([count_tokens(tokenizer, t) for t in texts],)

    rows = df.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "digest": F.sha2("text", 256),
                             "n_bytes": F.octet_length("text").cast("long")})
    return written(add_columns(rows, ["text"], "n_tokens long", make).drop("text"), "counted")


def split_copies(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the row of the smallest doc_id of each text, all other rows); null ids come last."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = written(counted.groupBy("digest").agg(F.min(order)["row"].alias("row")).select("row"), "first")
    return counted.join(first, "row", "left_semi"), counted.join(first, "row", "left_anti")
