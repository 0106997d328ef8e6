"""A corpus pipeline over ``documents``: languages, quality, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Operators see the columns under
names of the stage's own, so a column that bears the name of one of theirs comes back unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import language, packing, pii, quality, simhash
from millrace.llm.queries import WORDS
from millrace.session import new_folder

LEAST_SHARE = 0.5  # of a document's text in its main language


def _inner(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under neutral names, and these names by column."""
    names = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _outer(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(inner).alias(c) for c, inner in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts of which no language has half, go."""
    rows, names = _inner(docs)
    found = language.identify(rows, language.train(docs), names["text"])
    return _outer(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)), names)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail a base rule, or that the trees reject, go."""
    rows, names = _inner(docs)
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _outer(quality.judge(rows, trees, names["text"]).filter("kept"), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays: texts linked by SimHash fingerprints as op3 links them."""
    rows, names = _inner(docs)
    return _outer(simhash.keep_first(rows, names["doc_id"], names["text"]), names)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind; ``n_chars`` follows."""
    rows, names = _inner(docs)
    redacted = _outer(pii.redact_texts(rows, names["text"]), names)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows of 2,048."""
    pieces = packing.token_pieces(docs.select("doc_id", "text"), WORDS, with_ids=True)
    return packing.pack(pieces, docs.count()).select("sequence_id", "offset", "doc_id", "start", "length", "doc_tokens", "ids")


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack_tokens),
]

ORACLE_SQL = None  # no stage can be said in SQL; tests compare each with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again; returns the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
