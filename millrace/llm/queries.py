"""The registered queries of this subpackage: thin calls of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import bpe, centroids, language, neighbours, oracles, packing, pii, prefix_trie, quality, rollups, secrets, simhash, token_files, urls
from millrace.llm.frames import written
from millrace.operators import skew
from millrace.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.ORACLES

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
RULES = [urls.Rule("allow", "com"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
         urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digested(found: DataFrame, base) -> DataFrame:
    """doc_id, the number of spans of each base kind, their digest, and all spans as text."""

    def of_kinds(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    named = [F.size(of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *named, F.sha2(listed(of_kinds(*base)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op1_byte_bpe(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(documents, RANKS, public_tokenizers.PATTERN) \
        .select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op2_neighbours(spark, sf_dir):
    embeddings = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(embeddings, embeddings.filter("vec_id % 20 = 0"), 20)


@query
def op3_simhash(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(documents).select("doc_id", "fingerprint", "component_id")


@query
def op4_packing(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(documents, WORDS)
    return packing.pack(pieces, documents.count()) \
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op5_pii(spark, sf_dir):
    found = pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    return _digested(found, pii.BASE)


@query
def op6_url_filters(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages.select("page_id", "url"), RULES, urls.word_counts(pages, "html")) \
        .select("page_id", "host", "path", "rule", "verdict", "block_score", "host_words")


@query
def op7_language(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(documents.filter(~language.held_out()))
    return language.identify(documents.select("doc_id", "text"), model) \
        .select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "languages")


@query
def op8_quality(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.train(documents, _table(spark, sf_dir, "labels"))
    return quality.judge(documents, trees).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op9_token_files(spark, sf_dir):
    folder = new_folder(spark, "token-files")
    token_files.write_files(_table(spark, sf_dir, "documents"), folder, WORDS)
    return token_files.read_files(spark, folder)


@query
def op10_token_rollup(spark, sf_dir):
    """Four batches over all documents: their tokens, the withdrawal of exact copies (the smallest doc_id stays), an end
    id for each that is left, and a second tokenizer (one id per byte). The second batch is sent twice."""
    counted = rollups.count_documents(_table(spark, sf_dir, "documents"), WORDS)
    kept, copies = rollups.split_copies(counted)
    words = F.lit("word_bpe_49k").alias("tokenizer")
    group = ["source", "lang"]
    batches = {
        "load": counted.select(F.lit("insert").alias("op"), *group, words, "n_tokens"),
        "copies": copies.select(F.lit("delete").alias("op"), *group, words, "n_tokens"),
        "end-ids": kept.select(F.lit("revise").alias("op"), *group, words, (F.col("n_tokens") + 1).alias("n_tokens"),
                               F.col("n_tokens").alias("old_tokens")),
        "bytes": kept.select(F.lit("insert").alias("op"), *group, F.lit("bytes_256").alias("tokenizer"),
                             F.col("n_bytes").alias("n_tokens")),
    }
    rollup = rollups.Rollup(spark, new_folder(spark, "rollup"))
    for batch in ("load", "copies", "end-ids", "copies", "bytes"):
        rollup.commit(batch, batches[batch])
    return rollup.totals()


@query
def op12_secrets(spark, sf_dir):
    return _digested(secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")), tuple(secrets.BASE))


@query
def op11_centroids(spark, sf_dir):
    embeddings = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    placed, points = centroids.cluster(embeddings, order, 40, 5)
    return centroids.with_inertia(placed.drop("embedding"), points) \
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after every conversation c takes the first h turns of conversation c - c % 5 in place of its
    own first h; h is crc32 of c modulo 9, so at most eight turns are copied, to at most nine conversations."""
    turns = written(turns, "turns")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")) \
        .select("*", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"),
                (F.col("conv_id") - F.col("conv_id") % 5).alias("root"))
    convs = written(convs, "convs")
    roots = convs.select(F.col("conv_id").alias("root"), F.col("n").alias("n_root"))
    lengths = written(convs.join(roots, "root", "left").select(
        "conv_id", "root", "h", F.least("h", F.coalesce("n_root", F.lit(0))).alias("shared")), "lengths")
    own = skew.join_per_key(turns, lengths.drop("root"), ["conv_id"]).filter("position > h") \
        .withColumn("position", F.col("position") - F.col("h") + F.col("shared"))
    opening = turns.filter((F.col("conv_id") % 5 == 0) & (F.col("position") <= 8)).withColumnRenamed("conv_id", "root")
    copied = opening.join(lengths, "root").filter("position <= h")
    columns = ["conv_id", "position", "digest", "size"]
    return own.select(*columns).unionByName(copied.select(*columns)), convs.select("conv_id")


@query
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(*rebuilt(prefix_trie.turns_of(_table(spark, sf_dir, "conversations"))))
