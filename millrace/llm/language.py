"""Languages of a text as a mixture: expectation-maximisation over n-gram likelihoods.

Each language is a distribution over hashed byte trigrams of lower-case text. A document's language proportions are
the mixture weights that make its trigrams most likely; a language joins the set only if it raises the
log-likelihood by more than a penalty. The first step settles most documents without iterating: the likelihood is
concave in the weights, so its slope towards another language bounds what adding it can gain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.frames import add_columns, ready

BUCKETS = 1 << 16
PENALTY = 0.02        # gain per trigram that another language must bring, and at least LEAST in all
LEAST = 12.0
ROUNDS = 30
SAMPLE = 2_000        # labelled texts per language to learn from, about
LANGUAGES = 400       # at most
_BLANK = np.arange(256, dtype=np.uint8)  # digits, signs and white space become blanks
_BLANK[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of a lower-case text, runs of non-letters being one blank."""
    raw = _BLANK[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)]
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))].astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.uint32)
    return ((raw[:-2] * np.uint32(40_503) + raw[1:-1] * np.uint32(1_217) + raw[2:] * np.uint32(7)) * np.uint32(2_654_435_761)
            >> np.uint32(16))


class LanguageModel:
    """``log_p``: log-probability of each trigram bucket (rows) in each language (columns)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.p = (smooth / smooth.sum(axis=0)).astype(np.float32)

    def proportions(self, text: str | None, penalty: float = PENALTY) -> dict[str, float] | None:
        """Language proportions of a whole text; None without a letter or without a language to choose from."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return None
        grams = trigrams(text)
        chance = self.p[grams]
        logs = np.log(chance).sum(axis=0, dtype=np.float64)
        chosen = [int(np.argmax(logs))]
        weights, level, cost = np.ones(1), logs[chosen[0]], max(LEAST, penalty * len(grams))
        while len(chosen) < len(self.languages):
            mixed = chance[:, chosen] @ weights
            slopes = (chance / mixed[:, None]).sum(axis=0, dtype=np.float64) - len(grams)
            slopes[chosen] = -np.inf
            best = None
            for k in np.flatnonzero(slopes > cost):
                found, reached = self._fit(chance[:, [*chosen, k]])
                if reached - level > cost and (best is None or reached > best[2]):
                    best = (int(k), found, reached)
            if best is None:
                break
            chosen, weights, level = [*chosen, best[0]], best[1], best[2]
        return {self.languages[k]: float(w) for k, w in zip(chosen, weights)}

    @staticmethod
    def _fit(chance: np.ndarray) -> tuple[np.ndarray, float]:
        """Expectation-maximisation of the mixture weights."""
        weights = np.full(chance.shape[1], 1 / chance.shape[1])
        for _ in range(ROUNDS):
            shares = chance * weights
            mixed = shares.sum(axis=1)
            new = (shares / mixed[:, None]).mean(axis=0, dtype=np.float64)
            done = np.abs(new - weights).max() < 1e-4
            weights = new
            if done:
                break
        return weights, float(np.log(chance @ weights).sum(dtype=np.float64))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learn from about ``sample`` different texts of each language (all, if there are fewer), chosen by the hash of the
    text; copies count once. Rows with a null text or language are left out; without rows the model knows no language.
    More than LANGUAGES languages are an error: the model is a table of BUCKETS numbers for each."""
    spark = labelled.sparkSession
    ready(spark)
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).dropna()
    counted = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text", F.lit(7))).alias("n"))
    total = {r["lang"]: r["n"] for r in counted.limit(LANGUAGES + 1).collect()}  # a row a language
    if len(total) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    languages = sorted(total)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample / total[k])))])
    drawn = rows.withColumn("h", F.xxhash64("text", F.lit(7))) \
        .filter((F.col("h").bitwiseAND(0xFFFFFFF) / F.lit(float(1 << 28))) < share[F.col("lang")]) \
        .groupBy("lang", "h").agg(F.min("text").alias("text")).drop("h")  # copies meet before the shuffle

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(language, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(value), minlength=BUCKETS)
        for language, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(used)), pa.array(used), pa.array(own[used])],
                                             ["lang", "bucket", "n"])

    counts = np.zeros((BUCKETS, len(languages)))
    for r in drawn.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket") \
            .agg(F.sum("n").alias("n")).toPandas().itertuples():  # at most BUCKETS rows a language
        counts[r.bucket, languages.index(r.lang)] = r.n
    return LanguageModel(languages, counts)


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` (the language with the largest proportion; ``und`` for a null text, one without a letter, or
    an untrained model), ``score`` (that proportion, 0 for ``und``) and ``languages`` (every chosen language with its
    proportion). Columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def make():
        own = shared.value

        def compute(texts):
            found = [own.proportions(t) for t in texts]
            best = [max(p.items(), key=lambda kv: (kv[1], kv[0])) if p else ("und", 0.0) for p in found]
            return [b[0] for b in best], [min(1.0, b[1]) for b in best], [list((p or {}).items()) for p in found]

        return compute

    return add_columns(df, [text], "lang_pred string, score double, languages map<string, double>", make)


def held_out(doc_id: str = "doc_id") -> Column:
    """The documents kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))
