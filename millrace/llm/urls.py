"""URL filters: host and path rules, and a classifier for the urls that no rule fits.

Concatenated host names are split into words by unigram Viterbi; multinomial naive Bayes over host words and path
tokens, learned from the urls that rules decide, scores the rest. Words, counts and scores are tables: each distinct
host part is split once, beside the counts of its own substrings only.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.frames import add_columns, without, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (text, verdict) of the longest rule that fits, of equal lengths a blocking one first; else null."""
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def word_counts(df: DataFrame, markup: str) -> DataFrame:
    """``word``, ``n``: words of letters a-z in the visible text of markup pages."""
    # what is never closed goes on to the end, so no tag is searched for in vain
    visible = F.regexp_replace(F.col(f"`{markup}`"), r"(?s)<(script|style)\b.*?(?:</\1>|\z)|<[^>]*(?:>|\z)", " ")
    return df.select(F.explode(F.regexp_extract_all(F.lower(visible), F.lit(r"\p{L}+"), F.lit(0))).alias("word")) \
        .filter("word RLIKE '^[a-z]+$'").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(part: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely words of a concatenated name; a word without a count costs more with each letter.

    Words that have a count are tried by their lengths; the best start of one that has none only moves on when a later
    start is better, so a step takes no longer in a long name. Of equally likely splits the last word is the shortest.
    """
    lengths = sorted({len(w) for w in counts})
    letter, unknown = math.log(10), math.log(max(total, 1) + 1)
    best: list[tuple[float, int]] = [(0.0, 0)]
    open_ = (-math.inf, 0)  # chance of the best split that ends in an unknown word, and where that begins
    for end in range(1, len(part) + 1):
        open_ = max((open_[0] - letter, open_[1]), (best[end - 1][0] - unknown - letter, end - 1))
        options = [open_]
        for length in lengths:
            if length > end:
                break
            if n := counts.get(part[end - length:end], 0):
                options.append((best[end - length][0] + math.log(n / total), end - length))
        best.append(max(options))
    words, end = [], len(part)
    while end:
        begin = best[end][1]
        words.append(part[begin:end])
        end = begin
    return words[::-1]


def split_hosts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``host``, ``words`` for a table of distinct hosts and a written table of unigram counts."""
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))).alias("at", "part"))
    distinct = written(parts.select("part").distinct(), "parts")
    begins = F.sequence(F.lit(1), F.length("part"))
    lengths = [r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect()]  # a number a word length
    fitting = F.filter(F.lit(sorted(lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("part") - F.col("begin") + 1)
    pieces = distinct.select("part", F.explode(begins).alias("begin")) \
        .select("part", F.explode(F.transform(fitting, lambda n: F.substring(F.col("part"), F.col("begin"), n))).alias("word")).distinct()
    known = pieces.join(words, "word").groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))

    def make():
        return lambda names, counts: ([best_split(p, dict(c or ()), total) for p, c in zip(names, counts)],)

    split = written(add_columns(distinct.join(known, "part", "left"), ["part", "counts"], "words array<string>", make)
                    .select("part", "words"), "parts")
    return parts.join(split, "part").groupBy("host") \
        .agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("w")).select("host", F.flatten("w.words").alias("words"))


def judge(df: DataFrame, rules: list[Rule], words: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits), ``verdict``, ``block_score`` (log-odds, null where a rule
    decides) and ``host_words``.

    A null url, or one without ``://``, has an empty host and path and no tokens: the classes' shares decide. Ties
    allow. Repeated rows are judged alike; an empty table gives none; columns of these names are replaced.
    """
    names = ["host", "path", "rule", "verdict", "block_score", "host_words"]
    rows = without(df, names)
    column = F.col(f"`{url}`")
    keyed = rows.select("*", host_of(column).alias("host"), path_of(column).alias("path"),
                        F.monotonically_increasing_id().alias("__row"))
    keyed = written(keyed.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules)), "urls")
    hosts = written(split_hosts(keyed.select("host").distinct(), written(words, "words")), "hosts")
    steps = F.transform(F.regexp_extract_all(F.lower("path"), F.lit(r"[a-z]+|[0-9]+"), F.lit(0)),
                        lambda t: F.concat(F.lit("path "), F.regexp_replace(t, "[0-9]+", "0")))
    known = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("host "), w))
    tokens = keyed.join(hosts, "host", "left").select(
        "__row", (F.col("__rule.verdict") == "block").cast("int").alias("blocked"), F.explode(F.concat(known, steps)).alias("token"))
    learned = tokens.filter("blocked IS NOT NULL").groupBy("token") \
        .agg(F.sum("blocked").alias("b"), F.sum(1 - F.col("blocked")).alias("a"))
    learned = written(learned, "tokens")
    sums = learned.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("v")).first()
    shares = keyed.agg(F.count_if(F.col("__rule.verdict") == "block").alias("b"), F.count_if(F.col("__rule.verdict") == "allow").alias("a")).first()
    prior = math.log((shares["b"] + 1) / (shares["a"] + 1))
    size = sums["v"] + 1
    gain = F.log((F.col("b") + 1) / ((sums["b"] or 0) + size)) - F.log((F.col("a") + 1) / ((sums["a"] or 0) + size))
    weights = written(learned.select("token", gain.alias("gain")), "tokens")
    scores = tokens.filter("blocked IS NULL").join(weights, "token").groupBy("__row").agg(F.sum("gain").alias("gain"))
    scored = keyed.join(written(scores, "scores"), "__row", "left").join(hosts, "host", "left")
    score = F.when(F.col("__rule").isNull(), F.coalesce("gain", F.lit(0.0)) + F.lit(prior))
    return scored.select(
        *[f"`{c}`" for c in rows.columns], "host", "path", F.col("__rule.text").alias("rule"),
        F.coalesce("__rule.verdict", F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
        score.alias("block_score"), F.col("words").alias("host_words"))
