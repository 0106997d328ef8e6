"""Row enrichment: lookups, calculated fields, text scoring, entities, model scoring, keyed functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.columns import any_of, as_text, called, field
from millrace.operators import phrases, skew

# -- lookups ----------------------------------------------------------------------------------------------------


def _first_per_key(lookup: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row per key: the smallest value row. Null keys match nothing and are left out."""
    row = F.min(F.struct(*[field(v).alias(v) for v in values])).alias("__row")
    return lookup.filter(field(key).isNotNull()).groupBy(field(key)).agg(row)


def enrich_from_lookup(df: DataFrame, lookup: DataFrame, source_key: str, lookup_key: str, value_fields: list[str],
                       include_null_matches: bool = False,
                       max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Add ``value_fields`` by key. Unmatched rows are dropped, or kept with nulls; rows never multiply."""
    firsts = _first_per_key(lookup, lookup_key, value_fields)
    joined = skew.join_per_key(df, firsts, [source_key], "left" if include_null_matches else "inner", [lookup_key],
                               max_group_rows=max_group_rows, null_safe=False)
    added = [F.col("__row")[v].alias(v) for v in value_fields]
    return joined.select(*[field(c) for c in df.columns if c not in value_fields], *added)


def lookup_value(df: DataFrame, lookup: DataFrame, source_key: str, lookup_key: str, value: str,
                 target: str) -> DataFrame:
    """Add one looked-up value under ``target``, null where the key is unknown."""
    renamed = lookup.select(field(lookup_key).alias("__k"), field(value).alias(target))
    return enrich_from_lookup(df, renamed, source_key, "__k", [target], include_null_matches=True)


# -- calculated fields ------------------------------------------------------------------------------------------

_UNITS = {"day": 86400.0, "hour": 3600.0, "minute": 60.0, "second": 1.0}


def _bind(expression: str, params: dict) -> str:
    """Expression with ``:name`` replaced by literals (text is quoted and escaped)."""

    def literal(match: re.Match) -> str:
        name = match[1]
        if name not in params:
            return match[0]
        value = params[name]
        if isinstance(value, bool):
            return "true" if value else "false"
        if value is None:
            return "NULL"
        if isinstance(value, (int, float)):
            return repr(value)
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    return re.sub(r"(?<!:):([A-Za-z_]\w*)", literal, expression)


def calculated(df: DataFrame, kind: str, fields: list[str] | None = None, expression: str | None = None,
               params: dict | None = None) -> Column:
    """Column for a calculated field: Sum, Average, Concatenate, DateDiff, Expression or Custom.

    Custom binds ``params`` into an expression, or calls ``params["call"]``, a Python function of pandas series, one for each
    of ``fields``, whose values have the type ``params["returns"]`` (double unless stated).
    """
    params, names = params or {}, fields or []
    if kind == "Sum":
        total = F.coalesce(field(names[0]), F.lit(0))
        for name in names[1:]:
            total = total + F.coalesce(field(name), F.lit(0))
        return total
    if kind == "Average":
        present = sum((F.when(field(n).isNotNull(), 1).otherwise(0) for n in names[1:]),
                      F.when(field(names[0]).isNotNull(), 1).otherwise(0))
        return F.try_divide(calculated(df, "Sum", names).cast("double"), present)
    if kind == "Concatenate":
        return F.concat_ws(params.get("separator", " "), *[as_text(field(n), df.schema[n].dataType) for n in names])
    if kind == "DateDiff":
        unit = params.get("unit", "day")
        if unit == "day":
            return F.datediff(field(names[0]), field(names[1]))
        span = field(names[0]).cast("timestamp").cast("double") - field(names[1]).cast("timestamp").cast("double")
        return (span / _UNITS[unit]).cast("bigint")
    if kind == "Expression":
        return F.expr(expression)
    if kind == "Custom" and params.get("call"):
        return called(params["call"], [field(n) for n in names], params.get("returns", "double"))
    if kind == "Custom":
        return F.expr(_bind(expression, params))
    raise ValueError(f"unknown calculated field {kind!r}")


def enrich_calculated(df: DataFrame, target: str, kind: str, **spec) -> DataFrame:
    return df.withColumn(target, calculated(df, kind, **spec))


# -- text -------------------------------------------------------------------------------------------------------


def enrich_sentiment(df: DataFrame, text: str, lexicon: dict[str, float], target: str = "sentiment") -> DataFrame:
    """Lexicon score of whole words and its label, in one pass over each row and without a shuffle.

    A text is cut into words once and each is looked up, so a lexicon of many words costs no more than a short one. Where
    entries are longer than a word of letters and digits, ``phrases.weigh_phrases`` finds them all: leftmost, then longest,
    so a word inside a phrase that was found does not count again. Null text scores 0.
    """
    weights = {w.lower(): float(v) for w, v in lexicon.items()}
    if all(re.fullmatch(r"[^\W_]+", w) for w in weights):
        word = re.compile(r"[^\W_]+")

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            known = weights.get
            return pd.Series([float(sum(filter(None, map(known, word.findall(t.lower()))))) if t else 0.0 for t in texts], dtype="float64")

        scored = df.withColumn(f"{target}_score", score(field(text)))
    else:
        scored = phrases.weigh_phrases(df, text, weights, f"{target}_score")
    label = F.when(F.col(f"{target}_score") > 0, "positive").when(F.col(f"{target}_score") < 0, "negative") \
        .otherwise("neutral")
    return scored.withColumn(f"{target}_label", label)


# Entity patterns (common to Java and RE2 syntax).
ENTITY_PATTERNS = {
    "email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
    "url": r"(https?://[^\s<>\"']+)",
    "phone": r"(\+?[0-9]{1,3}[ .-]\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-]?[0-9]{4})",
    "ip": r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})",
    "date": r"([0-9]{4}-[0-9]{2}-[0-9]{2})",
    "money": r"([$€£][0-9][0-9,]*(?:\.[0-9]{2})?)",
}


# a cheap necessary condition for each kind, so that its pattern runs only where it can match
_MARKS = {"email": ["@"], "url": ["://"], "money": ["$", "€", "£"]}


def _may_hold(text: Column, name: str, digits: Column) -> Column:
    if name not in _MARKS:
        return digits
    return any_of([text.contains(m) for m in _MARKS[name]])


def entities(text: Column, types: list[str] | None = None, digits: Column | None = None) -> Column:
    """``array<struct<type,value>>`` of the pattern entities found, by type and then by place in the text.

    ``digits`` tells whether the text holds a digit, when the caller has that already.
    """
    digits = text.rlike("[0-9]") if digits is None else digits

    def found(name: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(ENTITY_PATTERNS[name]), F.lit(1))
        listed = F.transform(hits, lambda v: F.struct(F.lit(name).alias("type"), v.alias("value")))
        return F.when(_may_hold(text, name, digits), listed) \
            .otherwise(F.array().cast("array<struct<type:string,value:string>>"))

    return F.concat(*[found(name) for name in types or list(ENTITY_PATTERNS)])


def enrich_entities(df: DataFrame, text: str, types: list[str] | None = None, target: str = "entities") -> DataFrame:
    flagged = df.withColumn("__digits", field(text).rlike("[0-9]"))
    return flagged.withColumn(target, entities(field(text), types, F.col("__digits"))).drop("__digits")


def enrich_names(df: DataFrame, text: str, names: list[tuple[str, str]], target: str = "names", overlaps: bool = False) -> DataFrame:
    """Add the named entities of a dictionary of (name, type) as ``array<struct<type,value,start,end>>``, by place.

    Names are phrases as in :mod:`phrases`; ``value`` is the text as it stands there. Of a name with several types the
    first counts, unless ``overlaps`` asks for every occurrence: then each of its types is one. Null text has none.
    """
    types: dict[str, list[str]] = {}
    for name, kind in names:
        kinds = types.setdefault(" ".join(phrases.tokens(name)), [])
        if kind not in kinds and (overlaps or not kinds):
            kinds.append(kind)
    automaton, kinds_of = phrases.Automaton(types), list(types.values())
    find = automaton.every if overlaps else automaton.longest

    @F.pandas_udf("array<struct<type:string,value:string,start:int,end:int>>")
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"type": kind, "value": t[start:end], "start": start, "end": end}
                           for number, start, end in sorted(find(t), key=lambda h: h[1:]) for kind in kinds_of[number]]
                          for t in texts], dtype="object")

    return df.withColumn(target, search(field(text)))


# -- models and functions ---------------------------------------------------------------------------------------


def enrich_prediction(df: DataFrame, model, input_fields: list[str], target: str,
                      output: T.DataType | str = "double") -> DataFrame:
    """Score rows with an MLlib model (``transform``) or a loader returning ``predict(pandas) -> series``.

    The loader runs once per worker task and then scores Arrow batches.
    """
    if hasattr(model, "transform"):
        return model.transform(df)

    @F.pandas_udf(output)
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        predict = model()
        for batch in batches:
            yield pd.Series(predict(batch))

    return df.withColumn(target, score(F.struct(*[field(f) for f in input_fields])))


def enrich_by_key(df: DataFrame, key: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                  max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Call ``function`` on batches of distinct keys and join its columns back.

    ``function`` gets a frame with the key column and returns one row per key; ``schema`` must name the key.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = function(batch)
            if found[key].duplicated().any():
                raise ValueError(f"the function returned several rows for one {key!r}")
            yield found

    keys = df.select(field(key)).filter(field(key).isNotNull()).distinct()
    looked_up = keys.mapInPandas(call, schema)
    return skew.join_per_key(df, looked_up, [key], "left", max_group_rows=max_group_rows, null_safe=False)


def enrich_function(df: DataFrame, function: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str,
                    params: dict | None = None) -> DataFrame:
    """Apply a Python function with parameters to Arrow batches of rows."""
    settings = dict(params or {})

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch, settings)

    return df.mapInPandas(call, schema)
