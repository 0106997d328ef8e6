"""Masking, detection and enrichment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions.columns import unnest
from millrace.operators import enrichment, masking, phrases, table_functions
from millrace.operators.masking import Mask, MaskingProfile
from workload.quality import CUSTOMER_NULLS, customer_nulls
from workload.registry import query, table

_SALT = "pepper"


def _hash(text: str) -> str:
    return f"sha256('{_SALT}' || {text})"


def _number(text: str) -> str:
    """First eight hex digits of the keyed digest as a number."""
    digits = " + ".join(
        f"(instr('0123456789abcdef', substr(h, {i}, 1)) - 1) * {16 ** (8 - i)}" for i in range(1, 9))
    return f"(SELECT CAST({digits} AS BIGINT) FROM (SELECT {_hash(text)} AS h))"


def _mask(key: str, source, keep: list[str], masks: dict[str, Mask], sql: str):
    @query(key, sql)
    def run(spark, sf_dir):
        return masking.mask_data(source(spark, sf_dir).select(*keep), masks)

    return run


def _from(name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


_mask("mask_redact", customer_nulls, ["c_custkey", "c_mktsegment"], {"c_mktsegment": Mask("Redact")},
      f"""SELECT c_custkey, CASE WHEN c_mktsegment IS NOT NULL THEN '[REDACTED]' END AS c_mktsegment FROM {CUSTOMER_NULLS}""")
_mask("mask_partial", _from("part"), ["p_partkey", "p_name"],
      {"p_name": Mask("PartialMask", {"start": 2, "end": 6})},
      """SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN repeat('*', length(p_name)) ELSE
         left(p_name, 2) || repeat('*', length(p_name) - 8) || right(p_name, 6) END AS p_name FROM part""")


def _tokenized(name: str, key: str, value: str) -> str:
    """Rounds in which every other character turns within its class by a digest of the rest."""
    rows = f"(SELECT {key}, {value}, string_split({value}, '') AS c0 FROM {name})"
    for r in range(masking.ROUNDS):
        byte = "((instr('0123456789abcdef', substr(h, 2 * ((i - 1) % 32) + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 2 * ((i - 1) % 32) + 2, 1)) - 1)"
        cases = " ".join(f"WHEN instr('{k}', c{r}[i]) > 0 THEN '{k}'[((instr('{k}', c{r}[i]) - 1 + {byte}) % {len(k)} + 1)::INT]" for k in masking.CLASSES)
        others = f"array_to_string([c{r}[i] FOR i IN range(1, len(c{r}) + 1) IF (i - 1) % 2 <> {r % 2}], '')"
        rows = f"""(SELECT {key}, {value}, list_transform(range(1, len(c{r}) + 1), lambda i: CASE WHEN (i - 1) % 2 <> {r % 2}
            OR ord(c{r}[i]) < 48 THEN c{r}[i] {cases} ELSE c{r}[i] END) AS c{r + 1}
          FROM (SELECT *, sha256('{_SALT}|{r}|' || {others}) AS h FROM {rows}))"""
    return f"SELECT {key}, CASE WHEN {value} IS NOT NULL THEN array_to_string(c{masking.ROUNDS}, '') END AS {value} FROM {rows}"


_mask("mask_tokenize", _from("supplier"), ["s_suppkey", "s_name"], {"s_name": Mask("Tokenize", {"salt": _SALT})},
      _tokenized("supplier", "s_suppkey", "s_name"))
_mask("mask_tokenize_text", _from("conversations"), ["conv_id", "turn", "text"], {"text": Mask("Tokenize", {"salt": _SALT})},
      _tokenized("conversations", "conv_id, turn", "text"))
_mask("mask_tokenize_documents", _from("documents"), ["doc_id", "text"], {"text": Mask("Tokenize", {"salt": _SALT})},
      _tokenized("documents", "doc_id", "text"))
_mask("mask_randomize", _from("customer"), ["c_custkey", "c_name"],
      {"c_name": Mask("Randomize", {"salt": _SALT, "domain": ["Ada", "Bo", "Cy", "Di", "Ed"]})},
      f"""SELECT c_custkey, ['Ada', 'Bo', 'Cy', 'Di', 'Ed'][{_number('c_name')} % 5 + 1] AS c_name FROM customer""")
_mask("mask_hash", _from("customer"), ["c_custkey", "c_name"],
      {"c_name": Mask("Hash", {"salt": _SALT, "preserveLength": True})},
      f"SELECT c_custkey, left({_hash('c_name')}, length(c_name)) AS c_name FROM customer")
_mask("mask_date_shift", lambda s, d: table(s, d, "orders").withColumn("o_orderdate", F.to_date("o_orderdate")),
      ["o_orderkey", "o_custkey", "o_orderdate"],
      {"o_orderdate": Mask("DateShift", {"salt": _SALT, "key": "o_custkey", "preserveDay": True})},
      f"""SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) + CAST((-4 + {_number("CAST(o_custkey AS VARCHAR)")} % 9) * 7
          AS INTEGER) AS o_orderdate FROM orders""")


_SHOWN = "CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END"


@query("mask_number_variance", f"""SELECT c_custkey, round(c_acctbal * (1 + (-1e1 + ({_number("shown")}
    % 100001) / 1e5 * 2e1) / 1e2), 9) AS c_acctbal FROM (SELECT c_custkey, c_acctbal, {_SHOWN} AS shown FROM customer)""")
def mask_number_variance(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    out = masking.mask_data(customers, {"c_acctbal": Mask("NumberVariance", {"salt": _SALT})})
    return out.withColumn("c_acctbal", F.round("c_acctbal", 9))


_mask("mask_custom", _from("customer"), ["c_custkey", "c_acctbal"],
      {"c_acctbal": Mask("Custom", {"expression": "floor(c_acctbal / 1000) * 1000"})},
      "SELECT c_custkey, CAST(floor(c_acctbal / 1000) * 1000 AS BIGINT) AS c_acctbal FROM customer")


@query("mask_profile", f"""SELECT c_custkey, left({_hash('c_name')}, length(c_name)) AS c_name,
    '[REDACTED]' AS c_mktsegment FROM customer""")
def mask_profile(spark, sf_dir):
    profile = MaskingProfile("export", {"c_name": Mask("Hash", {"salt": _SALT, "preserveLength": True}),
                                        "c_mktsegment": Mask("Redact")})
    return masking.mask_with_profile(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), profile)


_P = masking.VALUE_PATTERNS
_LUHN = """len(list_filter(list_transform(regexp_extract_all(text, '{card}', 1), lambda r: regexp_replace(r, '[ -]', '', 'g')),
    lambda d: list_sum(list_transform(range(1, length(d) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN CAST(d[length(d) - i + 1] AS INTEGER)
           ELSE (CAST(d[length(d) - i + 1] AS INTEGER) * 2) % 10 + (CAST(d[length(d) - i + 1] AS INTEGER) * 2) // 10 END)) % 10 = 0)) > 0
    """.replace("{card}", masking.CARD_PATTERN)


@query("detect_sensitive", " UNION ALL ".join(
    f"SELECT doc_id, 'text' AS \"column\", '{name}' AS type FROM documents WHERE regexp_matches(text, '{pattern}')"
    for name, pattern in _P.items()) + f" UNION ALL SELECT doc_id, 'text', 'CreditCardNumber' FROM documents WHERE {_LUHN}")
def detect_sensitive(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unnest(masking.detect(documents, columns=["text"]), ["doc_id"], F.col("sensitive"), "type")


@query("suggest_masking", """SELECT unnest(['contact', 'customer_name', 'c_acctbal', 'host']) AS "column",
    unnest(['EmailAddress', 'PersonName', 'FinancialData', 'IpAddress']) AS type,
    unnest(['Tokenize', 'Tokenize', 'NumberVariance', 'Hash']) AS mask,
    unnest([CAST(1.0 AS DOUBLE), 0.0, 0.0, (SELECT count(*) FILTER (WHERE c_custkey % 10 <> 0) / count(*) FROM customer)]) AS hit_rate""")
def suggest_masking(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "concat('user', c_custkey, '@example.com') AS contact", "c_name AS customer_name", "c_acctbal",
        "IF(c_custkey % 10 = 0, 'unknown', concat('10.0.', c_nationkey, '.', c_custkey % 250)) AS host",
        "c_mktsegment AS segment")
    return masking.suggest(customers)


# -- enrichment -------------------------------------------------------------------------------------------------

def _calc(key: str, source, keep: list[str], spec: dict, sql: str):
    @query(key, sql)
    def run(spark, sf_dir):
        return enrichment.enrich_calculated(source(spark, sf_dir), "x", **spec).select(*keep, "x")

    return run


_calc("calc_sum", customer_nulls, ["c_custkey"], {"kind": "Sum", "fields": ["c_acctbal", "c_nationkey"]},
      f"SELECT c_custkey, coalesce(c_acctbal, 0) + c_nationkey AS x FROM {CUSTOMER_NULLS}")
_calc("calc_avg", customer_nulls, ["c_custkey"], {"kind": "Average", "fields": ["c_acctbal", "c_nationkey"]},
      f"SELECT c_custkey, coalesce((c_acctbal + c_nationkey) / 2, c_nationkey) AS x FROM {CUSTOMER_NULLS}")
_calc("calc_concat", customer_nulls, ["c_custkey"],
      {"kind": "Concatenate", "fields": ["c_name", "c_mktsegment", "c_nationkey"], "params": {"separator": "|"}},
      f"SELECT c_custkey, concat_ws('|', c_name, c_mktsegment, c_nationkey) AS x FROM {CUSTOMER_NULLS}")


@query("calc_datediff", """SELECT l_orderkey, l_linenumber, l_partkey,
    CAST(datediff('day', o_orderdate, l_shipdate) AS INTEGER) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def calc_datediff(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return enrichment.enrich_calculated(joined, "x", "DateDiff", fields=["l_shipdate", "o_orderdate"]) \
        .select("l_orderkey", "l_linenumber", "l_partkey", "x")


_calc("calc_expression", _from("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"],
      {"kind": "Expression", "expression": "round(l_extendedprice * (1 + l_tax), 4)"},
      "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 + l_tax), 4) AS x FROM lineitem")
_calc("calc_custom", _from("orders"), ["o_orderkey"],
      {"kind": "Custom", "expression": "CASE WHEN o_totalprice > :limit THEN :high ELSE :low END",
       "params": {"limit": 200000, "high": "it's high", "low": "low"}},
      "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'it''s high' ELSE 'low' END AS x FROM orders")

# words of the generated corpus with invented weights
LEXICON = {"the": 0.5, "of": -1.0, "and": 1.0, "is": 2.0, "un": -0.5, "est": 1.5, "der": -2.0, "ist": 1.0, "el": 0.5}


@query("enrich_sentiment", """WITH hits AS (SELECT doc_id, unnest(regexp_extract_all(
      regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), '[\\p{L}\\p{N}]+')) AS word FROM documents),
    lexicon(word, weight) AS (VALUES ('the', 0.5), ('of', -1.0), ('and', 1.0), ('is', 2.0), ('un', -0.5), ('est', 1.5),
      ('der', -2.0), ('ist', 1.0), ('el', 0.5)),
    s AS (SELECT doc_id, CAST(sum(weight) AS DOUBLE) AS score FROM hits JOIN lexicon USING (word) GROUP BY doc_id)
    SELECT doc_id, coalesce(score, 0) AS sentiment_score, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative'
      ELSE 'neutral' END AS sentiment_label FROM documents LEFT JOIN s USING (doc_id)""")
def enrich_sentiment(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return enrichment.enrich_sentiment(documents, "text", LEXICON).drop("text")


_E = enrichment.ENTITY_PATTERNS


@query("enrich_entities", " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS type, unnest(regexp_extract_all(text, '{pattern}', 1)) AS value FROM documents"
    for name, pattern in ((n, p.replace("'", "''")) for n, p in _E.items())))
def enrich_entities(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unnest(enrichment.enrich_entities(documents, "text"), ["doc_id"], F.col("entities"), "type")


_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s\p{Z}\x0b\x1c-\x1f\x85]"
_PHRASE = 4  # tokens


@query("enrich_names", f"""WITH tokens AS (
      SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '{_TOKEN}') AS w FROM documents
      UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(text), '{_TOKEN}') FROM benchmark),
    windows AS (SELECT side, id, unnest(list_transform(range(1, len(w) - {_PHRASE - 2}),
      lambda i: array_to_string(w[i:i + {_PHRASE - 1}], ' '))) AS phrase FROM tokens WHERE len(w) >= {_PHRASE}),
    names AS (SELECT DISTINCT id, phrase FROM windows WHERE side = 'b')
    SELECT d.id AS doc_id, CAST(n.id AS VARCHAR) AS type, count(*) AS hits
    FROM windows d JOIN names n USING (phrase) WHERE d.side = 'd' GROUP BY ALL""")
def enrich_names(spark, sf_dir):
    """Every occurrence in the documents of each four-token phrase of a benchmark passage; the passage is its type."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0))
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("type"), words.alias("w"))
    windows = F.expr(f"transform(sequence(1, size(w) - {_PHRASE - 1}), i -> array_join(slice(w, i, {_PHRASE}), ' '))")
    names = passages.filter(F.size("w") >= _PHRASE).select(F.explode(windows).alias("name"), "type")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = enrichment.enrich_names(documents, "text", phrases.lexicon(names, ["name", "type"]), overlaps=True)
    return unnest(found, ["doc_id"], F.col("names"), "type").groupBy("doc_id", "type").agg(F.count("*").alias("hits"))


def _linear_model():
    """Loader of a small linear model; runs once per task."""
    weights = {"l_quantity": 0.5, "l_discount": -20.0, "l_tax": 4.0}
    return lambda batch: sum(batch[name] * w for name, w in weights.items()) + 1.0


@query("enrich_ml_prediction", """SELECT l_orderkey, l_linenumber, l_partkey,
    round(l_quantity * 0.5 - l_discount * 20 + l_tax * 4 + 1, 4) AS score FROM lineitem""")
def enrich_ml_prediction(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    scored = enrichment.enrich_prediction(lines, _linear_model, ["l_quantity", "l_discount", "l_tax"], "score")
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 4).alias("score"))


def _rate(batch: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for an outside service: one answer per distinct key."""
    return batch.assign(rate=batch["o_custkey"] % 7 + 0.5)


@query("enrich_by_key", "SELECT o_orderkey, o_custkey, o_custkey % 7 + 0.5::DOUBLE AS rate FROM orders")
def enrich_by_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return enrichment.enrich_by_key(orders, "o_custkey", _rate, "o_custkey bigint, rate double")


def _shout(batch: pd.DataFrame, params: dict) -> pd.DataFrame:
    return batch.assign(p_name=batch["p_name"].str.upper() + params["suffix"])


@query("enrich_function", "SELECT p_partkey, upper(p_name) || '!' AS p_name FROM part")
def enrich_function(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return enrichment.enrich_function(parts, _shout, "p_partkey bigint, p_name string", {"suffix": "!"})


@query("udtf_sessions", """WITH RECURSIVE e AS (
      SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT user_id, ts, n, ts AS session_start FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.ts, e.n, CASE WHEN e.ts - s.ts > INTERVAL 6 HOUR
        OR e.ts - s.session_start > INTERVAL 12 HOUR THEN e.ts ELSE s.session_start END
      FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT user_id, session_start, count(*) AS events, max(ts) AS session_end FROM s GROUP BY ALL""")
def udtf_sessions(spark, sf_dir):
    """Sessions of each user that end after six hours of silence, and never last more than twelve."""
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    found = table_functions.sessions(events, ["user_id"], "ts", 6 * 3600, 12 * 3600)
    return found.groupBy("user_id", "session_start").agg(F.count("*").alias("events"), F.max("ts").alias("session_end"))


@query("udtf_linear_models", """WITH d AS (SELECT source, n_chars AS y, len(string_split(text, ' ')) AS a,
      len(text) - len(replace(text, 'e', '')) AS b FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL),
    m AS (SELECT source, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab,
      covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS b_y, covar_pop(y, y) AS yy FROM d GROUP BY source),
    c AS (SELECT *, (bb * ay - ab * b_y) / nullif(aa * bb - ab * ab, 0) AS ca, (aa * b_y - ab * ay) / nullif(aa * bb - ab * ab, 0) AS cb FROM m)
    SELECT source, n, round(my - ca * ma - cb * mb, 3) AS intercept, round((ca * ay + cb * b_y) / nullif(yy, 0), 6) AS r2,
      round(ca, 6) AS coef_words, round(cb, 6) AS coef_e FROM c""")
def udtf_linear_models(spark, sf_dir):
    """Of each source, the length of a document explained by its words and its letters e."""
    documents = table(spark, sf_dir, "documents").select(
        "source", "n_chars", F.size(F.split("text", " ", -1)).alias("words"),
        (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).alias("e"))
    models = table_functions.linear_models(documents, ["source"], "n_chars", ["words", "e"])
    return models.select("source", "n", F.round("intercept", 3).alias("intercept"), *[
        F.round(c, 6).alias(c) for c in ("r2", "coef_words", "coef_e")])
