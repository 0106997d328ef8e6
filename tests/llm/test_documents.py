"""SimHash, personal data, languages, quality, neighbours, urls and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import components, language, neighbours, pii, quality, simhash, urls
from millrace.llm.queries import QUERIES, RULES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=3):
    """Smallest position reachable by links, by trying every pair."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def test_simhash_query(spark, sf, docs):
    found = {r.doc_id: r for r in QUERIES["op3_simhash"](spark, sf).collect()}
    docs = docs.sort_values("doc_id")
    prints = [plain_fingerprint(t) for t in docs["text"]]
    ids = docs["doc_id"].tolist()
    for doc_id, own, least in zip(ids, prints, plain_components(prints)):
        assert (found[doc_id].fingerprint, found[doc_id].component_id) == (f"{own:016x}", ids[least])


def test_simhash_edges(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (9, "a b"), (2, "A B"), (None, "a b"), (7, "x y z x y z"), (7, "x y z x y z"), (None, "alone here now")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS Fingerprint", "1 AS __other")
    found = sorted(((r.doc_id, r.component_id, r.fingerprint) for r in simhash.near_duplicates(frame).collect()), key=str)
    expected = [(i, {5: 3, 4: 3, 3: 3, 9: 2, 2: 2, 7: 7}.get(i, 2 if t == "a b" else None), f"{plain_fingerprint(t):016x}") for i, t in rows]
    assert found == sorted(expected, key=str)
    assert sorted(str(r.doc_id) for r in simhash.keep_first(frame).collect()) == ["2", "3", "7", "None"]
    assert simhash.near_duplicates(frame.limit(0)).count() == 0 and simhash.keep_first(frame.limit(0)).count() == 0


def test_keys_cover_every_near_pair():
    draw = np.random.default_rng(1)
    masks = simhash.key_masks()
    finer = simhash.finer_masks(masks[0])
    for _ in range(300):
        flips = sum(1 << int(b) for b in draw.choice(64, 3, replace=False))
        assert any(not flips & m for m in masks)
        if not flips & masks[0]:
            assert any(not flips & m for m in finer)


@pytest.mark.parametrize("large", [2, 2048])
def test_links_connect_what_all_pairs_do(spark, large):
    """A dense group, chains and noise, with keys refined or not."""
    draw = np.random.default_rng(2)
    centre = int(draw.integers(0, 2**63))
    prints = {centre ^ sum(1 << int(b) for b in draw.choice(20, k, replace=False)) for k in range(5) for _ in range(30)}
    chain = int(draw.integers(0, 2**63))
    for _ in range(30):
        chain ^= sum(1 << int(b) for b in draw.choice(64, 3, replace=False))
        prints.add(chain)
    prints = sorted(prints | {int(x) for x in draw.integers(0, 2**63, 100)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "f long")
    edges = simhash.links(frame, large=large)
    grouped = {r.node: r.component for r in components.components(edges).collect()}
    mine = [grouped.get(p, p) for p in prints]
    assert [mine.index(c) for c in mine] == plain_components(prints)


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i + 1, i) for i in range(10, 40)] + [(100, i) for i in range(101, 130)] + [(7, 8), (8, 9), (9, 7), (5, 5), (None, 3), (8, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 130)}, 7: 7, 8: 7, 9: 7}


# Personal data


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [f"{pii.BASE[k]}:{a}:{b}" for a, k, b in sorted(out)]


HARD = ["a@b.c@d.e f@g.h", "x" * 300 + "@y.zz", "aa@ b@c d@e.f.", "..%+@a.b-c.d", "é.x@q.w", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4",
        "4111 1111 1111 1111-", "4111-1111-1111-11112", "+1 (212) 555-0951.", "+1+12345678901", "+12 " + "3" * 14, "1" * 400,
        "user@h.i4111111111111111", "@@@", "a@b..c a@b.-", "12345678901234567890", "٣@a.b +١٢٣"]


@pytest.mark.parametrize("text", HARD)
def test_base_spans_on_hard_texts(text):
    assert [f"{s.kind}:{s.start}:{s.end}" for s in pii.find(text) if s.kind in pii.BASE] == plain_base(text)


def test_base_spans_on_random_texts():
    draw = np.random.default_rng(3)
    for _ in range(4000):
        text = "".join(draw.choice(list("a1@.-+ 4%(") , draw.integers(1, 60)))
        assert [f"{s.kind}:{s.start}:{s.end}" for s in pii.find(text) if s.kind in pii.BASE] == plain_base(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "+1" + " " * 300_000, "a." * 100_000 + "@" + "b-" * 100_000, "@a" * 100_000):
        pii.find(text)


def test_added_kinds_need_a_checksum_or_context():
    kinds = lambda t: [s.kind for s in pii.find(t)]
    assert kinds("Pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"] and kinds("GB82 WEST 1234 5698 7654 33") == []
    assert kinds("SSN: 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("call (212) 555-0951") == ["tel"] and kinds("of (212) 555-0951") == []
    assert pii.redact("mail a@b.cc or +1 (212) 555-0951!", pii.find("mail a@b.cc or +1 (212) 555-0951!")) == "mail [EMAIL] or [PHONE]!"


def test_pii_query(spark, sf, docs):
    texts = dict(zip(docs["doc_id"], docs["text"]))
    for r in QUERIES["op5_pii"](spark, sf).collect():
        expected = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(e.startswith(k + ":") for e in expected) for k in pii.BASE]
        assert set(expected) <= set(r.spans.split(","))  if expected else True


def test_pii_frames(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "a@b.cc"), (3, "a@b.cc")], "doc_id long, text string").selectExpr("*", "1 AS SPANS")
    assert sorted(len(r.spans) for r in pii.find_spans(frame).collect()) == [0, 0, 1, 1]
    redacted = pii.redact_texts(frame)
    assert redacted.columns == frame.columns and sorted(str(r.text) for r in redacted.collect()) == ["", "None", "[EMAIL]", "[EMAIL]"]
    assert pii.find_spans(frame.limit(0)).count() == 0


# Languages


def test_language_query_on_held_out_documents(spark, sf):
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op7_language"](spark, sf).join(lang, "doc_id").filter("held_out").toPandas()
    assert len(found) > 20 and (found["lang_pred"] == found["lang"]).mean() > 0.9
    assert found["score"].between(0, 1).all()


def test_language_mixtures_and_edges(spark, docs):
    frame = spark.createDataFrame(docs[["text", "lang"]])
    model = language.train(frame)
    by = docs[docs["text"].str.len() > 2000].groupby("lang")["text"].first()
    mixed = model.proportions(by["en"][:2000] + "\n" + by["de"][:1000])
    assert set(mixed) == {"en", "de"} and 0.55 < mixed["en"] < 0.8
    assert set(model.proportions(by["fr"])) == {"fr"}
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, by["en"]), (4, by["en"])], "doc_id long, text string").selectExpr("*", "0 AS Score")
    assert [(r.lang_pred, r.score > 0.9) for r in language.identify(rows, model).orderBy("doc_id").collect()] == \
        [("und", False)] * 3 + [("en", True)] * 2
    empty = language.train(frame.limit(0))
    assert [r.lang_pred for r in language.identify(rows, empty).collect()] == ["und"] * 5


def test_slope_bounds_what_a_language_can_add():
    """Documents that the first step settles gain no more by iterating."""
    draw = np.random.default_rng(4)
    for _ in range(50):
        chance = draw.random((200, 2)).astype(np.float32) + 0.01
        slope = float((chance[:, 1] / chance[:, 0]).sum() - 200)
        _, reached = language.LanguageModel._fit(chance)
        assert reached - np.log(chance[:, 0]).sum() <= max(slope, 0) + 1e-3


# Quality


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("text", [None, "", " \n ", "a b c", "a b c a b c", "x x x x x", "a\na\n\n b\nb \n b", "é\u00a0z é\u00a0z # | <", "a b c d " * 40])
def test_statistics(text):
    assert quality.statistics(text)[0] == plain_statistics(text)


def test_quality_query(spark, sf, docs):
    texts = dict(zip(docs["doc_id"], docs["text"]))
    found = QUERIES["op8_quality"](spark, sf).toPandas()
    for r in found.itertuples():
        base = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        if len(texts[r.doc_id]) < 20_000:
            assert base == plain_statistics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_trees_on_held_out_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    judged = quality.judge(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), trees).filter("n_words >= 50").toPandas()
    assert ((judged["score"] >= 0.5) == (judged["quality"] == 1)).mean() > 0.95
    assert judged[judged["quality"] == 1]["kept"].mean() > 0.95


def test_trees_are_monotonic_and_flat_scores_are_the_trees():
    draw = np.random.default_rng(5)
    features = draw.random((800, 3))
    labels = (features[:, 0] + 0.1 * draw.standard_normal(800) > 0.5).astype(float)
    trees = quality.grow(features, labels, [1, -1, 0], trees=20)
    grid = np.linspace(0, 1, 50)
    for fixed in draw.random((20, 3)):
        rows = np.repeat(fixed[None], 50, axis=0)
        rows[:, 0] = grid
        assert (np.diff(trees.score(rows)) >= -1e-12).all()
        rows[:, 0], rows[:, 1] = fixed[0], grid
        assert (np.diff(trees.score(rows)) <= 1e-12).all()
    assert ((trees.score(features) > 0.5) == (labels == 1)).mean() > 0.8
    assert np.allclose(quality.grow(features, np.ones(800), [0, 0, 0]).score(features), 1 - 1e-4)


def test_quality_edges(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (None, "word " * 60), (4, " ".join(map(str, range(90))))], "doc_id long, text string") \
        .selectExpr("*", "true AS Kept")
    labels = spark.createDataFrame([(None, 1), (4, None), (4, 1)], "doc_id long, quality int")
    judged = quality.judge(frame, quality.train(frame, labels)).toPandas()
    assert judged["kept"].tolist() == [False, False, False, True] and quality.judge(frame.limit(0), quality.train(frame, labels.limit(0))).count() == 0


# Neighbours


def exact_neighbours(ids, vectors, asked, k):
    products = [(vectors * vectors[ids.index(q)]).sum(axis=1) for q in asked]
    return {q: sorted(((-p, i) for p, i in zip(row, ids) if i != q))[:k] for q, row in zip(asked, products)}


@pytest.mark.parametrize("cell", [60, 4000])
def test_neighbours_recall(spark, sf, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL", cell)
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, vectors = table["vec_id"].tolist(), np.stack(table["embedding"]).astype(np.float64)
    asked = [i for i in ids if i % 20 == 0]
    found = QUERIES["op2_neighbours"](spark, sf).toPandas()
    best = exact_neighbours(ids, vectors, asked, 20)
    assert len(found) == 20 * len(asked)
    hits = sum(len({i for _, i in best[q]} & set(own["vec_id"])) for q, own in found.groupby("query_id"))
    assert hits >= 0.9 * 20 * len(asked)
    for q, own in found.sort_values("rank").groupby("query_id"):
        assert own["rank"].tolist() == list(range(1, 21))
        pairs = list(zip(-own["score"], own["vec_id"]))
        assert pairs == sorted(pairs) and np.allclose(own["score"], [vectors[ids.index(i)] @ vectors[ids.index(q)] for i in own["vec_id"]])


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (10, [-1.0, 0.5]), (11, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS h1", "2 AS cell")
    found = {}
    for r in neighbours.search(frame, frame, 3).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == {0: [(1, 1.0), (2, 1.0), (3, 0.0)], 1: [(0, 1.0), (2, 1.0), (3, 0.0)], 2: [(0, 1.0), (1, 1.0), (3, 0.0)],
                     3: [(10, 1.0), (0, 0.0), (1, 0.0)], 10: [(3, 1.0), (0, -1.0), (1, -1.0)]}
    assert neighbours.search(frame.limit(0), frame, 3).count() == 0 and neighbours.search(frame, frame.limit(0), 3).count() == 0


def test_chi_square_quantile():
    drawn = (np.random.default_rng(6).standard_normal((200_000, 16)) ** 2).sum(axis=1)
    assert abs((drawn <= neighbours.chi_square_quantile(0.95, 16)).mean() - 0.95) < 0.005


# Urls


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


def test_url_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    found = QUERIES["op6_url_filters"](spark, sf).join(pages, "page_id").collect()
    assert len(found) == pages.count()
    for r in found:
        host, path, rule = plain_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        assert r.verdict == (rule.verdict if rule else "block" if r.block_score > 0 else "allow")


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme.com/"), (4, "http://EXAMPLE.com/en/x?y"), (5, "x://com/"), (6, "http://a.com"), (7, "http://É.NET/fr/"),
            (8, "http://www.example.com/en/"), (9, "http://cheappills.org/" + "a" * 300), (10, "a://b://c.com/"), (11, "http://" + "z" * 100 + ".org/1"), (11, "http:///x")]
    frame = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS Host", "1 AS token")
    words = spark.createDataFrame([("cheap", 9), ("pills", 7), ("che", 2)], "word string, n long")
    found = urls.judge(frame, RULES, words).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, rule = plain_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text) and r.verdict in ("allow", "block")
    assert next(r.host_words for r in found if r.page_id == 9) == ["cheap", "pills", "org"]
    assert urls.judge(frame.limit(0), RULES, words.limit(0)).count() == 0


def test_best_split_is_the_most_likely():
    counts = {"the": 50, "re": 20, "th": 5, "there": 1}
    assert urls.best_split("there", counts, 76) == ["the", "re"] and urls.best_split("", counts, 76) == []
    assert urls.best_split("zz", {}, 0) == ["zz"]


def test_naive_bayes_score(spark):
    """Two urls that no rule fits, by hand."""
    rules = [urls.Rule("allow", "com"), urls.Rule("block", "net")]
    frame = spark.createDataFrame([("http://good.com/a",), ("http://bad.net/b",), ("http://bad.org/b",), ("http://good.org/a",)], "url string")
    found = {r.url: r.verdict for r in urls.judge(frame, rules, spark.createDataFrame([], "word string, n long")).collect()}
    assert found["http://bad.org/b"] == "block" and found["http://good.org/a"] == "allow"


# Pipeline


def test_pipeline_against_plain_stages(spark, sf, docs):
    """Each stage's rows against its rule applied in plain Python to what the stage before kept."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    frame, kept = spark.read.parquet(f"{sf}/documents.parquet"), docs.sort_values("doc_id")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "quality", "near_copies", "personal_data", "packing"]
    for name in ("language", "quality", "near_copies", "personal_data"):
        frame = spark.createDataFrame(steps[name](spark, frame, sf).toPandas(), frame.schema)
        mine = frame.orderBy("doc_id").toPandas()
        assert list(mine.columns) == list(docs.columns)
        if name == "near_copies":
            least = plain_components([plain_fingerprint(t) for t in kept["text"]])
            assert mine["doc_id"].tolist() == [d for i, (d, c) in enumerate(zip(kept["doc_id"], least)) if i == c]
        if name == "personal_data":
            assert mine["text"].tolist() == [pii.redact(t, pii.find(t)) for t in kept["text"]]
            assert mine["n_chars"].tolist() == mine["text"].str.len().tolist()
        if name == "language":
            assert len(mine) > 0.95 * len(docs)
        if name == "quality":
            good = set(labels[labels["quality"] == 1]["doc_id"]) & {d for d, t in zip(kept["doc_id"], kept["text"]) if len(t.split()) >= 60}
            assert len(good & set(mine["doc_id"])) > 0.9 * len(good) and (mine["text"].str.split().str.len() >= 50).all()
        kept = mine
    packed = steps["packing"](spark, frame, sf).toPandas()
    assert set(packed["doc_id"]) == set(kept["doc_id"]) and (packed.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_pipeline_on_an_empty_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    empty = spark.createDataFrame([], frame.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_keeps_columns_of_any_name(spark, sf):
    """Columns named like those that operators add come back unchanged from every stage but the last."""
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    frame = frame.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in (
        "score", "kept", "lang_pred", "__row", "__fp", "__piece", "features", "n_words", "doc_0", "a.b")])
    clean = frame.withColumn("text", F.regexp_replace("text", r"[0-9@+]", "x")) \
        .withColumn("n_chars", F.length("text").cast("long"))  # nothing to redact
    before = {r.doc_id: r for r in clean.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clean, sf)
        assert out.schema.simpleString() == clean.schema.simpleString(), name
        rows = out.collect()
        assert rows and all(r == before[r.doc_id] for r in rows), name
