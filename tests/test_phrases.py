"""Phrase automaton against a search at every place."""

from __future__ import annotations

import random
import time

import pytest

from millrace.operators import enrichment, phrases
from tests.conftest import rows


def plain_every(words: list[str], lexicon: list[str]) -> set[tuple[int, int, int]]:
    """Occurrences in a text of one-letter words with one blank between them."""
    found, seen = set(), set()
    for number, phrase in enumerate(lexicon):
        parts = phrase.split()
        if not parts or tuple(parts) in seen:
            continue
        seen.add(tuple(parts))
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                found.add((number, 2 * i, 2 * (i + len(parts)) - 1))
    return found


def test_every_occurrence():
    draw = random.Random(3)
    for _ in range(300):
        lexicon = [" ".join(draw.choices("abc", k=draw.randint(0, 5))) for _ in range(draw.randint(0, 12))]
        words = draw.choices("abcd", k=draw.randint(0, 40))
        automaton, text = phrases.Automaton(lexicon), " ".join(words)
        found = automaton.every(text)
        assert len(found) == len(set(found)) and set(found) == plain_every(words, lexicon)
        assert [(h[2], h[1]) for h in found] == sorted((h[2], h[1]) for h in found)
        chosen, past = [], 0
        for hit in sorted(plain_every(words, lexicon), key=lambda h: (h[1], -h[2])):
            if hit[1] >= past:
                chosen.append(hit)
                past = hit[2]
        assert automaton.longest(text) == chosen


def test_tokens_and_places():
    automaton = phrases.Automaton(["not good", "c++", "don't", "İz", "not", "", "  "])
    text = "Not\n good, C++ Don't notgood İZ İz"
    assert [(p, text[s:e]) for p, s, e in automaton.longest(text)] == [(0, "Not\n good"), (1, "C++"), (2, "Don't"), (3, "İZ"), (3, "İz")]
    assert automaton.every(None) == automaton.every("") == [] and phrases.Automaton([]).longest("a b") == []


def test_a_large_lexicon_costs_no_more():
    """The text is read once: 50,000 phrases, and phrases that fail late, take about as long as 50."""
    draw = random.Random(5)
    text = " ".join(draw.choices("ab", k=100_000))
    few = phrases.Automaton([" ".join(draw.choices("abc", k=8)) for _ in range(50)])
    many = phrases.Automaton([" ".join(draw.choices("abc", k=12)) + " z" for _ in range(50_000)] + ["a " * 400 + "z"])
    times = []
    for automaton in (few, many):
        start = time.process_time()
        automaton.every(text)
        times.append(time.process_time() - start)
    assert times[1] < 8 * times[0] + 0.5


def test_a_lexicon_beyond_its_bound_is_refused(spark):
    with pytest.raises(ValueError, match="more than 3 tokens"):
        phrases.Automaton(["a b", "c d"], max_tokens=3)
    with pytest.raises(ValueError, match="more than 4 rows"):
        phrases.lexicon(spark.range(5), ["id"], max_phrases=4)
    assert phrases.lexicon(spark.createDataFrame([("b", 1), (None, 2), ("b", 1)], "p string, n int"), ["p", "n"]) == [(None, 2), ("b", 1)]


def test_names_in_texts(spark):
    texts = spark.createDataFrame([(1, "In New  York City, new york."), (2, None), (3, ""), (4, "Yorkshire")], "id int, names string")
    places = [("New York", "state"), ("new york", "city"), ("new york city", "city"), ("york city", "club")]
    out = enrichment.enrich_names(texts, "names", places, "found")
    assert rows(out.selectExpr("id", "inline(found)")) == [(1, "city", "New  York City", 3, 17), (1, "state", "new york", 19, 27)]
    every = enrichment.enrich_names(texts, "names", places, "found", overlaps=True).selectExpr("id", "inline(found)").collect()
    assert [tuple(r)[1:] for r in every] == [
        ("state", "New  York", 3, 12), ("city", "New  York", 3, 12), ("city", "New  York City", 3, 17), ("club", "York City", 8, 17),
        ("state", "new york", 19, 27), ("city", "new york", 19, 27)]
    assert enrichment.enrich_names(texts, "names", [], "found").selectExpr("inline(found)").isEmpty()


def test_sentiment_of_phrases(spark):
    texts = spark.createDataFrame([(1, "Not  good, but good."), (2, None), (3, "goods")], "id int, t string")
    out = enrichment.enrich_sentiment(texts, "t", {"not good": -3.0, "good": 1.0})
    assert rows(out, "id", "sentiment_score", "sentiment_label") == [(1, -2.0, "negative"), (2, 0.0, "neutral"), (3, 0.0, "neutral")]
