"""Questions that visit one cell are dealt into blocks, and no answer changes."""

from __future__ import annotations

from millrace.llm import neighbours
from millrace.llm.queries import QUERIES


def test_blocks_are_bounded_and_meet_every_entry(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUESTIONS", 20)
    entries = spark.range(30).selectExpr("id AS e", "id % 3 AS cell")
    questions = spark.range(400).selectExpr("xxhash64(id) AS h1", "id AS h2", "CASE WHEN id < 390 THEN 0L ELSE 1L END AS cell")
    repeated, dealt = neighbours._dealt(entries, questions)
    sizes = {(r.cell, r.part): r["count"] for r in dealt.groupBy("cell", "part").count().collect()}
    assert len(sizes) == 21 and sum(sizes.values()) == 400 and max(sizes.values()) <= 40
    met = repeated.join(dealt, ["cell", "part"])
    assert met.count() == met.select("e", "h2").distinct().count() == 400 * 10


def test_results_do_not_depend_on_question_blocks(spark, sf, monkeypatch):
    order = ["query_id", "rank"]
    whole = [tuple(r) for r in QUERIES["op2_neighbours"](spark, sf).orderBy(*order).collect()]
    monkeypatch.setattr(neighbours, "QUESTIONS", 3)
    assert [tuple(r) for r in QUERIES["op2_neighbours"](spark, sf).orderBy(*order).collect()] == whole
