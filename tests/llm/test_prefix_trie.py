"""The prefix trie against one built turn by turn in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from millrace.llm import prefix_trie
from millrace.llm.queries import QUERIES, rebuilt


def plain_rebuilt(rows):
    """{conv_id: [(role, text)]} of rows (conv_id, turn, role, text) by the rule of the query."""
    original: dict[int, list] = {}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r[2], r[3])))
    for conv, _, role, text in order:
        original.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = original.get(c - c % 5, [])[:h] + own[h:]
    return out


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain_trie(convs):
    members: dict[tuple, list] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, list] = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])),
                    leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def collected(df):
    assert df.columns == COLUMNS and [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query(spark, sf, size):
    sf = sf.replace("0.001", size)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op13_prefix_trie"](spark, sf)) == plain_trie(plain_rebuilt(rows))


def made(seed, convs=40, longest=12):
    """Conversations of few different turns, so that many share long openings, are equal or are prefixes of others."""
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(60), convs):
        for t in range(draw.choice([1, 2, 3, longest])):
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["u", "u", "", None]), draw.choice(["a", "a", "a", "ü", None, ""])))
    return rows + [(None, 1, "u", "lost"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_made_conversations(spark, seed):
    rows = made(seed)
    frame = spark.createDataFrame(rows, SCHEMA)
    found = prefix_trie.trie(*rebuilt(prefix_trie.turns_of(frame)))
    assert collected(found) == plain_trie(plain_rebuilt(rows))


def test_groups_beyond_a_task(spark, monkeypatch):
    """With tiny limits every conversation, prefix and end list is split; the nodes are the same."""
    monkeypatch.setattr(prefix_trie, "ENDS", 3)
    rows = [(c, t, "u", "x" * (t + 1)) for c in range(30) for t in range(3)] + [(99, t, "u", f"{t}") for t in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns = prefix_trie.turns_of(frame, max_group_rows=10)
    convs = frame.select("conv_id").distinct()
    plain = {c: [(r[2], r[3]) for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    assert collected(prefix_trie.trie(turns, convs, max_group_rows=10)) == plain_trie(plain)


def test_defined_cases(spark):
    """Other columns, turnless conversations, a very long text, names that are no boundary, an empty table."""
    long = "w " * 500_000
    rows = [(1, 1, "u", long, 1), (2, 1, "u", long, 2), (2, 2, "a", "b", 3), (3, 1, "ua", "b", 4), (4, 1, "u", "ab", 5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name int")
    convs = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 7, 8)], "conv_id long")
    plain = {c: [(r[2], r[3]) for r in rows if r[0] == c] for c in (1, 2, 3, 4, 7, 8)}
    assert collected(prefix_trie.trie(prefix_trie.turns_of(frame), convs)) == plain_trie(plain)
    none = spark.createDataFrame([], SCHEMA)
    assert collected(prefix_trie.trie(*rebuilt(prefix_trie.turns_of(none)))) == []
    alone = prefix_trie.trie(prefix_trie.turns_of(none), convs)
    assert collected(alone) == plain_trie({c: [] for c in (1, 2, 3, 4, 7, 8)})
