"""Byte-level BPE, word tokens, packing, token files and rollups against the libraries and plain versions."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, packing, rollups, token_files
from millrace.llm.queries import QUERIES, RANKS, WORDS
from millrace.llm.words import WordTokenizer
from millrace.session import new_folder

ODD = ["", " ", "\n", "a" * 700, "é" * 3000, " \n\n x", "it's we'll " * 300, "word\n\n  two   three\tfour\x00five '",
       "'" * 900 + "re", ("x" * 8191 + "'re") * 2, " " * 3000 + "a", "日本語" * 900, "123 456" * 400, "<|endoftext|> x",
       "\x1c a b", "Σας ΣΑΣ", "İstanbul", "é a ́", "a\x85b", "_a_b's 12's", "x y z"]


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.fixture(scope="module")
def known():
    ranks = bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return library, bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)


@pytest.fixture()
def documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (300, "a b c"), (300, "a b c"), (200, "word " * 9000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("text", ODD)
def test_bpe_equals_the_library(known, text):
    library, own = known
    assert ids_of(own.encode(text)) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_bpe_joins_small_halves(known, monkeypatch):
    """With tiny leaves every text is joined many times, between and inside matches."""
    library, _ = known
    monkeypatch.setattr(bpe, "LEAF_CHARS", 8)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 4)
    own, draw = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(1500):
        text = "".join(draw.choice(" \n\t'sreéX1!a thing") for _ in range(draw.randint(1, 200)))
        assert ids_of(own.encode(text)) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_on_any_text(known, text):
    library, own = known
    assert ids_of(own.encode(text)) == library.encode_ordinary(text)


def test_bpe_long_merge_equals_short(known):
    _, own = known
    draw = random.Random(2)
    for _ in range(50):
        piece = bytes(draw.choice(b"aeinrst") for _ in range(draw.randint(10, 64)))
        assert own.merge(piece) == own._merge_long(piece)


def test_bpe_frames(spark, documents, known):
    library, _ = known
    extra = documents.selectExpr("*", "1 AS IDS", "2 AS n_tokens")
    for row in bpe.round_trip(extra, RANKS, public_tokenizers.PATTERN).collect():
        ids = library.encode_ordinary(row["text"] or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
    coded = bpe.decode(bpe.encode(extra, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in coded.collect())
    assert bpe.encode(documents.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_words_equal_the_library(sf):
    own, library = WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    for text in ODD:
        assert ids_of(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert own.encode(None) == b""


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_words_on_any_text(text):
    assert ids_of(_words().encode(text)) == _words().library.encode(text, add_special_tokens=False).ids


def _words(cache=[]):  # noqa: B006
    if not cache:
        cache.append(WordTokenizer(WORDS))
    return cache[0]


def tightest(lengths, window):
    """Best-fit decreasing by trying every open window."""
    left, filled = [], 0
    for need in sorted(lengths, reverse=True):
        fits = [x for x in left if x >= need]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - need)
        else:
            filled += 1
            left.append(window - need)
    return filled


def test_best_fit_decreasing_is_the_plain_one():
    draw = random.Random(3)
    for window in (1, 7, 64, 100):
        for _ in range(50):
            lengths = [draw.randint(1, window) for _ in range(draw.randint(0, 60))]
            sequences, offsets = packing.best_fit_decreasing(lengths, window)
            assert len(set(sequences)) == tightest(lengths, window)
            spans = sorted(zip(sequences, offsets, lengths))
            for (s, o, n), (s2, o2, _) in zip(spans, spans[1:]):
                assert o + n <= window and (o2 == o + n if s == s2 else o2 == 0)


def test_packing_keeps_every_id(spark, documents):
    pieces = packing.token_pieces(documents.selectExpr("*", "5 AS start", "6 AS sequence_id"), WORDS, with_ids=True)
    packed = packing.pack(pieces, documents.count(), group=8).toPandas()
    fills = packed.sort_values(["sequence_id", "offset"])
    assert (fills.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert (fills["offset"] == fills.groupby("sequence_id")["length"].cumsum() - fills["length"]).all()
    assert [zlib.crc32(bytes(i)) for i in packed["ids"]] == packed["ids_crc32"].tolist()
    whole = packed[packed.doc_id == 200].sort_values("start")
    assert b"".join(map(bytes, whole["ids"])) == _words().encode("word " * 9000) + (1).to_bytes(4, "little")
    assert packed["length"].sum() == sum(len(_words().encode(r.text)) // 4 + 1 for r in documents.collect())
    assert packing.pack(packing.token_pieces(documents.limit(0), WORDS), 0).count() == 0


@pytest.mark.parametrize("ids", [[5], [7] * 9, list(range(5000)), [0, 2**32 - 1] * 40, [3] * 4000 + [49_000] * 96])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (token_files.unpack_block(token_files.pack_block(ids)) == ids).all()


def test_blocks_store_rare_large_values_apart():
    few = np.array([3] * 4000 + [49_000] * 96, np.uint32)
    assert len(token_files.pack_block(few)) < 96 * 6 + 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300))
def test_blocks_round_trip_on_any_ids(ids):
    assert token_files.unpack_block(token_files.pack_block(np.array(ids, np.uint32))).tolist() == ids


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_file_reads_any_range():
    draw, out = random.Random(4), io.BytesIO()
    writer, docs = token_files.Writer(out, block=16), []
    for i in range(40):
        ids = [draw.randint(0, 50_000) for _ in range(draw.choice([0, 1, 5, 16, 70]))]
        docs.append((i if i else None, ids))
        writer.add(docs[-1][0], np.array(ids, "<u4").tobytes())
    writer.close()
    reader = token_files.Reader(Source(out.getvalue()))
    assert [(d, i.tolist()) for d, _, i in reader.documents()] == docs
    flat = [x for _, ids in docs for x in ids]
    assert reader.read(37, 101).tolist() == flat[37:138]


def test_token_files_in_order(spark, documents):
    folder = new_folder(spark, "ids")
    token_files.write_files(documents, folder, WORDS)
    found = token_files.read_files(spark, folder, with_ids=True).toPandas().sort_values(["start", "n_tokens"])
    keys = found["doc_id"].tolist()
    assert np.isnan(keys[0]) and keys[1:] == sorted(keys[1:])
    assert found["start"].tolist() == (found["n_tokens"].cumsum() - found["n_tokens"]).tolist()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for row in found.itertuples():
        raw = _words().encode(texts[None if np.isnan(row.doc_id) else row.doc_id]) + (1).to_bytes(4, "little")
        assert (bytes(row.ids), row.n_tokens, row.ids_crc32) == (raw, len(raw) // 4, zlib.crc32(raw))
    empty = new_folder(spark, "ids")
    token_files.write_files(documents.limit(0), empty, WORDS)
    assert token_files.read_files(spark, empty).count() == 0


def test_rollup_commits_once(spark):
    rollup = rollups.Rollup(spark, new_folder(spark, "rollup"))
    assert rollup.totals().count() == 0
    load = spark.createDataFrame([("insert", "s", "en", "v1", 5), ("insert", "s", "en", "v1", None), ("insert", None, "en", "v1", 2)],
                                 "op string, source string, lang string, tokenizer string, n_tokens long")
    assert rollup.commit("load", load) and not rollup.commit("load", load)
    change = spark.createDataFrame([("delete", None, "en", "v1", 2, None), ("revise", "s", "en", "v1", 9, 5)],
                                   "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    assert rollup.commit("change", change) and not rollup.commit("change", change)
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v1", 2, 9)]
    # rows of an attempt that was never committed do not count
    rollups.deltas(load).selectExpr("'lost' batch", "'x' attempt", "*").write.mode("append").parquet(f"{rollup.folder}/deltas")
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v1", 2, 9)]
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit("bad", load.selectExpr("'move' AS op", "source", "lang", "tokenizer", "n_tokens"))


def test_rollup_query(spark, sf):
    """Against a plain recount of the documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    docs = docs.sort_values("doc_id").drop_duplicates("text")
    expected = {}
    for row in docs.itertuples():
        for name, n in (("word_bpe_49k", len(_words().encode(row.text)) // 4 + 1), ("bytes_256", len(row.text.encode()))):
            d, t = expected.get((row.source, row.lang, name), (0, 0))
            expected[row.source, row.lang, name] = (d + 1, t + n)
    found = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in QUERIES["op10_token_rollup"](spark, sf).collect()}
    assert found == expected


def test_slices_keep_long_texts_apart(monkeypatch):
    import pyarrow as pa

    from millrace.llm import frames

    monkeypatch.setattr(frames, "SLICE_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"t": ["a"] * 300 + ["b" * 5000, "c" * 400, "d" * 400, "e" * 400]})
    parts = list(frames.slices(batch))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert max(p.num_rows for p in parts) <= frames.SLICE_ROWS and all(p.num_rows == 1 or p.nbytes <= 1000 for p in parts)
