"""Byte-level BPE by monoid tree reduction.

A text's ids form a monoid: halves are encoded on their own and joined by encoding a window around the cut again,
grown until the ids outside it cannot change. There are two such trees:

- over the text: outside a window that starts and ends before a space with a non-space behind it, nothing changes,
  because every match of the split pattern ends there and the pattern never looks back;
- inside a long match (letters without a break): a sequence of ids is the encoding of its bytes exactly if each
  neighbouring pair is the encoding of the pair's bytes, so it is enough that both edges of the window hold.

Decoding looks up each id's bytes and concatenates.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from millrace.llm.frames import add_columns

LEAF_CHARS = 8192     # texts up to this length are encoded at once
LEAF_BYTES = 64       # and so are matches
MAX_CHUNKS = 400_000  # entries kept per worker process; a full table is emptied, which changes no result
MAX_MATCHES = 500_000
_ODD = regex.compile(r"\s\s|[^\S \n]|\x00|^\s|\s$")
_CUT = regex.compile(r" (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder for a rank file and a split pattern; ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.decimal = [str(i) for i in range(max(self.bytes_of) + 1)]
        self.table = [self.bytes_of.get(i) for i in range(len(self.decimal))]
        self.pattern = regex.compile(pattern)
        self.matches: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    # one match

    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > LEAF_BYTES:
            return self._merge_long(piece)
        none = len(self.decimal)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap, for windows that had to grow."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[piece[i:i + 2]], i, 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (joined := parts[a] + parts[b]) in ranks:
                    heapq.heappush(heap, (ranks[joined], a, len(joined)))
        return [ranks[p] for p in parts if p is not None]

    def _holds(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def encode_match(self, piece: bytes) -> list[int]:
        """Halves recursively; leaves are merged at once."""
        if len(piece) <= LEAF_BYTES or piece in self.ranks:
            return self.merge(piece)
        cut = len(piece) // 2
        return self.join_ids(self.encode_match(piece[:cut]), self.encode_match(piece[cut:]))

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the joined bytes of two encodings inside one match."""
        l = r = 2
        while True:
            l, r = min(l, len(left)), min(r, len(right))
            outer, inner = left[:len(left) - l], right[r:]
            window = self.merge(b"".join([self.bytes_of[i] for i in left[len(left) - l:] + right[:r]]))
            left_holds = not outer or self._holds(outer[-1], window[0])
            right_holds = not inner or self._holds(window[-1], inner[0])
            if left_holds and right_holds:
                return outer + window + inner
            l, r = l * (1 if left_holds else 2), r * (1 if right_holds else 2)

    # texts

    def _encode_matches(self, text: str) -> bytes:
        known, out = self.matches, []
        for match in self.pattern.findall(text):
            raw = known.get(match)
            if raw is None:
                raw = np.array(self.encode_match(match.encode()), "<u4").tobytes()
                if len(match) <= LEAF_BYTES:
                    if len(known) >= MAX_MATCHES:
                        known.clear()
                    known[match] = raw
            out.append(raw)
        return b"".join(out)

    def _leaf(self, text: str) -> bytes:
        """A text of single blanks and line ends is looked up by the parts between its cuts."""
        if _ODD.search(text):
            return self._encode_matches(text)
        chunks = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        known = self.chunks
        missing = set(chunks).difference(known)
        if missing:
            if len(known) + len(missing) > MAX_CHUNKS:
                known.clear()
                missing = set(chunks)
            for chunk in missing:
                known[chunk] = self._encode_matches(chunk)
        return b"".join(map(known.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        if len(text) <= LEAF_CHARS:
            return self._leaf(text)
        cut = len(text) // 2
        return self._join(text, cut, self.encode(text[:cut]), self.encode(text[cut:]))

    def _join(self, text: str, cut: int, left: bytes, right: bytes) -> bytes:
        reach, begin, end = 64, None, None
        while begin is None or end is None:
            if begin is None:  # a cut that both the left half and the whole text make
                found = [m.start() for m in _CUT.finditer(text, max(0, cut - reach), max(0, cut - 3))]
                begin = found[-1] if found else 0 if reach >= cut else None
            if end is None:
                found = _CUT.search(text, cut + 1, min(len(text), cut + reach))
                end = found.start() if found else len(text) if cut + reach >= len(text) else None
            reach *= 4
        dropped = len(self._encode_matches(text[begin:cut]))
        return b"".join([left[:len(left) - dropped], self._encode_matches(text[begin:end]),
                         right[len(self._encode_matches(text[cut:end])):]])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decimals(self, ids: bytes) -> str:
        return " ".join(map(self.decimal.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file, once per worker process."""
    return ByteBpe(path, pattern)


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add the ids of every whole text as little-endian unsigned 32-bit bytes; null is encoded as the empty text."""

    def make():
        bpe = byte_bpe(ranks, pattern)
        return lambda texts: ([bpe.encode(t or "") for t in texts],)

    return add_columns(df, [text], f"`{into}` binary", make)


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """Add the bytes that the ids stand for; null ids give no bytes."""

    def make():
        bpe = byte_bpe(ranks, pattern)
        return lambda rows: ([bpe.decode(r or b"") for r in rows],)

    return add_columns(df, [ids], f"`{into}` binary", make)


def round_trip(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and add ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one
    space) and ``decoded_sha256`` in one pass, without moving the ids. Null counts as empty."""

    def make():
        bpe = byte_bpe(ranks, pattern)

        def digests(texts):
            encoded = [bpe.encode(t or "") for t in texts]
            return ([len(e) // 4 for e in encoded],
                    [hashlib.sha256(bpe.decimals(e).encode()).hexdigest() for e in encoded],
                    [hashlib.sha256(bpe.decode(e)).hexdigest() for e in encoded])

        return digests

    return add_columns(df, [text], "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
