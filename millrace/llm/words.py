"""Token ids of whole texts by a word-level vocabulary file of the ``tokenizers`` library.

The vocabulary's pre-tokenizer drops white space and never joins characters across it, so a text's ids are the ids
of its words one after another. Each distinct word goes through the library once and is then looked up.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np

MAX_WORDS = 400_000    # entries kept per worker process; a full table is emptied, which changes no result
MAX_PIECES = 600_000

# The vocabulary file's split pattern, for lower-case text of these letters
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a printable byte stands for itself, the others for the code points from 256 on; as a
    translation of the characters that plain pieces may hold."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x21, 0x100)}


_LETTERS = _byte_letters()


class WordTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; a null text has none."""
        words = (text or "").encode().split()  # white space here is ASCII; the library handles the rest
        known = self.words
        missing = set(words).difference(known)
        if missing:
            if len(known) > MAX_WORDS:
                known.clear()
                missing = set(words)
            self._learn(missing)
        return b"".join(map(known.__getitem__, words))

    def _library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, missing: set[bytes]) -> None:
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        parts = {}
        for word in missing:
            text = word.decode()
            if _PLAIN.fullmatch(text) and "<|" not in text:
                parts[word] = _PIECES.findall(text.lower())
            else:
                self.words[word] = self._library_ids(text)
        self._learn_pieces({p for ps in parts.values() for p in ps}.difference(self.pieces))
        pieces = self.pieces
        for word, ps in parts.items():
            self.words[word] = pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])

    def _learn_pieces(self, new: set[str]) -> None:
        """A piece is lower case and split already, so the library's model alone encodes it."""
        tokenize = self.library.model.tokenize
        for piece in new:
            ids = [token.id for token in tokenize(piece.translate(_LETTERS))]
            self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a vocabulary file, once per worker process."""
    return WordTokenizer(path)


def count_tokens(tokenizer: WordTokenizer, text: str | None) -> int:
    return len(tokenizer.encode(text)) // 4
