"""Phrase lexicons: many phrases of several words, found in one pass over each text.

Texts and phrases are cut into the same tokens: words of letters and digits, and every other printing character by itself.
Tokens are compared in lower case; blanks between them do not matter. A phrase is found only as whole tokens.

The phrases become an Aho-Corasick automaton over token numbers, held in flat arrays: a text is read once, whatever the
number and the overlaps of the phrases. The automaton travels to the tasks like a broadcast table, so it has a size bound.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.functions.columns import field

#: Most tokens that a lexicon may hold, all phrases together; a larger one raises. About 100 bytes a token.
MAX_TOKENS = 2_000_000

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")

def tokens(text: str | None) -> list[str]:
    return [token.lower() for token in TOKEN.findall(text or "")]


MATCHES = "array<struct<phrase:int,start:int,end:int>>"


class Automaton:
    """Phrases by number, in the order given. Phrases without a token are never found; of equal ones the first counts."""

    def __init__(self, phrases: Iterable[str], max_tokens: int = MAX_TOKENS):
        self.symbols: dict[str, int] = {}
        self.depth, self.phrase = array("i", [0]), array("i", [-1])
        edges: dict[tuple[int, int], int] = {}
        size = 0
        for number, phrase in enumerate(phrases):
            state = 0
            for token in tokens(phrase):
                size += 1
                if size > max_tokens:
                    raise ValueError(f"the lexicon has more than {max_tokens} tokens")
                step = (state, self.symbols.setdefault(token, len(self.symbols)))
                if step not in edges:
                    edges[step] = len(self.depth)
                    self.depth.append(self.depth[state] + 1)
                    self.phrase.append(-1)
                state = edges[step]
            if state and self.phrase[state] < 0:
                self.phrase[state] = number
        self.width = max(1, len(self.symbols))
        self.edges = {state * self.width + symbol: target for (state, symbol), target in edges.items()}
        self._link()

    def _link(self) -> None:
        """``fail``: the state of the longest proper suffix; ``shorter``: the nearest such state that ends a phrase."""
        count = len(self.depth)
        self.fail, self.shorter = array("i", [0]) * count, array("i", [0]) * count
        children: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        for edge, target in self.edges.items():
            children[edge // self.width].append((edge % self.width, target))
        queue = deque(target for _, target in children[0])
        while queue:
            state = queue.popleft()
            for symbol, target in children[state]:
                queue.append(target)
                self.fail[target] = self._next(self.fail[state], symbol)
            back = self.fail[state]
            self.shorter[state] = back if self.phrase[back] >= 0 else self.shorter[back]

    def _next(self, state: int, symbol: int) -> int:
        while (target := self.edges.get(state * self.width + symbol)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return target

    def every(self, text: str | None) -> list[tuple[int, int, int]]:
        """All occurrences, overlapping ones too: (phrase, start, end) in code points, by end, then the longest first."""
        found, state, starts, ends = [], 0, [], []
        for place in TOKEN.finditer(text or ""):
            symbol = self.symbols.get(place[0].lower())
            if symbol is None:
                state = 0
                starts.clear()
                ends.clear()
                continue
            starts.append(place.start())
            ends.append(place.end())
            state = self._next(state, symbol)
            hit = state if self.phrase[state] >= 0 else self.shorter[state]
            while hit:
                found.append((self.phrase[hit], starts[-self.depth[hit]], ends[-1]))
                hit = self.shorter[hit]
        return found

    def longest(self, text: str | None) -> list[tuple[int, int, int]]:
        """Occurrences that do not overlap: leftmost first, at one place the longest."""
        chosen, past = [], 0
        for hit in sorted(self.every(text), key=lambda h: (h[1], -h[2])):
            if hit[1] >= past:
                chosen.append(hit)
                past = hit[2]
        return chosen


def find_phrases(df: DataFrame, text: str, phrases: list[str], target: str = "phrases", overlaps: bool = False,
                 max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Add the occurrences of ``phrases`` as an array of (number of the phrase, start, end), in code points.

    Without ``overlaps`` they are leftmost and longest; with it every occurrence is listed, by end, the longest first.
    A null or empty text has none.
    """
    automaton = Automaton(phrases, max_tokens)
    find = automaton.every if overlaps else automaton.longest

    @F.pandas_udf(MATCHES)
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"phrase": p, "start": s, "end": e} for p, s, e in find(t)] for t in texts], dtype="object")

    return df.withColumn(target, search(field(text)))


def weigh_phrases(df: DataFrame, text: str, weights: dict[str, float], target: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Add the sum of the weights of the leftmost, longest occurrences; 0 where there is none."""
    automaton = Automaton(weights, max_tokens)
    values = [float(v) for v in weights.values()]

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([float(sum(values[p] for p, _, _ in automaton.longest(t))) for t in texts], dtype="float64")

    return df.withColumn(target, score(field(text)))


def lexicon(table: DataFrame, columns: list[str], max_phrases: int = MAX_TOKENS) -> list[tuple]:
    """The distinct rows of a lexicon table, in the order of their columns; more than ``max_phrases`` raise."""
    rows = table.select(*[field(c) for c in columns]).distinct().limit(max_phrases + 1).collect()
    if len(rows) > max_phrases:
        raise ValueError(f"the lexicon has more than {max_phrases} rows")
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))
