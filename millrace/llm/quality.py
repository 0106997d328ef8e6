"""Quality rules: statistics of whole texts and gradient-boosted trees over them.

The trees are grown on histograms of a bounded sample of labelled documents, with monotonic constraints on chosen
statistics, and flattened into node arrays, so that a batch of documents goes down all trees with a few numpy steps.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, functions as F

from millrace.llm.frames import add_columns

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50        # per cent of words in repeated windows
SAMPLE = 20_000          # labelled documents to learn from, about
# Statistics, and the direction in which each may change the score: 1 up, -1 down, 0 either
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0,
    "digit_share": 0, "mark_share": -1, "letter_share": 0, "distinct_share": 0, "line_words": 0, "comma_share": 0,
}
_SPACES = str.maketrans("", "", " \t\n\r\x0b\x0c")


def repeated_words(words: list, size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur at least twice in the list, the first time included."""
    if len(words) <= size:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    windows = ids[:len(ids) - size + 1]
    for k in range(1, size):
        if k > 1 and n ** 3 >= 1 << 62:  # keep the code of a window in 64 bits
            windows = np.unique(windows, return_inverse=True)[1]
        windows = windows * n + ids[k:len(ids) - size + 1 + k]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k:k + len(twice)] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of a whole text; null is empty."""
    text = text or ""
    words = text.encode().split()  # ASCII white space only
    n = len(words)
    packed = text.translate(_SPACES)
    chars = len(packed)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.translate(_SPACES)]
    duplicates = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    least = max(1, chars)
    ascii_bytes = np.bincount(np.frombuffer(packed.encode(), np.uint8), minlength=256)
    upper, lower = int(ascii_bytes[65:91].sum()), int(ascii_bytes[97:123].sum())
    features = [
        np.log1p(n), chars / max(1, n), symbols / least, duplicates / max(1, len(lines)), repeated / max(1, n),
        upper / max(1, upper + lower), int(ascii_bytes[48:58].sum()) / least, (packed.count("!") + packed.count("?")) / least,
        (upper + lower + int(ascii_bytes[128:].sum())) / least, len(set(words)) / max(1, n), n / max(1, len(lines)),
        packed.count(",") / max(1, n),
    ]
    return (n, chars, symbols, duplicates, repeated), features


class Trees:
    """Boosted regression trees for the log-odds of label 1, as node arrays: per tree and node the feature (-1: leaf),
    threshold (left below or equal), children and value."""

    def __init__(self, prior: float, nodes: list[tuple[np.ndarray, ...]]):
        self.prior = prior
        size = max((len(n[0]) for n in nodes), default=1)
        self.feature, self.left, self.right = (np.full((len(nodes), size), -1, np.int32) for _ in range(3))
        self.threshold, self.value = np.zeros((len(nodes), size)), np.zeros((len(nodes), size))
        for t, arrays in enumerate(nodes):
            for target, source in zip((self.feature, self.threshold, self.left, self.right, self.value), arrays):
                target[t, :len(source)] = source

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        rows = np.arange(len(features))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(features), len(self.feature)), np.int32)
        while True:
            feature = self.feature[trees, at]
            inner = feature >= 0
            if not inner.any():
                break
            goes_left = features[rows, np.maximum(feature, 0)] <= self.threshold[trees, at]
            at = np.where(inner, np.where(goes_left, self.left[trees, at], self.right[trees, at]), at)
        return 1 / (1 + np.exp(-self.prior - self.value[trees, at].sum(axis=1)))


def grow(features: np.ndarray, labels: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3,
         rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boost ``trees`` trees by the gradients of the logistic loss.

    A split on a constrained feature is allowed only if the children's values follow its direction, and it bounds the
    values below each child by their middle, so the score as a whole is monotonic. Without both labels among the rows
    the score is their share.
    """
    share = float(np.clip(labels.mean() if len(labels) else 1.0, 1e-4, 1 - 1e-4))
    prior = float(np.log(share / (1 - share)))
    if len(np.unique(labels)) < 2:
        return Trees(prior, [])
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in features.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, features.T)], axis=1)
    margin, grown = np.full(len(labels), prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = labels - p, p * (1 - p)
        nodes: list[list] = []

        def build(rows, level, low, high):
            g, h = gradient[rows].sum(), hessian[rows].sum()
            value = float(np.clip(g / (h + l2), low, high))
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, rate * value])
            best = None
            if level < depth:
                for f, direction in enumerate(monotone):
                    size = len(edges[f]) + 1
                    gs = np.cumsum(np.bincount(binned[rows, f], gradient[rows], size))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, f], hessian[rows], size))[:-1]
                    left, right = np.clip(gs / (hs + l2), low, high), np.clip((g - gs) / (h - hs + l2), low, high)
                    gain = (2 * gs * left - (hs + l2) * left ** 2) + (2 * (g - gs) * right - (h - hs + l2) * right ** 2) \
                        - (2 * g * value - (h + l2) * value ** 2)
                    gain[(hs < least) | (h - hs < least) | (direction * (right - left) < 0)] = -np.inf
                    if len(gain) and (best is None or gain.max() > best[0]):
                        k = int(gain.argmax())
                        best = (gain[k], f, k, left[k], right[k])
            if best is not None and best[0] > 1e-6:
                _, f, k, left, right = best
                middle = (left + right) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(
                    monotone[f], ((low, high), (low, high)))
                goes = binned[rows, f] <= k
                nodes[me][:2] = [f, float(edges[f][k])]
                nodes[me][2] = build(rows[goes], level + 1, *bounds[0])
                nodes[me][3] = build(rows[~goes], level + 1, *bounds[1])
            else:
                margin[rows] += rate * value
            return me

        build(np.arange(len(labels)), 0, -np.inf, np.inf)
        grown.append(tuple(np.array(c) for c in zip(*nodes)))
    return Trees(prior, grown)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``features`` (array<double>) of every whole text."""
    return add_columns(df, [text], "features array<double>", lambda: lambda texts: ([statistics(t)[1] for t in texts],))


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Trees:
    """Learn from about ``sample`` labelled documents (all, if there are fewer), chosen by the hash of their id.

    Null ids, labels and labels without a document are left out. An id counts once, whatever often it is repeated: with
    the label that most of its labels say (a tie is good), and with the text that comes first by its hash. The features of
    the sample, not its texts, come to the driver.
    """
    rows = labels.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("double").alias("__label")).dropna()
    rows = rows.groupBy("__id").agg((F.avg("__label") >= 0.5).cast("double").alias("__label"))
    total = rows.count()
    drawn = rows.filter(F.xxhash64("__id").bitwiseAND(0xFFFFFFF) / F.lit(float(1 << 28)) < min(1.0, sample / max(1, total)))
    texts = df.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    met = texts.join(F.broadcast(drawn), "__id").withColumn("__hash", F.xxhash64("__text"))
    learned = measure(met, "__text").groupBy("__id").agg(F.min_by("features", "__hash").alias("features"), F.max("__label").alias("__label")) \
        .toPandas().sort_values("__id", ignore_index=True)
    features = np.stack(learned["features"].to_list()) if len(learned) else np.empty((0, len(FEATURES)))
    return grow(features, learned["__label"].to_numpy(np.float64), list(FEATURES.values()))


def judge(df: DataFrame, trees: Trees, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), ``base_failed`` (fewer than MIN_WORDS
    words, or too many repeated), ``score`` of the trees and ``kept``: neither failed nor scored below ``threshold``.
    A null or empty text has no words and fails. Columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def make():
        own = shared.value

        def compute(texts):
            found = [statistics(t) for t in texts]
            base = [list(column) for column in zip(*[f[0] for f in found])]
            scores = own.score(np.array([f[1] for f in found])).tolist()
            failed = [n < MIN_WORDS or 100 * r > MAX_REPEATED * n for n, r in zip(base[0], base[4])]
            return *base, failed, scores, [not f and s >= threshold for f, s in zip(failed, scores)]

        return compute

    return add_columns(df, [text], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
                                   " base_failed boolean, score double, kept boolean", make)
