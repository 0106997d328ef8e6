"""Centroid clustering of integer vectors with Ptolemaic pivots.

For any pivots p, q, a vector x and a centroid c, Ptolemy's inequality gives
d(x, c) >= |d(x, p) d(q, c) - d(x, q) d(p, c)| / d(p, q). The pivots are fixed, so the distances of a vector to them are
computed once and kept beside it; each round adds only those of the few centroids. A centroid is left out when its
bound, rounded down by more than what floating arithmetic can err, exceeds the exact distance to another; the rest are
checked exactly, in integers.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.frames import add_columns, ready, without, written

PIVOTS = 6
SAFE = 1 << 27          # components below it: squared distances of up to 512 components fit 64 bits
LIMB = 48               # sums of components travel in parts of so many bits, so they have no largest value
SLACK = 2.0 ** -40      # far above the rounding of the few operations of a bound


def usable(vector: Column, size: int) -> Column:
    """Exactly ``size`` components, none null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~bad, F.lit(False))


def floored(vectors: list[list[float]] | np.ndarray, scale: int) -> np.ndarray:
    """Integers floor(scale * x): 64-bit where all are small, else Python's own (as object array)."""
    real = np.array(vectors, np.float64).reshape(len(vectors), -1 if len(vectors) else 0)
    if not real.size or np.abs(real).max() * scale < SAFE:
        return np.floor(real * scale).astype(np.int64)
    whole = [[int(x) * scale if abs(x) >= 2.0 ** 53 else int(np.floor(x * scale)) for x in row] for row in real.tolist()]
    return np.array(whole, object).reshape(real.shape)


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of the vectors (rows) to one point."""
    if vectors.dtype == object or point.dtype == object:
        vectors, point = vectors.astype(object), point.astype(object)
    apart = vectors - point
    return (apart * apart).sum(axis=1) if len(vectors) else np.zeros(0, vectors.dtype)


def distance(square) -> np.ndarray:
    return np.sqrt(np.asarray(square, np.float64))


def pick_pivots(points: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Up to ``count`` different points, each the farthest from those before it."""
    chosen, least = [0], squared(points, points[0])
    while len(chosen) < min(count, len(points)) and least.max() > 0:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, squared(points, points[chosen[-1]]))
    return points[chosen]


def lower_bounds(to_pivots: np.ndarray, centroid_to_pivots: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Bounds, rounded down, of the squared distances of vectors (rows) to centroids (columns)."""
    least = np.zeros((len(to_pivots), len(centroid_to_pivots)))
    for p, q in combinations(range(len(between)), 2):
        one = to_pivots[:, p, None] * centroid_to_pivots[None, :, q]
        two = to_pivots[:, q, None] * centroid_to_pivots[None, :, p]
        bound = (np.abs(one - two) - SLACK * (one + two)) / between[p, q]
        np.maximum(least, bound, out=least)
    return least * least * (1 - SLACK)


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid of each vector, ties to the smaller number; its squared distance; distances computed)."""
    small = vectors.dtype != object and centroids.dtype != object
    if small and len(pivots) > 1:
        between = distance([squared(pivots, p) for p in pivots])
        bounds = lower_bounds(to_pivots, distance([squared(pivots, c) for c in centroids]), between)
    else:
        bounds = np.zeros((len(vectors), len(centroids)))
    guess = bounds.argmin(axis=1)
    best_of, best = np.full(len(vectors), -1), np.zeros(len(vectors), np.int64 if small else object)
    checked = 0
    for c in np.unique(guess):
        rows = np.flatnonzero(guess == c)
        best_of[rows], best[rows] = c, squared(vectors[rows], centroids[c])
        checked += len(rows)
    for c in range(len(centroids)):
        rows = np.flatnonzero((guess != c) & (bounds[:, c] <= best)) if small else np.flatnonzero(guess != c)
        found = squared(vectors[rows], centroids[c])
        checked += len(rows)
        better = (found < best[rows]) | ((found == best[rows]) & (c < best_of[rows]))
        best_of[rows[better]], best[rows[better]] = c, found[better]
    return best_of, best, checked


def _limbs(total: int) -> list[int]:
    """An integer as parts of LIMB bits, lowest first; all have its sign."""
    sign, total, parts = (-1 if total < 0 else 1), abs(total), []
    while total:
        parts.append(sign * (total & ((1 << LIMB) - 1)))
        total >>= LIMB
    return parts


def _first_centroids(kept: DataFrame, count: int, order: Column, vec_id: str, vector: str, scale: int) -> np.ndarray:
    """The ``count`` vectors first in ``order``; null orders last, equal ones by the vector."""
    rows = kept.select(F.col(f"`{vector}`").alias("v"), order.alias("o")) \
        .orderBy(F.col("o").asc_nulls_last(), "v").limit(count).collect()  # count rows
    return floored([r["v"] for r in rows], scale)


def cluster(df: DataFrame, order: Column, count: int, rounds: int, size: int = 64, vec_id: str = "vec_id",
            vector: str = "embedding", scale: int = 256, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(``df``'s usable rows with ``cluster`` (int) and ``distance`` (squared, long), the final centroids).

    Vectors are the integers floor(``scale`` * x). The first centroids are the ``count`` vectors that come first in
    ``order`` (all, if fewer; null orders last, ties by the vector); each round moves every centroid that has vectors to
    the floor of their mean. Rows whose vector is null, of another size or holds null or non-finite components are left
    out; repeated rows each count; null ids stay. A squared distance beyond a long is null. An empty table gives no
    rows. Other columns stay, and columns of the new names are replaced. The driver holds the centroids alone.
    """
    spark = df.sparkSession
    ready(spark)
    own = without(df, ["cluster", "distance"])
    kept = own.filter(usable(F.col(f"`{vector}`"), size))
    centroids = _first_centroids(kept, count, order, vec_id, vector, scale)
    if not len(centroids):
        return add_columns(kept, [vector], "cluster int, distance long", lambda: lambda v: ([], [])), centroids
    fixed = pick_pivots(centroids, pivots)

    def pivot_distances():
        def compute(vectors):
            whole = floored(vectors, scale)
            far = np.stack([distance(squared(whole, p)) if whole.dtype != object else np.zeros(len(whole)) for p in fixed], 1)
            return (far.tolist(),)

        return compute

    mark = "__to_pivots"
    while any(c.lower() == mark for c in kept.columns):
        mark += "_"
    table = written(add_columns(kept, [vector], f"{mark} array<double>", pivot_distances), "pivot-distances")

    def placed(vectors, to_pivots, now):
        whole = floored(vectors, scale)
        return whole, *nearest(whole, np.array(to_pivots, np.float64).reshape(len(whole), -1), now, fixed)

    def sums(now):
        def run(batches):
            totals: dict[int, list] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    whole, of, _, _ = placed(*[part.column(i).flatten().to_numpy().reshape(part.num_rows, -1) for i in (0, 1)], now)
                    for c in np.unique(of).tolist():
                        mine = whole[of == c]
                        held = totals.setdefault(c, [0, np.zeros(size, object)])
                        held[0] += len(mine)
                        held[1] = held[1] + mine.sum(axis=0).astype(object)
            rows = [(c, n if limb == 0 else 0, limb, part) for c, (n, total) in totals.items()
                    for limb, part in enumerate(_by_limb([int(t) for t in total], size))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())))], ["c", "n", "limb", "part"])

        return run

    for _ in range(rounds):
        parts = table.select(f"`{vector}`", f"`{mark}`").mapInArrow(sums(centroids), "c int, n long, limb int, part array<long>") \
            .select("c", "limb", "n", F.posexplode("part").alias("i", "x")).groupBy("c", "limb", "i") \
            .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # count * size rows
        counts: dict[int, int] = {}
        totals = {c: [0] * size for c in {r.c for r in parts}}
        for r in parts:
            totals[r.c][r.i] += int(r.x) << (LIMB * r.limb)
            if r.limb == 0:
                counts[r.c] = r.n
        moved = [[t // counts[c] for t in totals[c]] if c in totals else [int(x) for x in centroids[c]] for c in range(len(centroids))]
        centroids = _integers(moved)
    last = centroids

    def final():
        def compute(vectors, to_pivots):
            _, of, far, _ = placed(vectors, to_pivots, last)
            return of.tolist(), [int(d) if int(d) < 1 << 63 else None for d in far]

        return compute

    return add_columns(table, [vector, mark], "cluster int, distance long", final).drop(mark), centroids


def _by_limb(totals: list[int], size: int) -> list[list[int]]:
    parts = [_limbs(t) for t in totals]
    return [[p[i] if i < len(p) else 0 for p in parts] for i in range(max(1, *(len(p) for p in parts)))]


def _integers(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < SAFE for row in rows for x in row)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), -1)


def with_inertia(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster_inertia`` and ``inertia`` (the distances summed over the row's cluster and over all; null beyond a
    long) and ``centroid_sha256`` (of its centroid's components as decimal integers joined by commas)."""
    spark = placed.sparkSession
    placed = written(without(placed, ["cluster_inertia", "inertia", "centroid_sha256"]), "clusters")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a cluster
    lost = {r["cluster"] for r in placed.filter(F.col("distance").isNull()).select("cluster").distinct().collect()}  # at most so many

    def fitting(total) -> int | None:
        return int(total) if total is not None and int(total) < 1 << 63 else None

    whole = None if lost else fitting(sum(int(r["s"]) for r in sums))
    table = [(r["cluster"], None if r["cluster"] in lost else fitting(r["s"]), whole,
              hashlib.sha256(",".join(str(int(x)) for x in centroids[r["cluster"]]).encode()).hexdigest()) for r in sums]
    named = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(named), "cluster")  # a row a cluster
