"""Centroid clustering against all distances in plain integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import centroids
from millrace.llm.queries import QUERIES


def plain(rows, count, rounds, size=64):
    """{position: (cluster, squared distance)}, centroids; rows are (vec_id, vector)."""
    kept = {i: [math.floor(256 * x) if abs(x) < 2 ** 53 else int(x) * 256 for x in map(float, v)] for i, (_, v) in enumerate(rows)
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)}

    def order(i):
        vec_id = rows[i][0]
        return vec_id is None, hashlib.sha256(f"2:{vec_id}".encode()).hexdigest(), [float(x) for x in rows[i][1]]

    points = [kept[i] for i in sorted(kept, key=order)[:count]]

    def assign():
        out = {}
        for i, v in kept.items():
            out[i] = min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))
        return out

    for _ in range(rounds):
        of = assign()
        for c in range(len(points)):
            mine = [kept[i] for i, (_, k) in of.items() if k == c]
            if mine:
                points[c] = [sum(column) // len(mine) for column in zip(*mine)]
    return {i: (c, d) for i, (d, c) in assign().items()}, points


def by_hash():
    return F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)


def test_query(spark, sf):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    of, points = plain(table, 40, 5)
    found = {r.vec_id: r for r in QUERIES["op11_centroids"](spark, sf).collect()}
    assert len(found) == len(of) == len(table)
    total = sum(d for _, d in of.values())
    for i, (c, d) in of.items():
        r = found[table[i][0]]
        own = sum(e for k, e in of.values() if k == c)
        sha = hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()
        assert (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) == (c, d, own, total, sha)


def made(seed, kind):
    rng = np.random.default_rng(seed)
    if kind == "ties":  # few different vectors on a grid, many at equal distance
        return [(i, (rng.integers(-2, 3, 4) / 256).tolist()) for i in range(120)]
    if kind == "large":  # beyond 64-bit squares, and beyond a long
        return [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 40)).tolist()) for i in range(60)]
    return [(i, (rng.normal(size=4) + 5 * rng.integers(0, 3)).tolist()) for i in range(200)]


@pytest.mark.parametrize("kind", ["ties", "large", "groups"])
def test_made_vectors(spark, kind):
    rows = made(1, kind)
    of, points = plain(rows, 7, 3, 4)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    placed, last = centroids.cluster(frame, by_hash(), 7, 3, 4)
    assert [[int(x) for x in p] for p in last] == points
    assert {r.vec_id: (r.cluster, r.distance) for r in placed.collect()} == \
        {i: (c, d if d < 1 << 63 else None) for i, (c, d) in of.items()}
    inertia = {r.cluster: (r.cluster_inertia, r.inertia) for r in centroids.with_inertia(placed, last).collect()}
    for c, (own, whole) in inertia.items():
        mine = sum(d for k, d in of.values() if k == c)
        assert own == (mine if mine < 1 << 63 else None) and (whole is None) == (sum(d for _, d in of.values()) >= 1 << 63)


def test_bounds_are_below_and_prune():
    rng = np.random.default_rng(5)
    whole = rng.integers(-3000, 3000, (500, 64))
    whole[:250] += 4000
    points, fixed = whole[::25], centroids.pick_pivots(whole[::25])
    far = np.stack([centroids.distance(centroids.squared(whole, p)) for p in fixed], 1)
    between = centroids.distance([centroids.squared(fixed, p) for p in fixed])
    bounds = centroids.lower_bounds(far, centroids.distance([centroids.squared(fixed, c) for c in points]), between)
    exact = np.stack([centroids.squared(whole, c) for c in points], 1)
    assert (bounds <= exact).all() and bounds.max() > 0
    of, best, checked = centroids.nearest(whole, far, points, fixed)
    assert (best == exact.min(axis=1)).all() and (of == exact.argmin(axis=1)).all()
    assert checked < 0.8 * exact.size  # the bounds leave centroids out


def test_defined_cases(spark):
    """Unusable vectors go; null and repeated ids, repeated rows, fewer vectors than centroids, other columns."""
    good = [0.5, -1.0]
    rows = [(None, good, "a", 1.5), (3, good, "b", None), (3, good, "b", None), (4, [2.0, 2.0], None, 2.0), (5, None, "x", 0.0),
            (6, [1.0], "x", 0.0), (7, [1.0, None], "x", 0.0), (8, [1.0, float("nan")], "x", 0.0), (9, [1.0, float("inf")], "x", 0.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, `a.b` string, Distance double")
    placed, last = centroids.cluster(frame, by_hash(), 40, 2, 2)
    out = centroids.with_inertia(placed, last)
    assert sorted(out.columns) == sorted(["vec_id", "embedding", "a.b", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
    found = out.collect()
    assert len(found) == 4 and len(last) == 4 and all(r.distance == 0 for r in found)
    assert sorted((str(r.vec_id), r["a.b"] or "") for r in found) == [("3", "b"), ("3", "b"), ("4", ""), ("None", "a")]
    of, _ = plain([(r[0], r[1]) for r in rows], 40, 2, 2)
    assert sorted(c for c, _ in of.values()) == sorted(r.cluster for r in found)
    empty, none = centroids.cluster(frame.limit(0), by_hash(), 40, 2, 2)
    assert centroids.with_inertia(empty, none).count() == 0
