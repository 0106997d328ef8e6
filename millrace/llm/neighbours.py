"""Nearest neighbours by inner product: stable projections, kd-trees and a chi-square stopping test.

Vectors are lengthened by one component to a common norm, which turns the largest inner product into the smallest
distance, and projected to a few dimensions by Gaussian (2-stable) vectors. The squared ratio of projected to true
distance then follows a chi-square distribution, so once a query's next projected neighbour lies so far that the
distribution gives its current k-th neighbour a confidence of at least ``CONFIDENCE``, the search may stop.

The upper levels of the kd-tree over projections come from a bounded sample and cut the space into cells; every vector
goes to one cell, and a cell holding more than its share is dealt into blocks; so are the questions that visit a block, and
each block of questions meets a copy of the cell's block. A query first searches its own cell,
which bounds the distance of its k-th neighbour, then every cell that the stopping test does not rule out. In a cell
its own kd-tree yields projected neighbours in growing distance, and true products verify them. Equal vectors are one
entry with their smallest ids.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from millrace.llm.frames import ready, written

PROJECTED = 16       # dimensions of the projections, even
CONFIDENCE = 0.95
CELL = 4_000         # distinct vectors per cell that the tree aims at
SAMPLE = 100_000     # projections that the upper tree is built on, about
BLOCK = 200_000      # distinct vectors per block of a cell
QUESTIONS = 8_000    # questions per block of a cell, about
LEAF = 256           # vectors per leaf of a cell's own tree
_TOLERANCE = 1e-9
_FOUND = "h1 long, h2 long, score double, ids array<long>"


def chi_square_quantile(p: float, freedom: int) -> float:
    """For an even number of degrees of freedom."""

    def below(x):
        term, total = 1.0, 1.0
        for j in range(1, freedom // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 10.0 * freedom + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


class Tree(NamedTuple):
    """kd-tree as arrays: per node the axis (-1: leaf), plane, children; leaves number their cells."""

    axis: np.ndarray
    plane: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray
    low: np.ndarray   # per cell, the box it covers
    high: np.ndarray

    def locate(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        while True:
            axis = self.axis[at]
            inner = np.flatnonzero(axis >= 0)
            if not len(inner):
                return self.cell[at]
            node = at[inner]
            goes_left = points[inner, axis[inner]] <= self.plane[node]
            at[inner] = np.where(goes_left, self.left[node], self.right[node])

    def squared_distance(self, point: np.ndarray) -> np.ndarray:
        """From a point to the box of every cell."""
        return (np.maximum(0, np.maximum(self.low - point, point - self.high)) ** 2).sum(axis=1)


def build_tree(points: np.ndarray, cells: int) -> tuple[Tree, list[np.ndarray]]:
    """Halve the points at the median of their widest axis until there are ``cells`` cells, or equal points are left;
    also the points of each cell."""
    dims = points.shape[1]
    nodes, boxes, members = [], [], []

    def grow(rows, wanted, low, high):
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, -1])
        own = points[rows]
        if wanted > 1 and len(rows) > 1:
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            plane = float(np.partition(own[:, axis], (len(rows) - 1) // 2)[(len(rows) - 1) // 2])
            left = own[:, axis] <= plane
            if not left.all():
                below, above = high.copy(), low.copy()
                below[axis] = above[axis] = plane
                nodes[me][:2] = [axis, plane]
                nodes[me][2] = grow(rows[left], wanted // 2, low, below)
                nodes[me][3] = grow(rows[~left], wanted - wanted // 2, above, high)
                return me
        nodes[me][4] = len(boxes)
        boxes.append((low, high))
        members.append(rows)
        return me

    grow(np.arange(len(points)), cells, np.full(dims, -np.inf), np.full(dims, np.inf))
    axis, plane, left, right, cell = (np.array(c) for c in zip(*nodes))
    return Tree(axis, plane, left, right, cell, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])), members


class Projection(NamedTuple):
    """``matrix`` maps the components, and the one added for the common norm ``norm``, to few dimensions."""

    matrix: np.ndarray
    norm: float

    def of_vectors(self, vectors: np.ndarray) -> np.ndarray:
        added = np.sqrt(np.maximum(0.0, self.norm ** 2 - (vectors ** 2).sum(axis=1)))
        return vectors @ self.matrix[:-1] + added[:, None] * self.matrix[-1]

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.matrix[:-1]


class Cell:
    """Vectors of one cell with their own kd-tree."""

    def __init__(self, vectors: np.ndarray, projection: Projection):
        self.norm = projection.norm
        projected = projection.of_vectors(vectors)
        self.tree, members = build_tree(projected, max(1, len(vectors) // LEAF))
        self.order = np.concatenate(members)
        self.ends = np.cumsum([len(m) for m in members])
        self.vectors, self.projected = vectors[self.order], projected[self.order]

    def search(self, queries: np.ndarray, points: np.ndarray, k: int, bounds: np.ndarray, stop: float) -> list[tuple]:
        """For each query the rows and inner products of up to ``k`` nearest vectors found, ties with the last included.

        ``points`` are the queries' projections, ``bounds`` squared distances that their k-th neighbours are known not
        to exceed, ``stop`` the chi-square quantile of the stopping test. Each turn, every query goes on to its next
        nearest leaf; the queries at one leaf are compared with it together.
        """
        bounds = bounds.astype(np.float64).copy()
        base = self.norm ** 2 + (queries ** 2).sum(axis=1)
        far = np.stack([self.tree.squared_distance(p) for p in points])
        order = np.argsort(far, axis=1, kind="stable")
        every = np.arange(len(queries))
        found = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        for turn in range(order.shape[1]):
            at = order[:, turn]
            going = far[every, at] <= stop * bounds
            if not going.any():
                break
            for leaf in np.unique(at[going]):
                begin, end = int(self.ends[leaf - 1]) if leaf else 0, int(self.ends[leaf])
                for who in np.array_split(own := every[going & (at == leaf)], -(-len(own) // 1024)):
                    self._compare(who, begin, end, queries, points, k, bounds, base, stop, found)
        return [self._exact(rows, query, k) for (rows, _), query in zip(found, queries)]

    def _compare(self, who, begin, end, queries, points, k, bounds, base, stop, found) -> None:
        projected = self.projected[begin:end]
        gaps = (points[who] ** 2).sum(axis=1)[:, None] + (projected ** 2).sum(axis=1) - 2 * points[who] @ projected.T
        products = queries[who] @ self.vectors[begin:end].T
        limit = (bounds[who] * (1 + _TOLERANCE) + _TOLERANCE)[:, None]
        good = (gaps <= stop * limit) & (base[who][:, None] - 2 * products <= limit)
        for w in np.flatnonzero(good.any(axis=1)):
            i, rows = who[w], np.flatnonzero(good[w])
            rows, values = np.concatenate([found[i][0], begin + rows]), np.concatenate([found[i][1], products[w, rows]])
            if len(rows) >= k:
                least = np.partition(values, len(rows) - k)[len(rows) - k]
                kept = values >= least - _TOLERANCE * max(1.0, abs(least))
                rows, values = rows[kept], values[kept]
                bounds[i] = min(bounds[i], max(0.0, base[i] - 2 * float(least)))
            found[i] = rows, values

    def _exact(self, found: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        exact = (self.vectors[found] * query).sum(axis=1)  # summed the same way wherever a vector lies
        if len(found) > k:
            kept = exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
            found, exact = found[kept], exact[kept]
        return self.order[found], exact


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id``, ``vector`` (doubles), ``h1``, ``h2`` (its 128-bit hash) of the rows that take part: not null, not zero,
    without null or non-finite components."""
    column = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") + F.lit(0.0))
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), column.alias("vector")).filter(
        "id IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> coalesce(abs(x) < double('infinity'), false)) "
        "AND exists(vector, x -> x <> 0)")
    return rows.select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2"))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def search(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding",
           seed: int = 42, confidence: float = CONFIDENCE) -> DataFrame:
    """Each query's ``k`` nearest vectors by inner product, its own id left out: query_id, rank (from 1), vec_id, score.

    Both tables have ``vec_id`` and ``vector``. Ties go to the smaller id; with fewer candidates all are returned. Null
    ids, and vectors that are null, zero or hold null or non-finite components, take no part, nor do vectors whose
    length is not the most frequent one (of equals the greatest). Repeated rows count once; empty tables give no rows.
    """
    spark = vectors.sparkSession
    ready(spark)
    wanted = k + 1  # one may be the query itself
    rows = written(usable(vectors, vec_id, vector).dropDuplicates(["id", "h1", "h2"]), "vectors")
    asked = written(usable(queries, vec_id, vector).dropDuplicates(["id", "h1", "h2"]), "queries")
    schema = T.StructType.fromDDL("query_id long, rank int, vec_id long, score double")
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["d"]
    rows, asked = rows.filter(F.size("vector") == dims), asked.filter(F.size("vector") == dims)

    per_vector = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.select("id", "h1", "h2").withColumn("n", F.row_number().over(per_vector)).filter(F.col("n") <= wanted)
    few = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = rows.groupBy("h1", "h2").agg(F.first("vector").alias("vector"))
    entries = written(distinct.join(few, ["h1", "h2"]), "entries")
    questions = written(asked.groupBy("h1", "h2").agg(F.first("vector").alias("vector")), "questions")

    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    count, norm = entries.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    projection = Projection(np.random.default_rng(seed).standard_normal((dims + 1, PROJECTED)), float(norm) * (1 + 1e-12))
    share = min(1.0, SAMPLE / count)
    drawn = entries.filter(F.col("h1").bitwiseAND(0xFFFFFFF) / F.lit(float(1 << 28)) < share).select("vector")
    sample = _projected(drawn, projection)
    tree, _ = build_tree(sample, max(1, min(-(-count // CELL), len(sample) // 8)))
    blocks = max(1, -(-count // (len(tree.low) * BLOCK)))
    stop = chi_square_quantile(confidence, PROJECTED)

    spread = _with_cells(entries, tree, projection, blocks)
    search_cell = _searcher(projection, wanted, stop)
    home = _in_cells(questions.withColumn("bound", F.lit(math.inf)), True, blocks, tree, projection, stop)
    first = written(_met(spread, home, search_cell), "found")
    reached = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bound = F.when(F.col("n") >= wanted, F.lit(projection.norm ** 2) + F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
                   - 2 * F.col("least")).otherwise(F.lit(math.inf))
    bounded = questions.join(reached, ["h1", "h2"], "left").select("h1", "h2", "vector", bound.alias("bound"))
    visits = _in_cells(bounded, False, blocks, tree, projection, stop)
    found = first.unionByName(_met(spread, visits, search_cell))
    near = found.select("h1", "h2", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    near = written(near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= wanted).drop("n"), "near")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return asked.select(F.col("id").alias("query_id"), "h1", "h2").join(near, ["h1", "h2"]).filter("vec_id <> query_id") \
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _projected(drawn: DataFrame, projection: Projection) -> np.ndarray:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                points = projection.of_vectors(_matrix(batch.column(0).to_pandas()))
                yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.list_(pa.float64()))], ["p"])

    points = drawn.mapInArrow(run, "p array<double>").toPandas()["p"]
    return _matrix(points) if len(points) else np.zeros((1, projection.matrix.shape[1]))


def _with_cells(entries: DataFrame, tree: Tree, projection: Projection, blocks: int) -> DataFrame:
    """Each entry with the number of its cell's block."""
    shared = entries.sparkSession.sparkContext.broadcast((tree, projection))
    schema = T.StructType([*entries.schema, T.StructField("cell", T.LongType())])

    def run(frames):
        own, projected = shared.value
        for frame in frames:
            if len(frame):
                cells = own.locate(projected.of_vectors(_matrix(frame["vector"])))
                yield frame.assign(cell=cells * blocks + frame["h2"].to_numpy() % blocks)

    return entries.mapInPandas(run, schema)


def _in_cells(questions: DataFrame, first: bool, blocks: int, tree: Tree, projection: Projection, stop: float) -> DataFrame:
    """Each question with the blocks to search: one of its own cell (first round), or all others that may hold better."""
    shared = questions.sparkSession.sparkContext.broadcast((tree, projection))
    schema = T.StructType([*questions.schema, T.StructField("cell", T.LongType())])

    def run(frames):
        own, projected = shared.value
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at:at + 256]
                points = projected.of_queries(_matrix(part["vector"]))
                if first:
                    yield part.assign(cell=own.locate(points) * blocks)
                    continue
                visits = [np.flatnonzero(own.squared_distance(p) <= stop * b) for p, b in zip(points, part["bound"])]
                cells = [(v[:, None] * blocks + np.arange(blocks)).ravel() for v in visits]
                cells = [c[c != h] for c, h in zip(cells, own.locate(points) * blocks)]
                yield part.loc[part.index.repeat([len(c) for c in cells])].assign(cell=np.concatenate(cells))

    return questions.mapInPandas(run, schema)


def _dealt(entries: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``part``: the questions of each ``cell`` in parts of about ``QUESTIONS``, its entries once per part."""
    size = F.ceil(F.count(F.lit(1)) / QUESTIONS).cast("long").alias("parts")
    parts = written(questions.groupBy("cell").agg(size), "parts")
    repeated = entries.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = questions.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("h1", "h2"), "parts"))
    return repeated.drop("parts"), dealt.drop("parts")


def _met(entries: DataFrame, questions: DataFrame, search_cell) -> DataFrame:
    repeated, dealt = _dealt(entries, questions)
    return repeated.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(search_cell, _FOUND)


def _searcher(projection: Projection, wanted: int, stop: float):
    """Search one block for its questions."""

    def run(entries: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(entries) and len(questions):
            cell, ids = Cell(_matrix(entries["vector"]), projection), entries["ids"].to_list()
            for at in range(0, len(questions), 1024):  # a row of distances to all leaves for each
                part = questions.iloc[at:at + 1024]
                vectors = _matrix(part["vector"])
                points = projection.of_queries(vectors)
                searched = cell.search(vectors, points, wanted, part["bound"].to_numpy(), stop)
                for h1, h2, (found, scores) in zip(part["h1"], part["h2"], searched):
                    out += [(h1, h2, s, ids[r]) for r, s in zip(found, scores)]
        return pd.DataFrame(out, columns=["h1", "h2", "score", "ids"])

    return run
