"""Table and column lineage.

Edges have ``pipeline, execution, source_table, target_table`` and ``columns``, an array of
``struct<source_column, target_column, type, expression, depends_on>``.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.columns import all_of, field
from millrace.operators import skew
from millrace.session import materialize

RULES_JSON = ("array<struct<source:string,target:string,type:string,format:string,"
              "params:map<string,string>,order:int>>")


def from_rules(pipelines: DataFrame, rules: str = "rules") -> DataFrame:
    """Edges from a table of pipelines (pipeline, execution, source_table, target_table, rules as JSON)."""
    parsed = F.from_json(field(rules), RULES_JSON)

    def mapped(rule: Column) -> Column:
        names = F.when(rule["type"] == "Concatenate",
                       F.filter(F.transform(F.split(rule["source"], ","), lambda s: F.trim(s)), lambda s: s != "")) \
            .otherwise(F.array(rule["source"]))
        expression = F.coalesce(F.element_at(rule["params"], F.lit("expression")), rule["format"])
        return F.struct(
            rule["source"].alias("source_column"), F.coalesce(rule["target"], rule["source"]).alias("target_column"),
            rule["type"].alias("type"), expression.alias("expression"), names.alias("depends_on"))

    return pipelines.select("pipeline", "execution", "source_table", "target_table",
                            F.transform(F.coalesce(parsed, F.array().cast(RULES_JSON)), mapped).alias("columns"))


def select_edges(edges: DataFrame, pipeline=None, execution=None, source_table=None, target_table=None) -> DataFrame:
    """Edges meeting every given value."""
    wanted = {"pipeline": pipeline, "execution": execution, "source_table": source_table, "target_table": target_table}
    return edges.filter(all_of([field(n) == F.lit(v) for n, v in wanted.items() if v is not None]))


def _walk(steps: DataFrame, roots: DataFrame, node: list[str], depth: int | None, max_group_rows: int) -> DataFrame:
    """Nodes within ``depth`` steps of each root (None: all reachable): (root…, node…, depth), each once at its
    smallest depth.

    ``steps`` has ``from_<n>`` and ``to_<n>`` for each node column, ``roots`` has the node columns. Each level
    joins the frontier to the steps and drops what was visited, so cycles end. A level is written to the shared
    folder before the next one reads it; otherwise every level would compute all earlier ones twice. Without a limit the
    walk doubles its reach instead, see :func:`_closure`.
    """
    if depth is None:
        return _closure(steps, roots, node, max_group_rows)
    root = [f"root_{n}" for n in node]
    leaving = [f"from_{n}" for n in node]
    steps = steps.distinct()
    if depth != 1:
        steps = materialize(steps)
    heavy = skew.heavy_groups(steps, leaving, max_group_rows)
    if heavy:
        few_steps, big_steps = skew.split_heavy(steps, leaving, heavy)
        parts = few_steps, skew.numbered(big_steps, "__rid"), heavy, skew.tiles(skew.NONE, heavy, max_group_rows)
    frontier = roots.distinct().select(*[field(n).alias(r) for n, r in zip(node, root)], *[field(n) for n in node])
    seen, levels = frontier, []
    for level in count(1):
        reached = (_hop(frontier, *parts, node, leaving) if heavy else frontier.join(steps, _met(node, leaving))) \
            .select(*root, *[F.col(f"to_{n}").alias(n) for n in node]).distinct()
        fresh = reached.join(seen, root + node, "left_anti")
        if level != depth:
            fresh = materialize(fresh)
            if fresh.isEmpty():
                break
        levels.append(fresh.withColumn("depth", F.lit(level)))
        if level == depth:
            break
        seen, frontier = seen.unionByName(fresh), fresh
    if not levels:
        return frontier.withColumn("depth", F.lit(0)).filter(F.lit(False))
    return reduce(DataFrame.unionByName, levels)


def _closure(steps: DataFrame, roots: DataFrame, node: list[str], max_group_rows: int) -> DataFrame:
    """All nodes reachable from each root, at their smallest depth, in about log2(depth) rounds.

    ``pairs`` holds the smallest number of steps between nodes that are at most 2^r apart. A round goes on from every
    node reached by any pair, which doubles the reach, and then joins the pairs to themselves. Sums of two least numbers
    give the least, since a shortest way is cut at any of its nodes into two. A round that reaches nothing new is the last.
    """
    root, leaving, arriving = [f"root_{n}" for n in node], [f"from_{n}" for n in node], [f"to_{n}" for n in node]
    pairs = materialize(steps.filter(~all_of([F.col(a).eqNullSafe(F.col(b)) for a, b in zip(leaving, arriving)]))
                        .select(*leaving, *arriving).distinct().withColumn("steps", F.lit(1)))
    start = roots.distinct()
    reach = materialize(start.select(*[field(n).alias(r) for n, r in zip(node, root)], *[field(n) for n in node], F.lit(0).alias("depth")))
    known = reach.count()
    while True:
        reach = materialize(_round(reach, pairs, root, node, leaving, arriving, max_group_rows))
        count = reach.count()
        if count == known:
            return reach.filter("depth > 0")
        known = count
        on = pairs.select(*leaving, *[F.col(a).alias(n) for a, n in zip(arriving, node)], F.col("steps").alias("depth"))
        both = _round(on, pairs, leaving, node, leaving, arriving, max_group_rows)
        pairs = materialize(both.select(*leaving, *[F.col(n).alias(a) for a, n in zip(arriving, node)], F.col("depth").alias("steps"))
                            .filter(~all_of([F.col(a).eqNullSafe(F.col(b)) for a, b in zip(leaving, arriving)])))


def _round(reach: DataFrame, pairs: DataFrame, origin: list[str], node: list[str], leaving: list[str], arriving: list[str],
           max_group_rows: int) -> DataFrame:
    """What is reached, and what the pairs add: (origin…, node…, depth), each once at its smallest depth."""
    heavy = skew.heavy_groups(pairs, leaving, max_group_rows)
    names = {f: f"__{f}" for f in leaving}  # the origin may bear the same names
    onward = pairs.select(*[F.col(f).alias(n) for f, n in names.items()], *arriving, "steps")
    if heavy:
        few, big = skew.split_heavy(onward, list(names.values()), heavy)
        parts = few, skew.numbered(big, "__rid"), heavy, skew.tiles(skew.NONE, heavy, max_group_rows)
        met = _hop(reach, *parts, node, list(names.values()))
    else:
        met = reach.join(onward, _met(node, list(names.values())))
    added = met.select(*origin, *[F.col(a).alias(n) for a, n in zip(arriving, node)], (F.col("depth") + F.col("steps")).alias("depth"))
    return reach.unionByName(added).groupBy(*origin, *[field(n) for n in node]).agg(F.min("depth").alias("depth"))


def _met(node: list[str], leaving: list[str]) -> Column:
    return all_of([F.col(a) == F.col(n) for a, n in zip(leaving, node)])


def _hop(frontier: DataFrame, few_steps: DataFrame, big_steps: DataFrame, heavy: skew.Heavy, tiles: skew.Heavy,
         node: list[str], leaving: list[str]) -> DataFrame:
    """One step from every frontier node; the steps of heavy nodes are spread over a grid of tasks."""
    few_front, big_front = skew.split_heavy(frontier, node, heavy)
    met = skew.salted_inner(skew.numbered(big_front, "__lid"), big_steps, node, leaving, _met(node, leaving), tiles)
    return few_front.join(few_steps, _met(node, leaving)).unionByName(met.drop("__lid", "__rid"))


def downstream(edges: DataFrame, roots: DataFrame, depth: int | None = 1,
               max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Tables fed by each root table (column ``table``) within ``depth`` steps (None: all): root_table, table, depth."""
    steps = edges.select(F.col("source_table").alias("from_table"), F.col("target_table").alias("to_table"))
    return _walk(steps, roots, ["table"], depth, max_group_rows)


def upstream(edges: DataFrame, roots: DataFrame, depth: int | None = 1,
             max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Tables that feed each root table within ``depth`` steps (None: all): root_table, table, depth."""
    steps = edges.select(F.col("target_table").alias("from_table"), F.col("source_table").alias("to_table"))
    return _walk(steps, roots, ["table"], depth, max_group_rows)


def graph(edges: DataFrame, roots: DataFrame, upstream_depth: int = 1, downstream_depth: int = 1,
          max_group_rows: int = skew.MAX_GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the roots: root_table, table, direction, depth; and the edges among those tables."""
    up = upstream(edges, roots, upstream_depth, max_group_rows).withColumn("direction", F.lit("upstream"))
    down = downstream(edges, roots, downstream_depth, max_group_rows).withColumn("direction", F.lit("downstream"))
    centre = roots.distinct().select(F.col("table").alias("root_table"), "table", F.lit(0).alias("depth"),
                                     F.lit("root").alias("direction"))
    nodes = centre.unionByName(up).unionByName(down)
    known = nodes.select("table").distinct()
    inside = skew.join_per_key(edges, known, ["source_table"], "left_semi", ["table"], max_group_rows)
    return nodes, skew.join_per_key(inside, known, ["target_table"], "left_semi", ["table"], max_group_rows)


def impact(edges: DataFrame, roots: DataFrame, depth: int | None = None,
           max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """All columns downstream of each root (table, column), or those within ``depth`` steps: root_table, root_column,
    table, column, depth."""
    mapped = edges.select("source_table", "target_table", F.explode("columns").alias("m"))
    steps = mapped.select(F.col("source_table").alias("from_table"), F.explode("m.depends_on").alias("from_column"),
                          F.col("target_table").alias("to_table"), F.col("m.target_column").alias("to_column"))
    return _walk(steps, roots, ["table", "column"], depth, max_group_rows)
