"""Typed relation graph: neighbours, breadth-first and depth-first traversal, over (src, dst, relation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Steps of a walk whose finds are read one by one; then they are written together, so that plans stay short.
LEVELS = 16
RELATIONS = ["imports", "calls", "inherits", "tests", "defines"]


def valid(edges: DataFrame) -> DataFrame:
    """Edges of known relations; parallel edges stay."""
    return edges.where(F.col("relation").isin(RELATIONS))


def _directed(edges: DataFrame, direction: str, relation: str | None) -> DataFrame:
    """(near, far, relation). An unknown relation filters nothing."""
    if relation in RELATIONS:
        edges = edges.where(F.col("relation") == relation)
    near, far = ("dst", "src") if direction == "backward" else ("src", "dst")
    return edges.select(F.col(near).alias("near"), F.col(far).alias("far"), "relation")


def neighbours(edges: DataFrame, key: str, direction: str = "forward", relation: str | None = None) -> DataFrame:
    """key, relation of one hop, as often as edges lead there. The filter reaches the scan."""
    return _directed(edges, direction, relation).where(F.col("near") == key).select(F.col("far").alias("key"), "relation")


def bfs(edges: DataFrame, start: str, direction: str = "forward", max_depth: int = 3, relation: str | None = None) -> DataFrame:
    """key, depth, relation (the smallest that found it; null at the start). Empty if the start has no edge.

    Each step joins the frontier, whose size Spark sees and may broadcast, with the edges. What is found
    is written as a table each step, so that plans stay short and a lost executor costs one step.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "bfs")
    steps = _directed(edges, direction, relation)
    known = edges.where((F.col("src") == start) | (F.col("dst") == start)).limit(1)
    found = known.select(F.lit(start).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("relation"))
    frontier = found = scratch.table(found, "0")
    for depth in range(1, max_depth + 1):
        next_ = steps.join(frontier.select(F.col("key").alias("near")), "near").groupBy(F.col("far").alias("key")).agg(F.min("relation").alias("relation"))
        next_ = next_.join(found.select("key"), "key", "left_anti").select("key", F.lit(depth).cast("long").alias("depth"), "relation")
        frontier = scratch.table(next_, str(depth))
        if not frontier.take(1):
            break
        found = found.unionByName(frontier)
        if depth % LEVELS == 0:
            found = scratch.table(found, f"found-{depth}")
    return found


def reachable(edges: DataFrame, start: str, direction: str = "forward", relation: str | None = None) -> DataFrame:
    return bfs(edges, start, direction, 1 << 30, relation).select("key")


def dfs(edges: DataFrame, start: str, direction: str = "forward", max_depth: int = 3, relation: str | None = None, limit: int = 100_000) -> list[tuple[str, int]]:
    """(key, depth at first visit) in preorder, the last edge of a node first; edges of a node are ordered
    by key. The walk is sequential, so it runs on the driver over the ego graph of ``max_depth`` steps and
    refuses one of more than ``limit`` edges."""
    around = bfs(edges, start, direction, max_depth, relation).select(F.col("key").alias("near"))
    near = _directed(edges, direction, relation).join(around, "near").select("near", "far").limit(limit + 1).collect()
    if len(near) > limit:
        raise ValueError(f"the ego graph has over {limit} edges")
    out: dict[str, list[str]] = {}
    for r in sorted(near):
        out.setdefault(r["near"], []).append(r["far"])
    if not around.take(1):
        return []
    seen, order, stack = set(), [], [(start, 0)]
    while stack:
        key, depth = stack.pop()
        if key in seen:
            continue
        seen.add(key)
        order.append((key, depth))
        if depth < max_depth:
            stack += [(x, depth + 1) for x in out.get(key, []) if x not in seen]
    return order


def has_node(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, found for ``wanted`` keys: whether an edge begins or ends there."""
    nodes = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("dst").alias("key")))
    held = nodes.join(wanted, "key", "left_semi").distinct().withColumn("found", F.lit(True))
    return wanted.join(held, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def counts(edges: DataFrame) -> DataFrame:
    nodes = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).agg(F.count_distinct("src").alias("node_count"))
    return edges.agg(F.count(F.lit(1)).alias("edge_count")).join(F.broadcast(nodes)).select("node_count", "edge_count")  # one row each
