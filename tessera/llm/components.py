"""Connected components of an undirected graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

MAX_ROUNDS = 60
#: Parts into which the links of one node are dealt for a join.
SALT = 16


def salted(links: DataFrame, least: DataFrame) -> DataFrame:
    """Joins each link to the row of its ``a``; the links of a hub are spread over tasks."""
    parts = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int")).join(parts, ["a", "salt"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node that ``links`` (long ``a``, ``b``) lead to. Nodes without a
    link are left out. Each round hangs every node on the smallest neighbour of its neighbours, until
    all links are stars; a table is written each round, and no node's neighbours are ever gathered."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.table(edges, f"{name}-0")
    last = None
    for turn in range(1, MAX_ROUNDS):
        # large star: larger neighbours of a node go to its smallest neighbour or itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = salted(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours of a node, and itself, go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted(large, least).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = scratch.table(small.where("a <> b").distinct(), f"{name}-{turn}")
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        scratch.drop(f"{name}-{turn - 1}")
        if mark == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last = mark
    raise ValueError("the components did not settle")
