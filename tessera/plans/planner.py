"""Choosing the searches of a query and fusing their ranked lists."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_symbol_like, looks_symbol_like
from ..operators import fuzzy, graph, vector
from ..operators import keyword
from ..operators.keyword import rank_hits

RRF_K = 60
SYMBOL_BYTES = 32


@dataclass
class QuerySpec:
    text: str | None = None
    symbol: str | None = None
    vector: list[float] | None = None
    relations: list[str] = field(default_factory=list)
    top_k: int = 10
    max_depth: int = 3
    #: SQL patterns of keys; only keys that fit one of them are searched. None: all keys.
    key_like: list[str] | None = None
    #: Seconds that a search of a database may take.
    timeout: float | None = None


def plan(spec: QuerySpec) -> list[str]:
    """The searches to run: graph if relations are given; fuzzy and keyword for a short text that looks like
    a symbol, else keyword for text, vector for a vector, fuzzy for a symbol; vector whenever there is one."""
    steps = ["graph"] if spec.relations else []
    if spec.text and is_symbol_like(spec.text) and len(spec.text.encode()) <= SYMBOL_BYTES:
        steps += ["fuzzy", "keyword"]
    elif spec.text:
        steps += ["keyword"]
    elif spec.vector is not None:
        steps += ["vector"]
    elif spec.symbol:
        steps += ["fuzzy"]
    if spec.vector is not None:
        steps += ["vector"]
    return list(dict.fromkeys(steps))


def plan_column(text: Column, symbol: Column, has_vector: Column, has_relations: Column) -> Column:
    """:func:`plan` over a table of queries, as a comma-separated string."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    short = some(text) & looks_symbol_like(text) & (F.octet_length(text) <= SYMBOL_BYTES)
    main = F.when(short, F.array(F.lit("fuzzy"), F.lit("keyword"))).when(some(text), F.array(F.lit("keyword"))).when(has_vector, F.array(F.lit("vector"))).when(some(symbol), F.array(F.lit("fuzzy"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    steps = F.concat(F.when(has_relations, F.array(F.lit("graph"))).otherwise(none), main, F.when(has_vector, F.array(F.lit("vector"))).otherwise(none))
    return F.array_join(F.array_distinct(steps), ",")


def fuse(lists: list[DataFrame], top_k: int = 10, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists of (key, rank from 0): key, score, rank."""
    all_ = reduce(DataFrame.unionByName, [x.select("key", "rank") for x in lists])
    scores = all_.groupBy("key").agg(F.round(F.sum(1.0 / (k + 1 + F.col("rank"))), 9).alias("score"))
    return rank_hits(scores, top_k)


@dataclass
class Indexes:
    """What a fused query may search. ``docs``: key, value. ``vectors``: key, vector. ``edges``: src, dst, relation.
    ``postings``: what :func:`keyword.index` makes of ``docs``, if it is stored."""

    docs: DataFrame
    vectors: DataFrame | None = None
    edges: DataFrame | None = None
    postings: DataFrame | None = None


def search(indexes: Indexes, spec: QuerySpec) -> DataFrame:
    """key, score, rank of the fused lists, each fetched to twice the wanted length. Keys are filtered before any
    list is cut, and the keyword numbers are those of the keys that are left."""
    n, lists = 2 * spec.top_k, []
    fits = F.lit(True) if spec.key_like is None else reduce(lambda a, b: a | b, [F.col("key").like(p) for p in spec.key_like], F.lit(False))
    if spec.key_like is not None:
        some = lambda df: df if df is None else df.where(fits)
        indexes = Indexes(indexes.docs.where(fits), some(indexes.vectors), indexes.edges, some(indexes.postings))
    for step in plan(spec):
        if step == "keyword":
            lists.append(keyword.bm25(indexes.docs, spec.text, n) if indexes.postings is None else keyword.search(indexes.postings, spec.text, n))
        elif step == "fuzzy":
            lists.append(fuzzy.search(indexes.docs, spec.symbol or spec.text, n))
        elif step == "vector" and indexes.vectors is not None:
            lists.append(vector.search(indexes.vectors, spec.vector, n))
        elif step == "graph" and indexes.edges is not None and spec.text:
            walk = graph.bfs(indexes.edges, spec.text, "forward", spec.max_depth, spec.relations[0])
            near = walk.where("depth > 0").where(fits).select("key", (1 / (1 + F.col("depth"))).alias("score"))
            lists.append(rank_hits(near, n))
    if not lists:
        return indexes.docs.limit(0).select("key", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    return fuse(lists, spec.top_k)


def search_documents(indexes: Indexes, spec: QuerySpec) -> DataFrame:
    """Hits with their values; a hit without a record has an empty value. The ``top_k`` hits are found first, so
    that their keys are a filter that reaches the scan of the values."""
    found = search(indexes, spec).select("key", "score", "rank").collect()
    hits = F.broadcast(indexes.docs.sparkSession.createDataFrame(found, "key string, score double, rank long"))  # top_k rows
    values = indexes.docs.where(F.col("key").isin([r["key"] for r in found])).select("key", "value")
    return hits.join(values, "key", "left").select("key", F.coalesce("value", F.lit("")).alias("value"), "score", "rank")
