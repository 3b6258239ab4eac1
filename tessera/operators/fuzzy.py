"""Typo-tolerant symbol search: trigram candidates, then bounded edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_symbol, trigrams

MAX_DISTANCE = 4


def candidates(symbols: DataFrame, query: str, k: int = 5) -> DataFrame:
    """key, norm, jaccard of the max(k, 50) * 4 symbols that share most trigrams with the query, one at least.

    The query's trigrams are a literal, so each symbol is judged in the scan and only the best move.
    """
    asked = trigrams(normalise_symbol(F.lit(query)))
    own = symbols.select("key").distinct().withColumn("norm", normalise_symbol(F.col("key"))).withColumn("grams", trigrams(F.col("norm")))
    hits = F.size(F.array_intersect("grams", asked))
    scored = own.withColumn("hits", hits).where("hits > 0")
    scored = scored.withColumn("jaccard", F.col("hits") / (F.size(asked) + F.size("grams") - F.col("hits")))
    return scored.select("key", "norm", "jaccard").orderBy(F.col("jaccard").desc(), "key").limit(max(k, 50) * 4)


def search(symbols: DataFrame, query: str, k: int = 5, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """key, distance, jaccard, rank: by distance, then the exact spelling, overlap and key."""
    asked = normalise_symbol(F.lit(query))
    found = candidates(symbols, query, k).withColumn("distance", F.levenshtein(asked, "norm", max_distance)).where("distance >= 0")
    order = [F.col("distance"), (F.col("key") == query).desc(), F.col("jaccard").desc(), F.col("key")]
    top = found.orderBy(*order).limit(k)
    rank = (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")
    return top.select("key", F.col("distance").cast("long").alias("distance"), F.round("jaccard", 6).alias("jaccard"), rank.alias("rank"))


def search_table(symbols: DataFrame, queries: DataFrame, k: int = 5, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """qid, key, distance, jaccard, rank: :func:`search` for a table of queries (qid, text). Symbols and queries meet
    on their trigrams, and only counts of shared trigrams leave the join."""
    own = symbols.select("key").distinct().withColumn("grams", trigrams(normalise_symbol(F.col("key"))))
    asked = queries.where("text is not null").select("qid", "text", trigrams(normalise_symbol(F.col("text"))).alias("grams"))
    here = own.select("key", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    there = asked.select("qid", "text", F.size("grams").alias("m"), F.explode("grams").alias("gram"))
    shared = here.join(there, "gram").groupBy("qid", "key").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("text").alias("text"))
    scored = shared.withColumn("jaccard", F.col("hits") / (F.col("m") + F.col("n") - F.col("hits")))
    likely = Window.partitionBy("qid").orderBy(F.col("jaccard").desc(), "key")
    near = scored.withColumn("place", F.row_number().over(likely)).where(F.col("place") <= max(k, 50) * 4)
    near = near.withColumn("distance", F.levenshtein(normalise_symbol(F.col("text")), normalise_symbol(F.col("key")), max_distance)).where("distance >= 0")
    order = Window.partitionBy("qid").orderBy("distance", (F.col("key") == F.col("text")).desc(), F.col("jaccard").desc(), "key")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", "key", F.col("distance").cast("long").alias("distance"), F.round("jaccard", 6).alias("jaccard"), (F.col("rank") - 1).cast("long").alias("rank"))


def search_documents(docs: DataFrame, query: str, k: int = 5, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Hits with their values; the score is the overlap."""
    hits = search(docs, query, k, max_distance).select("key", F.col("jaccard").alias("score"), "rank")
    return docs.join(F.broadcast(hits), "key").select("key", "value", "score", "rank")  # k rows
