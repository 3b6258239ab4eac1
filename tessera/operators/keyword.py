"""Keyword search: postings, corpus statistics and BM25.

Text is tokenised once. :func:`index` makes postings that carry all a score needs, and stored (see
:func:`store`) they serve any number of queries without the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import Scratch, spread

K1, B = 1.5, 0.75


def document_tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """key, terms: the tokens of the key, then those of the value."""
    return docs.select("key", *keep, F.concat(tokens(F.col("key")), tokens(F.coalesce("value", F.lit("")))).alias("terms"))


def index(docs: DataFrame, *keep: str) -> DataFrame:
    """key, ``keep``, term, tf, dl, first: a row for each term of a document with its frequency and the document's
    length, one of them marked ``first``; a document without terms has one row with a null term.

    Frequencies are run lengths of the document's sorted terms, so no token leaves its row.
    """
    terms = document_tokens(spread(docs), *keep).select("key", *keep, F.sort_array("terms").alias("terms"))
    n = F.size("terms")
    begins = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == 1) | (F.element_at("terms", i) != F.element_at("terms", F.greatest(i - 1, F.lit(1)))))
    rows = terms.select("key", *keep, n.cast("long").alias("dl"), "terms", F.when(n > 0, begins).otherwise(F.array().cast("array<int>")).alias("begins"))
    length = lambda i, j: F.coalesce(F.get("begins", j + 1), F.col("dl") + 1) - i
    runs = F.transform("begins", lambda i, j: F.struct(F.element_at("terms", i).alias("term"), length(i, j).cast("long").alias("tf")))
    rows = rows.select("key", *keep, "dl", F.posexplode_outer(runs).alias("pos", "run"))
    return rows.select("key", *keep, "run.term", "run.tf", "dl", (F.coalesce("pos", F.lit(0)) == 0).alias("first"))


def store(postings_: DataFrame, path: str) -> None:
    """Appends postings to a table that is dealt out and sorted by term: a query reads its terms' row groups."""
    dealt = postings_.repartition("term").sortWithinPartitions("term")
    dealt.write.mode("append").option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def postings(docs: DataFrame) -> DataFrame:
    """key, term, tf."""
    return index(docs).where("term is not null").select("key", "term", "tf")


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """One row: n_docs, vocab_size, avgdl."""
    post = Scratch(docs.sparkSession, "corpus").table(index(docs), "postings")
    vocabulary = post.agg(F.count_distinct("term").alias("vocab_size"))
    return _corpus(post).join(F.broadcast(vocabulary)).select(F.col("n").alias("n_docs"), "vocab_size", "avgdl")  # one row each


def _corpus(post: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return post.where("first").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def rank_hits(scores: DataFrame, k: int) -> DataFrame:
    """The k best of (key, score) with ranks from 0; ties go to the smaller key. The ranks number k rows."""
    top = scores.orderBy(F.col("score").desc(), "key").limit(k)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy(F.col("score").desc(), "key")) - 1).cast("long"))


def _asked(spark, query: str) -> list[tuple[str, int]]:
    """The query's terms, by the same expression as the documents', and how often each is asked."""
    if not query:
        return []
    rows = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("t")).groupBy("t").count().collect()
    return sorted((r["t"], r["count"]) for r in rows)


def _idf(n, df):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def _saturated(tf, dl, avgdl, k1: float, b: float):
    return tf * (k1 + 1) / (tf + F.lit(k1) * (1 - F.lit(b) + F.lit(b) * dl / F.greatest(avgdl, F.lit(1e-9))))


def bm25(docs: DataFrame, query: str, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """key, score, rank of the k best documents of a corpus that has no stored postings.

    One pass over the text: a document keeps its length and the frequency of each query term, which are
    written, and the corpus numbers are one row beside them. A repeated query term counts again.
    """
    spark = docs.sparkSession
    asked = _asked(spark, query)
    if not asked or k <= 0:
        return spark.createDataFrame([], "key string, score double, rank long")
    terms = document_tokens(spread(docs))
    times = lambda term: F.size(F.filter("terms", lambda x: x == term))
    tf = [times(t).alias(f"tf{i}") for i, (t, _) in enumerate(asked)]
    counted = Scratch(spark, "bm25").table(terms.select("key", F.size("terms").alias("dl"), *tf), "counted")
    corpus = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))])
    score = F.lit(0.0)
    for i, (_, count) in enumerate(asked):
        score = score + count * _idf(F.col("n"), F.col(f"df{i}")) * _saturated(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"), k1, b)
    some = " or ".join(f"tf{i} > 0" for i in range(len(asked)))
    scored = counted.where(some).join(F.broadcast(corpus)).select("key", F.round(score, 6).alias("score"))  # one row
    return rank_hits(scored, k)


def search(post: DataFrame, query: str, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """key, score, rank of the k best documents of stored postings. Only the asked terms' rows are read, and
    the lengths of the ``first`` rows."""
    spark = post.sparkSession
    asked = _asked(spark, query)
    if not asked or k <= 0:
        return spark.createDataFrame([], "key string, score double, rank long")
    hits = post.where(F.col("term").isin([t for t, _ in asked]))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    times = F.create_map(*[F.lit(x) for pair in asked for x in pair])[F.col("term")]
    part = times * _idf(F.col("n"), F.col("df")) * _saturated(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    rows = hits.join(F.broadcast(df), "term").join(F.broadcast(_corpus(post)))  # a row for each asked term, and one row
    return rank_hits(rows.groupBy("key").agg(F.round(F.sum(part), 6).alias("score")), k)


def bm25_batch(post: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """qid, key, score, rank for a table of queries (qid, text) over stored postings: one equi-join on the term
    with the queries' weights, so the cost follows the postings of the asked terms and a frequent one can be split."""
    asked = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    scratch = Scratch(post.sparkSession, "bm25-batch")
    asked = scratch.table(asked, "asked")
    df = post.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, "term").join(F.broadcast(_corpus(post)))  # one row
    weights = weights.select("qid", "term", "avgdl", (F.col("times") * _idf(F.col("n"), F.col("df"))).alias("weight"))
    weights = scratch.table(weights, "weights")  # so that its size, and not that of its plan, decides the join
    part = F.col("weight") * _saturated(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    totals = post.join(weights, "term").groupBy("qid", "key").agg(F.round(F.sum(part), 6).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "key")
    ranked = totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", (F.col("rank") - 1).cast("long"))
