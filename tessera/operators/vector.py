"""Vector search: exact nearest neighbours, and cells with a probe count for approximate ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyword import rank_hits

MIN_NORM = 1e-10


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalise(vectors: DataFrame) -> DataFrame:
    """Unit vectors of double; vectors without length are left out."""
    n = vectors.withColumn("norm", norm(F.col("vector"))).where(F.col("norm") >= MIN_NORM)
    return n.select("key", F.transform("vector", lambda x: x.cast("double") / F.col("norm")).alias("vector"))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))


def knn(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """key, distance, rank. Vectors of another dimension take no part; a query without length finds nothing."""
    length = float(np.sqrt(np.square(np.asarray(query, float)).sum())) if query else 0.0
    rows = normalise(vectors.where(F.size("vector") == len(query)))
    if length < MIN_NORM or k <= 0:
        return rows.limit(0).select("key", F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("rank"))
    asked = F.lit([float(x) / length for x in query])
    near = rows.select("key", F.round(cosine_distance(F.col("vector"), asked), 6).alias("distance"))
    ranked = rank_hits(near.select("key", (-F.col("distance")).alias("score")), k)
    return ranked.select("key", (F.lit(0.0) - F.col("score")).alias("distance"), "rank")


def search(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """key, score (1 - distance), rank."""
    return knn(vectors, query, k).select("key", F.round(1 - F.col("distance"), 6).alias("score"), "rank")


def knn_batch(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 10) -> DataFrame:
    """qid, key, distance, rank for a bounded list of queries: each task multiplies its rows with the
    query matrix and passes on k rows a query."""
    ids = np.array([q for q, _ in queries])
    matrix = np.array([v for _, v in queries], float)
    matrix /= np.maximum(np.sqrt((matrix * matrix).sum(1, keepdims=True)), MIN_NORM)

    def local(batches):
        for b in batches:
            m = np.array(b["vector"].to_pylist(), float)
            if not len(m):
                continue
            near = np.round(1 - np.clip(m @ matrix.T, -1, 1), 6) + 0.0
            keys = np.array(b["key"].to_pylist())
            for j, qid in enumerate(ids):
                at = np.lexsort((keys, near[:, j]))[:k]
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(at), pa.int64()), pa.array(keys[at]), pa.array(near[at, j])], ["qid", "key", "distance"])

    rows = normalise(vectors.where(F.size("vector") == matrix.shape[1]))
    found = rows.mapInArrow(local, "qid long, key string, distance double")
    best = Window.partitionBy("qid").orderBy("distance", "key")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", (F.col("rank") - 1).cast("long"))


def train_cells(vectors: DataFrame, cells: int = 16, sample: int = 10_000, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Centres of k-means on a bounded sample: the ``sample`` rows with the smallest key hashes. They have the
    sample's most frequent dimension; vectors of another take no part."""
    rows = [r["vector"] for r in normalise(vectors).orderBy(F.xxhash64("key")).limit(sample).select("vector").collect()]
    sizes = [len(v) for v in rows]
    data = np.array([v for v in rows if len(v) == max(set(sizes), key=sizes.count)])
    rng = np.random.default_rng(seed)
    centres = data[rng.permutation(len(data))[:cells]]
    for _ in range(rounds):
        own = (data @ centres.T).argmax(1)
        centres = np.array([data[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), MIN_NORM)
    return centres


def assign_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every vector of the centres' dimension with its cell; written partitioned by cell, it is the index."""

    def run(batches):
        for b in batches:
            m = np.array(b["vector"].to_pylist(), float).reshape(b.num_rows, -1)
            cell = (m @ centres.T).argmax(1) if len(m) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b["key"], b["vector"], pa.array(cell, pa.int32())], ["key", "vector", "cell"])

    return normalise(vectors.where(F.size("vector") == centres.shape[1])).mapInArrow(run, "key string, vector array<double>, cell int")


def probes(queries: DataFrame, centres: np.ndarray, ef: int) -> DataFrame:
    """qid, vector, cell: each query's ``ef`` nearest cells. Queries of another dimension or without length have none."""

    def run(batches):
        for b in batches:
            m = np.array(b["vector"].to_pylist(), float).reshape(b.num_rows, -1)
            near = np.argsort(-(m @ centres.T), axis=1)[:, :ef] if len(m) else np.zeros((0, ef), int)
            rows = pa.array(np.repeat(np.arange(len(m)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b["key"].cast(pa.int64()).take(rows), b["vector"].take(rows), pa.array(near.ravel(), pa.int32())], ["qid", "vector", "cell"])

    unit = normalise(queries.where(F.size("vector") == centres.shape[1]).withColumn("key", F.col("qid").cast("string")))
    return unit.mapInArrow(run, "qid long, vector array<double>, cell int")


#: Vectors and queries that meet in one task.
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 1024


def _packed(rows: DataFrame, by: str) -> DataFrame:
    """A row for each (cell, ``by``): identifiers, and vectors as bytes."""

    def run(key, pdf):
        return pd.DataFrame({"cell": [key[0]], by: [key[1]], f"{by}_ids": [pdf["id"].tolist()], f"{by}_vectors": [np.array(pdf["vector"].tolist(), float).tobytes()]})

    return rows.groupBy("cell", by).applyInPandas(run, f"cell int, {by} int, {by}_ids array<string>, {by}_vectors binary")


def _nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, key, distance, rank from ``vectors`` (key, vector, cell) and ``queries`` (qid, vector, cell), all unit
    vectors. Blocks of both meet where they share a cell, and each meeting passes on k rows a query."""
    dealt = {}
    for rows, by, size in ((vectors.select(F.col("key").alias("id"), "vector", "cell"), "block", VECTOR_BLOCK), (queries.select(F.col("qid").cast("string").alias("id"), "vector", "cell"), "part", QUERY_BLOCK)):
        counts = {r["cell"]: max(1, -(-r["count"] // size)) for r in rows.groupBy("cell").count().collect()}  # a row for each cell
        if not counts:
            return vectors.sparkSession.createDataFrame([], "qid long, key string, distance double, rank long")
        of = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("cell")]
        dealt[by] = _packed(rows.withColumn(by, F.pmod(F.xxhash64("id"), of).cast("int")), by)

    def meet(pdf):
        found = []
        for r in pdf.itertuples():
            keys, ids = np.array(r.block_ids), [int(x) for x in r.part_ids]
            m, q = (np.frombuffer(x).reshape(len(n), -1) for x, n in ((r.block_vectors, keys), (r.part_vectors, ids)))
            for lo in range(0, len(ids), 128):
                near = np.round(1 - np.clip(q[lo : lo + 128] @ m.T, -1, 1), 6) + 0.0
                for qid, d in zip(ids[lo : lo + 128], near, strict=True):
                    at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                    at = at[np.lexsort((keys[at], d[at]))[:k]]
                    found.append(pd.DataFrame({"qid": qid, "key": keys[at], "distance": d[at]}))
        return pd.concat(found) if found else pd.DataFrame({"qid": [], "key": [], "distance": []})

    met = dealt["block"].join(dealt["part"], "cell").groupBy("cell", "block", "part").applyInPandas(meet, "qid long, key string, distance double")
    best = Window.partitionBy("qid").orderBy("distance", "key")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", (F.col("rank") - 1).cast("long"))


def knn_table(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """As :func:`knn_batch` for a table of queries (qid, vector) of any size, each against all rows of its dimension."""
    unit = normalise(queries.withColumn("key", F.col("qid").cast("string"))).select(F.col("key").cast("long").alias("qid"), "vector", F.size("vector").alias("cell"))
    return _nearest(normalise(vectors).withColumn("cell", F.size("vector")), unit, k)


def ann_table(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, ef: int = 8) -> DataFrame:
    """As :func:`knn_table`, but a query meets only its ``ef`` nearest cells of ``index``."""
    return _nearest(index, probes(queries, centres, ef), k)


def ann_batch(index: DataFrame, centres: np.ndarray, queries: list[tuple[int, list[float]]], k: int = 10, ef: int = 8) -> DataFrame:
    """:func:`ann_table` for a list of queries."""
    return ann_table(index, centres, index.sparkSession.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], "qid long, vector array<double>"), k, ef)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row, ``recall``: the share of exact hits that were found."""
    hit = exact.select("qid", "key").join(found.select("qid", "key", F.lit(1.0).alias("hit")), ["qid", "key"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
