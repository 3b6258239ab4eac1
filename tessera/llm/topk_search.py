"""Exact top-k inner-product search over norm-sorted blocks.

Vectors become integers and are range-partitioned by descending length into blocks. All are turned by
one rotation, the eigenvectors of their Gram matrix (the SVD's right vectors), which puts most of an
inner product into the first coordinates. Each block of queries first meets the block of the longest
vectors, which gives each query a floor: its k-th score and the row that has it. Blocks whose lengths
alone bound all scores below the floors (Cauchy-Schwarz) are never sent. In the others the sum over the
first coordinates plus the product of the residual lengths bounds each score, and only pairs that may
reach the floor get their exact integer score; of equal scores only smaller identifiers pass. Query and
candidate blocks meet in tasks of bounded size; no pair of rows is a row of any table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from ..sources.scratch import Scratch

BLOCK = 8192
QUERY_BLOCK = 2048
#: Queries of a block that are bounded at a time.
ROWS = 256
#: Longer vectors take no part: their products may not fit 64 bits.
LONGEST = 2.0**31
#: Coordinates of the first, pruning sum.
HEAD = 16


def to_integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part and their floor(scale * x) as a matrix; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    values = np.floor(np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) * scale)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1)).astype(np.int64)
    sizes = np.maximum(lengths, 0)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (lengths >= 0) & (bad[ends] == bad[ends - sizes])
    width = int(sizes.max(initial=0))
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = np.where(np.isfinite(values), values, 0)
    return np.flatnonzero(good), out[good]


def _integers(scale):
    def run(batches):
        for b in batches:
            rows, m = to_integers(b["embedding"], scale)
            with np.errstate(over="ignore"):
                fits = np.sqrt((m * m).sum(1)) < LONGEST
            rows, m = rows[fits], m[fits]
            if len(rows):
                ids = b["vec_id"].take(pa.array(rows))
                flat = pa.array(m.astype(np.int64).ravel())
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * m.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([ids, vec, pa.array(np.sqrt((m * m).sum(1)))], ["vec_id", "vec", "norm"])

    return run


def _gram(width):
    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b["vec"], width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.asarray(pa.compute.list_value_length(column)).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(float)
    out = np.zeros((len(lengths), width))
    starts = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return out


def _pack(width):
    """A row for each group of rows that share a block: identifiers, row keys and components as bytes."""

    def run(key, pdf):
        pdf = pdf.sort_values(["norm", "vec_id", "key"], ascending=[False, True, True])
        m = _matrix(pa.array(pdf["vec"].to_numpy()), width).astype(np.int32)
        return pd.DataFrame({"block": [key[0]], "longest": [pdf["norm"].max()], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "keys": [pdf["key"].to_numpy(np.int64).tobytes()], "vectors": [m.tobytes()]})

    return run


def _unpack(row, width):
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["keys"], np.int64), np.frombuffer(row["vectors"], np.int32).reshape(-1, width).astype(float)


#: The floor of a query: score, identifier and key of the k-th row so far.
_FLOOR = np.dtype([("score", float), ("id", np.int64), ("key", np.int64)])


def _meet(width, k, rotation):
    """Scores of a block of queries against one of candidates, whose parts come by descending length: the k best
    of each query that pass its floor, which rises on the way."""
    top = rotation[:, :HEAD]
    rest = lambda m, h: np.sqrt(np.maximum((m * m).sum(1) - (h * h).sum(1), 0))

    def score(q, floors, c, longest):
        (qid, qkey, qm), (cid, ckey, cm) = q, c
        qnorm = np.sqrt((qm * qm).sum(1))
        ch = cm @ top
        crest = rest(cm, ch)
        exact = np.abs(qm).max(initial=0) * np.abs(cm).max(initial=0) * width < 2.0**52
        every = np.flatnonzero(qnorm * longest * (1 + 1e-9) + 1e-6 >= floors["score"])
        for lo in range(0, len(every), ROWS):
            live = every[lo : lo + ROWS]
            qh = qm[live] @ top
            may = qh @ ch.T
            may += np.outer(rest(qm[live], qh), crest)
            may = may + (1e-6 + 1e-9 * qnorm[live, None] * longest) >= floors["score"][live, None]
            for row, i in enumerate(live):
                at = np.flatnonzero(may[row] & (ckey != qkey[i]))
                if not len(at):
                    continue
                s = (cm[at] @ qm[i]).astype(np.int64) if exact else cm[at].astype(np.int64) @ qm[i].astype(np.int64)
                f = floors[i]
                passes = (s > f["score"]) | ((s == f["score"]) & ((cid[at] < f["id"]) | ((cid[at] == f["id"]) & (ckey[at] < f["key"]))))
                at, s = at[passes], s[passes]
                best = np.lexsort((ckey[at], cid[at], -s))[:k]
                if len(best):
                    yield i, (ckey[at[best]], cid[at[best]], s[best])

    def run(left, right):
        found = [(np.zeros(0, np.int64),) * 5]
        for _, q in left.iterrows():
            packed = _unpack(q, width)
            floors = np.frombuffer(q["floors"], _FLOOR).copy() if q["floors"] is not None else np.full(len(packed[0]), np.array((-np.inf, 0, 0), _FLOOR))
            held: dict[int, tuple] = {}
            for _, c in right.sort_values("longest", ascending=False).iterrows():
                for i, more in score(packed, floors, _unpack(c, width), c["longest"]):
                    keys, ids, scores = (np.concatenate(x) for x in zip(held[i], more, strict=True)) if i in held else more
                    best = np.lexsort((keys, ids, -scores))[:k]
                    held[i] = keys[best], ids[best], scores[best]
                    if len(best) == k:
                        floors[i] = scores[best[-1]], ids[best[-1]], keys[best[-1]]
            found += [(np.full(len(x[0]), packed[1][i]), np.full(len(x[0]), packed[0][i]), *x) for i, x in held.items()]
        return pd.DataFrame({n: np.concatenate(v) for n, v in zip(["query_key", "query_id", "key", "vec_id", "score"], zip(*found, strict=True), strict=True)})

    return run


def _floors(width, k, longest):
    """Adds to a query block the floors that its first meeting set, and how many of the blocks after the first
    (by ``longest``, their greatest lengths, descending) may still hold a score that reaches one of them."""

    def run(left, right):
        left = left.copy()
        best = right.sort_values(["query_key", "score", "vec_id", "key"], ascending=[True, False, True, True])
        kth = best.groupby("query_key").nth(k - 1)
        known = dict(zip(kth["query_key"], zip(kth["score"], kth["vec_id"], kth["key"], strict=True), strict=True))
        floors, blocks = [], []
        for _, q in left.iterrows():
            _, keys, m = _unpack(q, width)
            f = np.array([known.get(x, (-np.inf, 0, 0)) for x in keys.tolist()], _FLOOR)
            norm = np.sqrt((m * m).sum(1))
            with np.errstate(divide="ignore"):
                reach = np.where(f["score"] > 0, f["score"] / norm * (1 - 1e-9) - 1e-6, -np.inf).min(initial=np.inf)
            floors.append(f.tobytes())
            blocks.append(int((longest >= reach).sum()))
        left["floors"], left["blocks"] = floors, np.array(blocks, np.int32)
        return left

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k highest integer inner products of every query row with every other row.

    ``is_query`` is a condition on ``vec_id``. Returns query_id, rank (from 1), vec_id, score; ties go
    to the smaller vec_id; a query gets fewer than k rows only where there are fewer candidates. Null
    vectors, those with null or non-finite components, those of length 2^31 and more (as integers; their
    products may not fit a long) and rows without identifier take no part; shorter vectors count as
    ending in zeros. Rows that repeat an identifier are candidates one by one, and each query row that
    repeats one gets its own k rows. Other columns are ignored; an empty table gives an empty result.
    """
    scores = scored(vectors, is_query, k, scale, id_col, vector_col, block, query_block)
    best = Window.partitionBy("query_key").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("key"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored(vectors: DataFrame, is_query, k: int, scale: float, id_col: str, vector_col: str, block: int, query_block: int) -> DataFrame:
    """query_key, query_id, key, vec_id, score: for each query at most k rows of each block that it met."""
    W.bound_batches()
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    schema = "query_key long, query_id long, key long, vec_id long, score long"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding")).where("vec_id is not null")
    ints = rows.mapInArrow(_integers(scale), "vec_id long, vec array<long>, norm double")
    ints = scratch.table(ints.withColumn("key", F.monotonically_increasing_id()), "integers")
    shape = ints.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    n, width = shape["n"], max(1, shape["width"] or 1)
    if not n:
        return spark.createDataFrame([], schema)
    # a width x width matrix from each task
    gram = sum((np.frombuffer(r["gram"]).reshape(width, width) for r in ints.mapInArrow(_gram(width), "gram binary").toLocalIterator()), np.zeros((width, width)))
    rotation = np.linalg.eigh(gram)[1][:, ::-1].copy()

    order = [F.col("norm").desc(), F.col("vec_id"), F.col("key")]
    cuts = ints.repartitionByRange(max(1, -(-n // block)), *order).withColumn("block", F.spark_partition_id())
    packed = "block int, longest double, ids binary, keys binary, vectors binary"
    candidates = scratch.table(cuts.groupBy("block").applyInPandas(_pack(width), packed), "candidates", "none")
    asked = ints.where(is_query(F.col("vec_id")))
    parts = max(1, -(-asked.count() // query_block))
    part_of = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    queries = asked.withColumn("block", part_of("key")).groupBy("block").applyInPandas(_pack(width), packed).withColumnRenamed("block", "part")
    queries = scratch.table(queries.withColumn("floors", F.lit(None).cast("binary")).withColumn("blocks", F.lit(0)), "queries", "none")
    # Spark may cut finer than asked: parts that follow one another make a block
    cut = candidates.agg(F.max("block")).first()[0] + 1
    candidates = candidates.withColumn("block", F.expr(f"cast(cast(block as long) * {min(cut, max(1, -(-n // block)))} div {cut} as int)"))
    # two numbers for each block, in the order of their lengths
    lengths = [(r["block"], r["longest"]) for r in candidates.groupBy("block").agg(F.max("longest").alias("longest")).orderBy("block").collect()]
    head = lengths[0][0]

    def meet(q, c):
        return q.groupBy("part", "block").cogroup(c.groupBy("part", "block")).applyInPandas(_meet(width, k, rotation), schema)

    opening = candidates.where(F.col("block") == head).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    first = scratch.table(meet(queries.withColumn("block", F.lit(head)), opening), "first")
    if len(lengths) == 1:
        return first
    seeded = first.withColumn("part", part_of("query_key"))
    later = np.array([x for _, x in lengths[1:]])
    floored = scratch.table(queries.groupBy("part").cogroup(seeded.groupBy("part")).applyInPandas(_floors(width, k, later), queries.schema), "floored", "none")
    numbers = F.lit([b for b, _ in lengths[1:]])
    pairs = scratch.table(floored.where("blocks > 0").select("part", F.explode(F.slice(numbers, F.lit(1), F.col("blocks"))).alias("block")), "pairs")
    rest = meet(floored.join(pairs, "part"), candidates.join(pairs, "block"))
    return first.unionByName(rest)
