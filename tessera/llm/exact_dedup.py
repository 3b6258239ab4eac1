"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, an external sort places equal texts next to each
other, and comparing neighbours in full cuts the order into runs of equals. The order is the beginning of
the text, a hash (so that splitters stay short where texts agree for long), the whole text, and the
identifier, which lets splitters cut a group of copies of any size like any other stretch. A run that
lies inside a partition is a whole group. Runs whose hash stands at a partition's first or last row may
go on next door: there are about two for each partition, and they are compared by their whole texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from ..sources.scratch import Scratch, shuffle_partitions

#: Characters of a text that the splitters hold.
PREFIX_CHARS = 64
_RUNS = "run long, doc_id long, size long, text_sha256 string, edge string"


def normalise(text):
    """White space of ASCII becomes one space; null counts as empty."""
    return F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(""))


def _rows(run, doc_id, size=None, sha=None, edge=None) -> pa.RecordBatch:
    n = len(run)
    columns = [pa.array(run, pa.int64()), doc_id, pa.array(size or [None] * n, pa.int64()), pa.array(sha or [None] * n, pa.string()), pa.array(edge or [None] * n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["run", "doc_id", "size", "text_sha256", "edge"])


def _runs(batches):
    """Rows of one sorted partition: a row for each with the number of its run, and a row for each run with
    its first identifier, its size, its digest, and its text where it may go on in another partition."""
    number, first_hash, open_, held = -1, None, None, []

    def told(runs, last=False):
        # a run: number, head, size, digest, text, hash
        edges = [r[4] if last or r[5] == first_hash else None for r in runs]
        return _rows([r[0] for r in runs], pa.array([r[1] for r in runs], pa.int64()), [r[2] for r in runs], [r[3] for r in runs], edges)

    for batch in batches:
        if not (n := batch.num_rows):
            continue
        text, hashes, ids = batch["norm"], batch["hash"].to_pylist(), batch["doc_id"]
        if first_hash is None:
            first_hash = hashes[0]
        same = np.empty(n, bool)
        same[0] = open_ is not None and open_[4] == text[0].as_py()
        same[1:] = np.asarray(pc.equal(text.slice(1), text.slice(0, n - 1)))
        yield _rows(number + np.cumsum(~same), ids)
        starts = np.flatnonzero(~same)
        if open_ is not None:
            open_[2] += int(starts[0]) if len(starts) else n
        data, offsets = W.string_buffers(text)
        done = []
        for at, end in zip(starts.tolist(), np.append(starts, n)[1:].tolist(), strict=True):
            if open_ is not None:
                held.append(open_)
                if open_[5] != hashes[at]:
                    done, held = done + held, []
            number += 1
            raw = data[offsets[at] : offsets[at + 1]].tobytes()
            keep = hashes[at] == first_hash or end == n or hashes[end] == hashes[at]
            open_ = [number, ids[at].as_py(), end - at, hashlib.sha256(raw).hexdigest(), raw.decode() if keep else None, hashes[at]]
        if done:
            yield told(done)
    if open_ is not None:
        yield told([*held, open_], True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after :func:`normalise`; the smallest identifier of equals stays.
    Null and empty texts are one group. Rows that repeat an identifier count one by one, and all of
    those with the smallest are marked kept. A null identifier sorts after every other, so such a row
    stays only where its group has no identifier; keep_id is null then. Other columns are ignored. An
    empty table gives an empty result.
    """
    W.bound_batches()
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), normalise(docs[text_col]).alias("norm"))
    keyed = texts.select("doc_id", "norm", F.substring("norm", 1, PREFIX_CHARS).alias("prefix"), F.xxhash64("norm").alias("hash"))
    last = F.col("doc_id").asc_nulls_last()
    content = keyed.repartitionByRange(shuffle_partitions(spark), "prefix", "hash", last).sortWithinPartitions("prefix", "hash", "norm", last)
    rows = content.select("doc_id", "norm", "hash").mapInArrow(_runs, _RUNS).withColumn("part", F.spark_partition_id())
    rows = scratch.table(rows, "runs")
    scratch.free()
    runs = rows.where("size is not null").select("part", "run", F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size"), "text_sha256", "edge")
    edges = runs.where("edge is not null")
    joined = edges.groupBy("edge").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    across = edges.select("part", "run", "text_sha256", "edge").join(joined, "edge")
    groups = runs.where("edge is null").drop("edge").unionByName(across.drop("edge"))
    members = rows.where("size is null").select("part", "run", "doc_id")
    return members.hint("merge").join(groups.hint("merge"), ["part", "run"]).select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"
    )
