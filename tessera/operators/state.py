"""Point and range access: the state of a change log and reads from it.

A log has ``key``, ``value``, ``op`` (put or del) and ``seq``. Filters on ``key`` reach the scan: it is
the grouping key, so Catalyst moves them below the aggregate and into the Parquet reader.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The last record of each key, tombstones too: key, value, op, seq."""
    if as_of is not None:
        log = log.where(F.col("seq") <= as_of)
    last = F.max_by(F.struct("value", "op"), F.col("seq"))
    return log.groupBy("key").agg(last.alias("r"), F.max("seq").alias("seq")).select("key", "r.value", "r.op", "seq")


def live(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """key, value of what is there."""
    return latest(log, as_of).where("op = 'put'").select("key", "value")


def get(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("key") == key)


def get_batch(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``: pos, key. A row for each, in order of pos; a missing key has an empty value."""
    return wanted.join(state, "key", "left").select("pos", "key", F.coalesce("value", F.lit("")).alias("value"))


def contains(state: DataFrame, wanted: DataFrame) -> DataFrame:
    hits = wanted.join(state.select("key", F.lit(True).alias("found")), "key", "left")
    return hits.select("key", F.coalesce("found", F.lit(False)).alias("found"))


def scan(state: DataFrame, start: str, end: str, limit: int | None = None) -> DataFrame:
    """Keys from ``start`` up to but not ``end``, ascending bytes."""
    rows = state.where((F.col("key") >= start) & (F.col("key") < end)).orderBy("key")
    return rows if limit is None else rows.limit(limit)


def scan_prefix(state: DataFrame, prefix: str, limit: int = 100) -> DataFrame:
    return state.where(F.col("key").startswith(prefix)).orderBy("key").limit(limit)


def keys(state: DataFrame, prefix: str = "", limit: int = 10_000) -> DataFrame:
    return scan_prefix(state, prefix, limit).select("key")


def tombstones(state: DataFrame, start: str, end: str, seq: int) -> DataFrame:
    """Records that delete a range."""
    rows = state.where((F.col("key") >= start) & (F.col("key") < end))
    return rows.select("key", F.lit(None).cast("string").alias("value"), F.lit("del").alias("op"), F.lit(seq).cast("long").alias("seq"))


def compact(runs: list[DataFrame], drop_tombstones: bool = False) -> DataFrame:
    """Merges sorted runs; of a key's records the one with the highest seq stays."""
    merged = latest(reduce(DataFrame.unionByName, [r.select("key", "value", "op", "seq") for r in runs]))
    return merged.where("op = 'put'") if drop_tombstones else merged


def compact_history(log: DataFrame, kept: list[int], drop_tombstones: bool = True) -> DataFrame:
    """What a log (with ``namespace``) must keep so that its state now and at each seq of ``kept`` stays as it is:
    of each key the last record up to each of them and the last of all. A tombstone that hides no kept record goes."""
    bounds = sorted(set(kept))
    era = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("seq"))) if bounds else F.lit(0)
    last = F.max_by(F.struct("value", "op"), F.col("seq"))
    rows = log.groupBy("namespace", "key", era.alias("era")).agg(last.alias("r"), F.max("seq").alias("seq")).select("namespace", "key", "r.value", "r.op", "seq")
    if not drop_tombstones:
        return rows
    so_far = Window.partitionBy("namespace", "key").orderBy("seq")
    return rows.withColumn("puts", F.count_if(F.col("op") == "put").over(so_far)).where("puts > 0").drop("puts")


def heads(log: DataFrame) -> DataFrame:
    """key, seq of what is there; values are not read."""
    last = log.groupBy("key").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    return last.where("op = 'put'").select("key", "seq")


def statistics(log: DataFrame) -> DataFrame:
    s = latest(log)
    return s.agg(
        F.count_if(F.col("op") == "put").alias("records"), F.count_if(F.col("op") == "del").alias("tombstones"),
        F.sum(F.when(F.col("op") == "put", F.octet_length("key") + F.octet_length("value")).otherwise(0)).alias("bytes"), F.max("seq").alias("last_seq"),
    )
