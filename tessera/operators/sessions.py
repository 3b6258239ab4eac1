"""Typed records of agent sessions: session_id, step, type, content, and thread_id where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keyword import bm25


def validate(records: DataFrame, thread: str = "thread_id", position: str = "pos") -> DataFrame:
    """session_id, valid: threads are named and steps never fall along ``position``."""
    along = Window.partitionBy("session_id").orderBy(position)
    falls = F.coalesce(F.col("step") < F.lag("step").over(along), F.lit(False))
    nameless = F.coalesce(F.col(thread), F.lit("")) == ""
    return records.withColumn("bad", falls | nameless).groupBy("session_id").agg((~F.bool_or("bad")).alias("valid"))


def load(records: DataFrame, session: str) -> DataFrame:
    """A session's records by step, those of one step by ``pos`` where there is one."""
    order = ["step", "pos"] if "pos" in records.columns else ["step"]
    return records.where(F.col("session_id") == session).orderBy(*order)


def append(records: DataFrame, more: DataFrame) -> DataFrame:
    return records.unionByName(more)


def delete(records: DataFrame, session: str) -> DataFrame:
    return records.where(F.col("session_id") != session)


def sessions(records: DataFrame) -> DataFrame:
    return records.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_records"))


def by_type(records: DataFrame, session: str, kind: str) -> DataFrame:
    return load(records, session).where(F.col("type") == kind)


def recent(records: DataFrame, n: int) -> DataFrame:
    """The last n records of every session, by step and, where there is one, ``pos``."""
    order = [F.col(c).desc() for c in ("step", "pos") if c in records.columns]
    last = Window.partitionBy("session_id").orderBy(*order)
    return records.withColumn("n", F.row_number().over(last)).where(F.col("n") <= n).drop("n")


def search(records: DataFrame, session: str, query: str, k: int = 10) -> DataFrame:
    """BM25 over the records of one session."""
    docs = records.where(F.col("session_id") == session).select(F.concat_ws(":", "session_id", "step", "type").alias("key"), F.col("content").alias("value"))
    return bm25(docs, query, k)


def compress_tools(records: DataFrame) -> DataFrame:
    """Each finished tool call (a Tool and a Res record of one session and call_id) becomes one Mem record at
    the call's step; everything else stays."""
    tool, result = records.where("type = 'Tool'"), records.where("type = 'Res'")
    done = tool.alias("t").join(result.alias("r"), ["session_id", "call_id"]).select("session_id", "call_id", F.col("t.step").alias("step"), F.lit("Mem").alias("type"), F.concat(F.lit("tool "), F.col("t.content"), F.lit(" -> "), F.col("r.content")).alias("content"))
    rest = records.join(done.select("session_id", "call_id"), ["session_id", "call_id"], "left_anti").unionByName(
        records.join(done.select("session_id", "call_id"), ["session_id", "call_id"], "left_semi").where("type not in ('Tool', 'Res')")
    )
    return rest.select("session_id", "call_id", "step", "type", "content").unionByName(done)
