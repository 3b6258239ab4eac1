"""Snapshots and branches as functions of the change log: a snapshot is a seq, a branch a seq and a delta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import latest, live


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    return live(log, seq)


def restore_records(log: DataFrame, seq: int, at: int) -> DataFrame:
    """Records that, appended with seq ``at``, bring the state of ``seq`` back."""
    now, then = live(log).withColumnRenamed("value", "now"), snapshot(log, seq).withColumnRenamed("value", "then")
    both = now.join(then, "key", "full").where(~F.col("now").eqNullSafe(F.col("then")))
    return both.select("key", F.col("then").alias("value"), F.when(F.col("then").isNull(), "del").otherwise("put").alias("op"), F.lit(at).cast("long").alias("seq"))


def branch_state(log: DataFrame, base: int, delta: DataFrame) -> DataFrame:
    """The base snapshot with the branch's own records over it."""
    return live(log.where(F.col("seq") <= base).select("key", "value", "op", "seq").unionByName(delta.select("key", "value", "op", "seq")))


def diff(state: DataFrame, branch: DataFrame) -> DataFrame:
    """key, live_value, branch_value where they differ; null means absent."""
    both = state.select("key", F.col("value").alias("live_value")).join(branch.select("key", F.col("value").alias("branch_value")), "key", "full")
    return both.where(~F.col("live_value").eqNullSafe(F.col("branch_value")))


def merge_overlay(state: DataFrame, branch: DataFrame) -> DataFrame:
    """Every pair of the branch over the state: deletes do not travel, and what the branch inherited wins too."""
    return state.join(branch.select("key"), "key", "left_anti").unionByName(branch.select("key", "value"))


def merge_delta(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Only what the branch changed, deletes included."""
    own = latest(delta)
    kept = state.join(own.select("key"), "key", "left_anti")
    return kept.unionByName(own.where("op = 'put'").select("key", "value"))
