"""Transaction sessions and multi-version visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import latest


def read_your_writes(snapshot: DataFrame, buffer: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, value for ``wanted`` keys: the last buffered record, else the snapshot at begin; null if absent."""
    own = latest(buffer).select("key", F.col("value").alias("own"), "op")
    rows = wanted.join(own, "key", "left").join(snapshot, "key", "left")
    return rows.select("key", F.when(F.col("op") == "put", F.col("own")).when(F.col("op").isNull(), F.col("value")).alias("value"))


def commit(state: DataFrame, buffer: DataFrame) -> DataFrame:
    """The state once the buffer is applied in order."""
    own = latest(buffer)
    return state.join(own.select("key"), "key", "left_anti").unionByName(own.where("op = 'put'").select("key", "value"))


def conflicts(read_set: DataFrame, begin: DataFrame, now: DataFrame) -> DataFrame:
    """Keys read whose value changed since begin."""
    a, b = begin.withColumnRenamed("value", "then"), now.withColumnRenamed("value", "now")
    return read_set.join(a, "key", "left").join(b, "key", "left").where(~F.col("then").eqNullSafe(F.col("now"))).select("key")


def visible(versions: DataFrame, at: int | None = None) -> DataFrame:
    """key, value, commit_ts of the newest committed version, up to ``at``. Null commit_ts: an intent."""
    done = versions.where("commit_ts is not null" if at is None else F.col("commit_ts") <= at)
    return done.groupBy("key").agg(F.max_by("value", "commit_ts").alias("value"), F.max("commit_ts").alias("commit_ts"))


def committed_since(versions: DataFrame, read_set: DataFrame, begin: int) -> DataFrame:
    """Keys read that someone has committed since ``begin``."""
    return read_set.join(versions.where(F.col("commit_ts") > begin).select("key").distinct(), "key", "left_semi").select("key")


def write_intents(versions: DataFrame, writes: DataFrame, txn: str) -> DataFrame:
    """Versions (with ``txn``) and the uncommitted ``writes`` (key, value) of a transaction."""
    own = writes.select("key", "value", F.lit(None).cast("long").alias("commit_ts"), F.lit(txn).alias("txn"))
    return versions.unionByName(own)


def _own_intents(versions: DataFrame, wanted: DataFrame, txn: str) -> DataFrame:
    mark = wanted.select("key").distinct().withColumn("asked", F.lit(True))
    return versions.join(mark, "key", "left").withColumn("own", F.col("asked").isNotNull() & F.col("commit_ts").isNull() & F.col("txn").eqNullSafe(F.lit(txn)))


def commit_keys(versions: DataFrame, wanted: DataFrame, txn: str, commit_ts: int) -> DataFrame:
    """The transaction's intents on ``wanted`` keys become versions of ``commit_ts``."""
    stamped = F.when(F.col("own"), F.lit(commit_ts).cast("long")).otherwise(F.col("commit_ts"))
    return _own_intents(versions, wanted, txn).select("key", "value", stamped.alias("commit_ts"), "txn")


def abort_keys(versions: DataFrame, wanted: DataFrame, txn: str) -> DataFrame:
    """The transaction's intents on ``wanted`` keys go."""
    return _own_intents(versions, wanted, txn).where(~F.col("own")).select("key", "value", "commit_ts", "txn")


def version_counts(versions: DataFrame) -> DataFrame:
    """key, n_versions, n_intents."""
    return versions.groupBy("key").agg(F.count(F.lit(1)).alias("n_versions"), F.count_if(F.col("commit_ts").isNull()).alias("n_intents"))


def read(versions: DataFrame, wanted: DataFrame, isolation: str, begin: int, txn: str) -> DataFrame:
    """key, value for ``wanted`` keys as a transaction sees them: its own intents first, then the newest committed
    version (read_committed) or the newest up to ``begin`` (snapshot, serializable); null if there is none."""
    if isolation not in ("read_committed", "snapshot", "serializable"):
        raise ValueError(f"unknown isolation {isolation!r}")
    rows = versions.join(wanted.select("key").distinct(), "key", "left_semi")
    own = rows.where(F.col("commit_ts").isNull() & F.col("txn").eqNullSafe(F.lit(txn))).groupBy("key").agg(F.max("value").alias("own"))
    done = visible(rows, None if isolation == "read_committed" else begin).select("key", F.col("value").alias("done"))
    return wanted.join(own, "key", "left").join(done, "key", "left").select("key", F.coalesce("own", "done").alias("value"))


def collect_garbage(versions: DataFrame, oldest: int) -> DataFrame:
    """Versions that stay: of each key the newest, those not older than ``oldest``, and the first older one.
    Intents (null commit_ts) stay as they are."""
    newest = Window.partitionBy("key").orderBy(F.col("commit_ts").desc())
    rows = versions.where("commit_ts is not null").withColumn("n", F.row_number().over(newest))
    old = (F.col("n") > 1) & (F.col("commit_ts") < oldest)
    rows = rows.withColumn("older", F.sum(old.cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = rows.where("older <= 1").select("key", "value", "commit_ts")
    return kept.unionByName(versions.where("commit_ts is null").select("key", "value", "commit_ts"))
