"""Watching a change log: a streaming query over its files, with a credit of rows, and resuming a result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import SCHEMA


@dataclass
class Watch:
    pattern: str = ""
    namespace: str | None = None
    credit: int | None = None

    def matches(self, log: DataFrame) -> DataFrame:
        rows = log.where(F.col("key").startswith(self.pattern))
        return rows if self.namespace is None else rows.where(F.col("namespace") == self.namespace)


def replay(log: DataFrame, watch: Watch, after: int = 0) -> DataFrame:
    """The batch form: matching records by seq, up to the credit, after the first ``after`` of them."""
    rows = watch.matches(log).orderBy("seq")
    if watch.credit is not None:
        rows = rows.limit(watch.credit)
    return rows.offset(after) if after else rows


#: Credit does not grow beyond this.
MOST_CREDIT = (1 << 63) - 1


class Registry:
    """Watches that are read on demand: each has a place in the log and a credit of rows. What exceeds the credit
    waits in the log until more is added."""

    def __init__(self, log: Callable[[], DataFrame]):
        self._log, self._next = log, 1
        self._held: dict[int, tuple[Watch, int]] = {}

    def watch(self, pattern: str = "", namespace: str | None = None, credit: int = 0, after: int = 0) -> int:
        """The number of a new watch on records after the seq ``after``."""
        number, self._next = self._next, self._next + 1
        self._held[number] = Watch(pattern, namespace, credit), after
        return number

    def _of(self, number: int) -> tuple[Watch, int]:
        if number not in self._held:
            raise KeyError(f"no watch {number}")
        return self._held[number]

    def unwatch(self, number: int) -> None:
        self._of(number)
        del self._held[number]

    def add_credit(self, number: int, rows: int) -> int:
        """Adds to the credit and returns it."""
        w, _ = self._of(number)
        w.credit = min(MOST_CREDIT, w.credit + rows)
        return w.credit

    def take(self, number: int) -> list:
        """The next matching records by seq, as many as the credit, which they use up."""
        w, after = self._of(number)
        rows = w.matches(self._log()).where(F.col("seq") > after).orderBy("seq").limit(min(w.credit, (1 << 31) - 1)).collect()
        if rows:
            w.credit -= len(rows)
            self._held[number] = w, rows[-1]["seq"]
        return rows


def deliveries(df: DataFrame, credit: int | None):
    """``df`` in parts of up to ``credit`` rows by seq; together they are all of it."""
    if credit is None:
        yield df
        return
    if credit < 1:
        raise ValueError("the credit must be a positive number of rows")
    rows = df.orderBy("seq").persist()
    try:
        for lo in range(0, rows.count(), credit):
            yield rows.orderBy("seq").offset(lo).limit(credit)
    finally:
        rows.unpersist()


def start(spark: SparkSession, path: str, watch: Watch, deliver: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, files: int = 1000):
    """Delivers matching records of new log files to ``deliver`` batch by batch. The checkpoint holds what
    has been read, so a restarted watch goes on where it stopped. The credit bounds the rows of one delivery:
    a batch of more comes in several, all with its number. Stop the query to unwatch."""

    def batch(df: DataFrame, number: int) -> None:
        for part in deliveries(df, watch.credit):
            deliver(part, number)

    stream = watch.matches(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path))
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_counts(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """A streaming count of puts and deletes by key, for maintenance jobs."""
    log = spark.readStream.schema(SCHEMA).parquet(path).where(F.col("key").startswith(prefix))
    return log.groupBy("key").agg(F.count_if(F.col("op") == "put").alias("puts"), F.count_if(F.col("op") == "del").alias("deletes"))
