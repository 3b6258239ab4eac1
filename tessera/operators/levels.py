"""Levelled runs of a change log: new runs gather at level 0, are merged into level 1, and that into level 2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .state import compact, live

SCHEMA = "key string, value string, op string, seq long"
#: Level-0 runs that make a merge due. Level 1 goes down to level 2 from so many bytes, and from this share of
#: level 2: a merge rewrites level 2, so its cost has to be spread over as much new data.
RUNS, LEVEL_1_BYTES, LEVEL_1_SHARE = 4, 64 * 1024, 0.1


class Levels:
    """Runs under ``root``, a Parquet folder each. A merge writes its result first and drops its inputs
    after; inputs that a failure leaves behind are harmless, since the highest seq of a key wins."""

    def __init__(self, spark: SparkSession, root: str, runs: int = RUNS, level_1_bytes: int = LEVEL_1_BYTES):
        self.spark, self.root, self.runs, self.level_1_bytes = spark, root.rstrip("/"), runs, level_1_bytes
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def folders(self, level: int) -> list[str]:
        top = self._path(f"{self.root}/{level}")
        if not self._fs.exists(top):
            return []
        found = [str(x.getPath().toString()) for x in self._fs.listStatus(top)]
        return sorted(x for x in found if self._fs.exists(self._path(f"{x}/_SUCCESS")))

    def _read(self, folders: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema(SCHEMA).parquet(x) for x in folders])

    def _write(self, rows: DataFrame, level: int) -> None:
        import time

        rows.select("key", "value", "op", "seq").sortWithinPartitions("key").write.parquet(f"{self.root}/{level}/{time.time_ns()}")

    def add(self, rows: DataFrame) -> None:
        """A new run; merges if one is due."""
        self._write(rows, 0)
        self.merge()

    def merge(self, force: bool = False) -> None:
        if force or len(self.folders(0)) >= self.runs:
            self._down([*self.folders(0), *self.folders(1)], 1, False)
        below = self.folders(1)
        size = lambda level: sum(self._fs.getContentSummary(self._path(x)).getLength() for x in self.folders(level))
        if below and (force or size(1) > max(self.level_1_bytes, LEVEL_1_SHARE * size(2))):
            self._down([*below, *self.folders(2)], 2, not self.folders(0))

    def _down(self, folders: list[str], level: int, drop_tombstones: bool) -> None:
        if folders:
            self._write(compact([self._read(folders)], drop_tombstones), level)
            for x in folders:
                self._fs.delete(self._path(x), True)

    def log(self) -> DataFrame:
        every = [x for level in range(3) for x in self.folders(level)]
        return self._read(every) if every else self.spark.createDataFrame([], SCHEMA)

    def state(self) -> DataFrame:
        return live(self.log())

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False):
        """Adds a run for each batch of a stream of records and merges as it goes. A batch that is delivered
        again after a failure adds records that are there already, which changes nothing."""
        writer = stream.writeStream.foreachBatch(lambda df, _: self.add(df)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
