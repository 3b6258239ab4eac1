"""Tables that cut lineage, in the folder the cluster shares between driver and executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master may go without one; it gets a
    temporary folder, as its driver and executors are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL["dir"] = f"file://{folder}"
    return _LOCAL["dir"]


class Scratch:
    """Intermediate tables of one operator call.

    ``table`` writes a DataFrame and reads it back, so that a lost executor costs a re-read and not
    the whole lineage. ``drop`` deletes what no later plan reads and lets Spark free the shuffle
    files behind it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.free()

    def free(self) -> None:
        """Spark deletes shuffle files once the driver has collected the plans that own them."""
        self.spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read from fewer files: a file may be a single row group, which one task reads."""
    files, cores = len(df.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < files < cores else df


def sweep(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application. Results that still read them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
