"""The change log: an append-only Parquet table of (namespace, key, value, op, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "namespace string, key string, value string, op string, seq long"


def append(log: DataFrame, path: str) -> None:
    """Adds records; files are sorted by key so that their statistics serve key and range reads."""
    log.sortWithinPartitions("key").write.mode("append").option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of whole files; :func:`skipped` names the others."""
    return spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").parquet(path)


def skipped(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the log's files that :func:`read` passes over because they are no whole Parquet files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.where(F.expr("coalesce(substring(content, -4, 4) <> encode('PAR1', 'UTF-8'), true)")).select("path", "length")


def record_crc(key: Column, value: Column) -> Column:
    return F.crc32(F.encode(F.concat(key, F.lit("\n"), F.coalesce(value, F.lit(""))), "UTF-8"))


def recover(log: DataFrame) -> DataFrame:
    """Records before the first whose stored ``crc`` does not fit, as replay stops there. The place of
    that record is one aggregate, so nothing has to be ordered."""
    first_bad = log.where(F.col("crc") != record_crc(F.col("key"), F.col("value"))).agg(F.min("seq").alias("bad"))
    return log.join(F.broadcast(first_bad), F.col("bad").isNull() | (F.col("seq") < F.col("bad"))).drop("bad")


def backup(log: DataFrame, path: str, as_of: int | None = None) -> None:
    (log if as_of is None else log.where(F.col("seq") <= as_of)).write.mode("errorifexists").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
