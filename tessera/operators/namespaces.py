"""Namespaces are a column, so scoping is a filter that partition pruning can serve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import namespace_id


def parse(name: str) -> tuple[str, str]:
    """(repository, commit) of ``repository@commit``, or of ``repository::commit``; the commit may be empty."""
    for mark in ("@", "::"):
        if mark in name:
            repository, _, commit = name.partition(mark)
            return repository, commit
    return name, ""


def identify(rows: DataFrame, repository: str = "repository", commit: str = "commit") -> DataFrame:
    return rows.withColumn("namespace_id", namespace_id(F.col(repository), F.col(commit)))


def scan(state: DataFrame, namespace: str) -> DataFrame:
    return state.where(F.col("namespace") == namespace)


def statistics(state: DataFrame) -> DataFrame:
    """namespace, n_records, bytes of keys and values."""
    size = F.octet_length("key") + F.octet_length(F.coalesce("value", F.lit("")))
    return state.groupBy("namespace").agg(F.count(F.lit(1)).alias("n_records"), F.sum(size).cast("long").alias("bytes"))


def counts(state: DataFrame) -> DataFrame:
    return state.groupBy("namespace").agg(F.count(F.lit(1)).alias("n_records"))


def delete(state: DataFrame, namespace: str) -> DataFrame:
    return state.where(~F.col("namespace").eqNullSafe(F.lit(namespace)))
