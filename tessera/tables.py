"""The driver's tables as the engine's inputs: a change log, documents, symbols, vectors, edges, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import camel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_key(c: str = "user_id"):
    return F.concat(F.lit("user/"), F.lpad(F.col(c).cast("string"), 8, "0"))


def change_log(spark, sf_dir) -> DataFrame:
    """A record for each event: an error deletes the user's record, any other event puts it."""
    return table(spark, sf_dir, "events").select(
        user_key().alias("key"), F.concat("event_type", F.lit(":"), F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"), F.col("event_id").alias("seq"), "user_id",
    )


def last_seq(log: DataFrame) -> int:
    return log.agg(F.max("seq")).first()[0]


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("value"), F.col("source").alias("namespace"))


def symbols(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_type").alias("t")).select(camel(F.col("p_name")).alias("key"), F.concat_ws(" ", "p_name", "t").alias("value"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    return parts.unionByName(customers)


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc/"), F.col("vec_id").cast("string")).alias("key"), F.col("embedding").alias("vector"), "vec_id")


def edges(spark, sf_dir) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        t("customer").select(name("customer", "c_custkey").alias("src"), name("nation", "c_nationkey").alias("dst"), F.lit("imports").alias("relation")),
        t("nation").select(name("nation", "n_nationkey").alias("src"), name("region", "n_regionkey").alias("dst"), F.lit("defines").alias("relation")),
        t("orders").select(name("order", "o_orderkey").alias("src"), name("customer", "o_custkey").alias("dst"), F.lit("calls").alias("relation")),
        t("supplier").select(name("supplier", "s_suppkey").alias("src"), name("nation", "s_nationkey").alias("dst"), F.lit("inherits").alias("relation")),
        t("lineitem").select(name("order", "l_orderkey").alias("src"), name("part", "l_partkey").alias("dst"), F.lit("tests").alias("relation")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sessions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").alias("step"), F.col("turn").alias("pos"), F.col("role").alias("type"), F.col("text").alias("content"))


def raw_records(spark, sf_dir) -> DataFrame:
    """Events as strings, some of them bad."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 19 != 0, F.col("event_type")).alias("kind"),
        F.when(e % 7 == 0, " 5 ").when(e % 11 != 0, F.col("user_id").cast("string")).alias("user"),
        F.when(e % 13 == 0, "1.0d").when(e % 17 == 0, "inf").otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(e % 5 == 0, "TRUE").otherwise("true").alias("flag"), F.when(e % 3 == 0, "7").alias("lines"),
    )
