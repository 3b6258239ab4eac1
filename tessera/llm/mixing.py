"""Mixing sources to target weights.

Tokens are summed per source, the sums give each source a target and so a repetition rate, and each
document is taken floor(rate) times plus once more with a probability of the rate's fraction, drawn
from a hash of its identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Up to so many sources, the table of rates (about 60 bytes a source) goes to every executor.
BROADCAST_SOURCES = 10_000


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget: float, cap: float, weights: list[float]) -> DataFrame:
    """Targets from one row per source (``source``, ``source_size``). The order of all sources is one sort of
    that table in one task, about 100 bytes a source.

    Weights repeat over the sources by code point, null last. All sources share ``budget`` times the
    sum of sizes by weight; none gets more than ``cap`` times its size, and what one can't take the
    others share. So each target is min(cap * size, level * weight): in the order of cap * size /
    weight, the sources before some place are full and the level is what is left for the others over
    their weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "source", "source_size", "weight", "full",
        (F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("full").over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(after).alias("rest"),
    )
    # the first source that its share does not fill sets the level; all after it have more room
    s = s.withColumn("fits", F.col("weight") * F.col("left") / F.col("rest") <= F.col("full"))
    level = F.first(F.when(F.col("fits"), F.struct("left", "rest")), True).over(every)
    s = s.withColumn("open", F.max(F.col("fits").cast("int")).over(fill.rowsBetween(Window.unboundedPreceding, 0))).withColumn("level", level)
    s = s.withColumn("left", F.col("level.left")).withColumn("rest", F.col("level.rest"))
    share = F.when(F.col("open") == 1, F.least("full", F.col("weight") * F.col("left") / F.col("rest"))).otherwise(F.col("full"))
    return s.select("source", "source_size", share.cast("double").alias("target"))


def unit_hash(value: Column, seed: int) -> Column:
    """A number from 0 to 1 from the first 13 hexadecimal digits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _with_copies(docs: DataFrame, id_col, text_col, source_col, budget, cap, weights, seed, keep: list[str]) -> DataFrame:
    sized = docs.select(*[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(keep)], docs[id_col].alias("_id"), docs[source_col].cast("string").alias("_source"), count_words(docs[text_col]).alias("_size"))
    totals = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    totals = Scratch(docs.sparkSession, "mixing").table(totals, "totals")  # a row for each source, read three times
    targets = source_targets(totals, budget, cap, weights).withColumnsRenamed({"source": "_s", "source_size": "_source_size", "target": "_target"})
    if totals.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("_source_size") > 0, F.least(F.col("_target") / F.col("_source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    joined = sized.join(targets, F.expr("_source <=> _s"))
    whole = F.floor(rate)
    return joined.withColumn("_copies", whole + (unit_hash(F.col("_id"), seed) < rate - whole).cast("long"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, cap: float = 2.0, weights: list[float] = (3.0, 1.0, 2.0), seed: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target (its source's), taken, copies.

    Null and empty texts have size 0. A null source is a source of its own, the last. Rows that
    repeat an identifier get the same number of copies each; a null identifier hashes as empty text.
    Sources without words have target 0 and none of their documents is taken. Reruns agree. Other
    columns are ignored; an empty table gives an empty result.
    """
    d = _with_copies(docs, id_col, text_col, source_col, budget, cap, list(weights), seed, [])
    return d.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, cap: float = 2.0, weights: list[float] = (3.0, 1.0, 2.0), seed: int = 1) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_report` says, all columns kept."""
    d = _with_copies(docs, id_col, text_col, source_col, budget, cap, list(weights), seed, docs.columns)
    d = d.withColumn("_copy", F.explode(F.when(F.col("_copies") > 0, F.array_repeat(F.lit(1), F.col("_copies").cast("int")))))
    return d.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
