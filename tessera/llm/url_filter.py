"""URL filtering with a cascade of Bloom filters.

Rules are keys made of a host and the beginning of a path. The key universe is every key that some
URL of the corpus could match: each suffix of its host at a label, with each path beginning as long
as some rule's. Level 1 encodes the listed keys, level 2 the universe's false positives of level 1,
level 3 the listed keys that level 2 wrongly holds, and so on until nothing is left. A key of the
universe is listed exactly when the first level that lacks it is an even one (or none is, and the
number of levels is odd), so the corpus is judged without a join. Level 1 is sized by the ratio of
listed to other keys so that about as many false positives are left as keys are listed: every level,
and what is sent to executors, grows with the list and not with the corpus. Levels are sent up to
``MAX_BITS``; a longer list stays a table and meets the keys of the corpus by a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

MAX_LEVELS = 64
#: Bits of all levels of a cascade (32 MB, some 12 million rules).
MAX_BITS = 1 << 28


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that a URL could match, by code points: the longest first, of equals that with the longer host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.struct((-F.char_length(s) - F.char_length(p)).alias("order"), (-F.char_length(s)).alias("then"), F.concat(s, F.lit("\x00"), p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def literal_rules(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list as a table, without a Python worker; a long one should come as a table."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    kind = "array<struct<verdict:string,host:string,path:string>>"
    return spark.range(1).select(F.explode(rows.cast(kind)).alias("rule")).select("rule.*")


class TooLarge(ValueError):
    """A cascade would exceed ``MAX_BITS``."""


class Cascade:
    """Levels as (bits, hashes), and each as a table of one row: an array of words of 64 bits."""

    def __init__(self, scratch: Scratch, name: str):
        self.scratch, self.name = scratch, name
        self.levels: list[tuple[int, int]] = []
        self.tables: list[DataFrame] = []

    def column(self, level: int) -> str:
        return f"{self.name}_{level}"

    def add(self, keys: DataFrame, count: int, rate: float) -> None:
        bits = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
        if bits + sum(b for b, _ in self.levels) > MAX_BITS:
            raise TooLarge(f"{count} keys")
        hashes = max(1, min(32, round(bits / max(1, count) * math.log(2))))
        at = keys.select(F.explode(F.array(*positions(F.col("key"), len(self.levels), bits, hashes))).alias("at"))
        words = at.groupBy(F.expr("at div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v"))
        every = words.unionByName(keys.sparkSession.range(math.ceil(bits / 64)).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v")))
        full = every.groupBy("w").agg(F.bit_or("v").alias("v"))
        row = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias(self.column(len(self.levels))))
        self.tables.append(self.scratch.table(row, self.column(len(self.levels))))
        self.levels.append((bits, hashes))

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the levels beside them: each is one row of a size that ``add`` has checked."""
        for table in self.tables:
            rows = rows.join(F.broadcast(table))
        return rows

    def holds(self, key: Column, level: int) -> Column:
        bits, hashes = self.levels[level]
        table, test = F.col(self.column(level)), F.lit(True)
        for at in positions(key, level, bits, hashes):
            word = F.element_at(table, F.floor(at / 64).cast("int") + 1)
            test = test & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return test

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed; the levels must be attached."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(self.holds(key, level), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def build_cascade(universe: DataFrame, listed: DataFrame, scratch: Scratch, name: str) -> Cascade:
    """Both tables hold distinct ``key``; ``listed`` may be any part of the universe or lie outside."""
    r = max(1, listed.count())
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * r / max(1, universe.count())))
    cascade, count = Cascade(scratch, name), r
    for level in range(MAX_LEVELS):
        cascade.add(inside, count, rate)
        wrong = cascade.attach(outside).where(cascade.holds(F.col("key"), level)).select("key")
        wrong = scratch.table(wrong, f"{name}-{level}")
        count, rate = wrong.count(), 0.5
        if not count:
            return cascade
        inside, outside = wrong, inside
    raise ValueError("the cascade does not end; two keys share all their hashes")


def _first_by_cascade(judged: DataFrame, keys: Column, universe: DataFrame, every: DataFrame, allowed: DataFrame, scratch: Scratch) -> DataFrame:
    """``judged`` with the longest listed key of each row and whether that allows."""
    fits, allows = build_cascade(universe, every, scratch, "fits"), build_cascade(every, allowed, scratch, "allows")
    rows = fits.attach(judged).withColumn("key", F.get(F.filter(keys, fits.listed), F.lit(0)))
    return allows.attach(rows.select(*judged.columns, "key")).withColumn("allow", allows.listed(F.col("key")))


def _first_by_join(judged: DataFrame, keys: Column, every: DataFrame, allowed: DataFrame) -> DataFrame:
    """The same for a list of any size, by joins."""
    urls = judged.select("host", "path").distinct().select("host", "path", F.posexplode(keys).alias("place", "key"))
    first = urls.join(every, "key").groupBy("host", "path").agg(F.min_by("key", "place").alias("key"))
    first = first.join(allowed.withColumn("allow", F.lit(True)), "key", "left").select("host", "path", "key", F.coalesce("allow", F.lit(False)).alias("allow"))
    return judged.join(first, ["host", "path"], "left")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` are (allow or block, host, path), or a table with columns verdict, host and path. A rule fits its host and every subdomain, if the URL's
    path starts with the rule's; the longest rule wins, of equals that with the longer host. What no
    rule fits is not in the cascade and so allowed. Null URLs and those without ``://`` have empty host
    and path and fit no rule with a host. Repeated rows are judged one by one; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    if not isinstance(rules, DataFrame):
        rules = literal_rules(spark, rules)
    rules = rules.select("verdict", F.concat("host", F.lit("\x00"), "path").alias("key"), F.char_length("path").alias("length")).where("key is not null")
    rules = scratch.table(rules, "rules")
    judged = pages.select(pages[id_col].alias("page_id"), url_host(pages[url_col]).alias("host"), url_path(pages[url_col]).alias("path"))
    lengths = sorted(r["length"] for r in rules.select("length").distinct().collect())  # lengths of paths, not paths
    keys = candidate_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")
    every, allowed = rules.select("key").distinct(), rules.where("verdict = 'allow'").select("key").distinct()
    universe = scratch.table(judged.select("host", "path").distinct().select(F.explode(keys).alias("key")).distinct(), "universe")
    try:
        told = _first_by_cascade(judged, keys, universe, every, allowed, scratch)
    except TooLarge:
        told = _first_by_join(judged, keys, every, allowed)
    scratch.drop("universe")
    return told.select(
        "page_id", "host", "path", F.replace("key", F.lit("\x00"), F.lit("")).alias("rule"),
        F.when(F.col("key").isNull() | F.col("allow"), "allow").otherwise("block").alias("verdict"),
    )
