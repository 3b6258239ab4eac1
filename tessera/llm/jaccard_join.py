"""Similarity join of documents by the Jaccard similarity of their word n-grams, and its components.

1. Region. A partner of a document of s n-grams lacks at most m(s) of them. Of the m(s) + l(s) n-grams
   with the smallest hashes two partners share at least the smaller of their l. Only these are counted
   over the corpus, in packed blocks: documents whose region holds fewer shared n-grams than any partner
   would need are through.
2. Families. The others are told apart by their whole set. Ordering a region by corpus frequency, two
   partners must meet in its beginning (prefix filter); sets that meet at an n-gram go to one family.
3. Product. The document by n-gram incidence matrix of a family is multiplied with itself, block by
   block: overlap counts accumulate over the n-grams, and pairs below the bound that their sizes set are
   discarded. A family that does not fit one block is cut into tiers of set size, and tiers into blocks;
   only tiers whose sizes allow a link meet. Each pair of blocks is a task of bounded size, and a task
   returns a spanning forest and link counts, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components, salted
from ..sources.scratch import Scratch, shuffle_partitions

#: Documents in one packed block of regions; n-grams of one range that are counted at a time.
PACK = 2048
RANGE = 1 << 20
#: Sets, and n-grams of them, in one block of a product.
BLOCK = 512
BLOCK_GRAMS = 1 << 19


def shingles(texts: pa.Array, k: int):
    """Yields the sorted distinct hashes of each text's runs of k words, letters A-Z folded; a text of
    fewer words has one of them all, a text without words none."""
    space, values = W.is_space(), W.byte_values(True)
    for _, _, data, offsets in W.chunks(texts):
        starts, ends, first = W.split(data, offsets, space)
        words = W.hash_words(data, starts, ends, values)
        runs = W.hash_runs(words, k)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= k:
                yield np.unique(runs[lo : hi - k + 1])
            elif hi > lo:
                yield W.hash_runs(words[lo:hi], hi - lo) + np.uint64(hi - lo)
            else:
                yield np.zeros(0, np.uint64)


class Bounds:
    """What a similarity of at least percent / 100 asks of sets of s n-grams."""

    def __init__(self, percent: int):
        self.percent = percent

    def common(self, s):
        """The fewest that a partner shares."""
        return -(-self.percent * s // 100)

    def extra(self, s):
        return 1 + s // 8

    def region(self, s):
        return np.minimum(s, s - self.common(s) + self.extra(s))

    def shared(self, s):
        """The fewest of its region that a partner, of the smallest possible size, shares."""
        return self.extra(self.common(s))

    def linked(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a = W.mix(found ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
        b = W.mix(found * np.uint64(0x9E6C63D0876A9A47)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _regions(k: int, bounds: Bounds):
    def run(batches):
        number = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, PACK):
                part = batch.slice(lo, PACK)
                sizes, prints, kept = [], [], []
                for found in shingles(part["text"], k):
                    sizes.append(len(found))
                    prints.append(fingerprint(found))
                    kept.append(found[: int(bounds.region(len(found)))])
                ids = part["doc_id"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([np.asarray(ids.fill_null(0)).astype(np.int64).tobytes()], pa.binary()),
                        pa.array([np.asarray(ids.is_valid()).tobytes()], pa.binary()),
                        pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()),
                        pa.array([np.array(prints, np.int64).tobytes()], pa.binary()),
                        pa.array([np.concatenate(kept).tobytes()], pa.binary()),
                    ],
                    ["pack", "ids", "valid", "sizes", "prints", "grams"],
                )
                number += 1

    return run


def _requests(parts: int):
    """For each pack and each of ``parts`` ranges of hashes: the pack's distinct n-grams in it, those
    that several of its documents hold marked."""

    def run(batches):
        for batch in batches:
            for pack, grams in zip(batch["pack"].to_pylist(), batch["grams"].to_pylist(), strict=True):
                found, counts = np.unique(np.frombuffer(grams, np.uint64), return_counts=True)
                part = ((found >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.append(cuts[1:], len(found))
                counts = np.minimum(counts, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[cuts], pa.int64()),
                        pa.array(np.full(len(cuts), pack, np.int64)),
                        pa.array([found[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                        pa.array([counts[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                    ],
                    ["part", "pack", "grams", "counts"],
                )

    return run


def _replies(batches):
    """For each request the number of documents that hold its n-grams, up to 255. Requests come by range."""

    def reply(part, packs, grams, counts):
        _, at = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.minimum(np.bincount(at, np.concatenate(counts)), 255).astype(np.uint8)[at]
        cuts = np.cumsum([0] + [len(g) for g in grams])
        return pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array(np.full(len(packs), part)), pa.array([total[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["pack", "part", "totals"])

    part, held = None, ([], [], [])
    for b in batches:
        for key, *row in zip(b["part"].to_pylist(), b["pack"].to_pylist(), b["grams"].to_pylist(), b["counts"].to_pylist(), strict=True):
            if key != part:
                if held[0]:
                    yield reply(part, *held)
                part, held = key, ([], [], [])
            for column, x in zip(held, (row[0], np.frombuffer(row[1], np.uint64), np.frombuffer(row[2], np.uint8)), strict=True):
                column.append(x)
    if held[0]:
        yield reply(part, *held)


def _survivors(bounds: Bounds):
    """Documents that may have a partner, with the n-grams at which one must meet them."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, valid = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["valid"], bool)
                sizes, prints = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["prints"], np.int64).reshape(-1, 2)
                grams = np.frombuffer(row["grams"], np.uint64)
                found = np.unique(grams)
                totals = np.concatenate([np.frombuffer(x["totals"], np.uint8) for x in sorted(row["replies"], key=lambda x: x["part"])]) if row["replies"] else np.zeros(0, np.uint8)
                often = totals[np.searchsorted(found, grams)]
                ends = np.cumsum(bounds.region(sizes))
                out = []
                for i in np.flatnonzero(valid & (sizes > 0)):
                    s = int(sizes[i])
                    own = slice(ends[i] - int(bounds.region(s)), ends[i])
                    g, n = grams[own], often[own]
                    if (n > 1).sum() < bounds.shared(s):
                        continue
                    order = np.lexsort((g, n))[: len(g) - int(bounds.shared(s)) + 1]
                    out.append((int(ids[i]), *prints[i].tolist(), s, g[order][n[order] > 1].astype(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.list_(pa.int64()) if c == 4 else pa.int64()) for c in range(5)], ["doc_id", "p1", "p2", "size", "grams"])

    return run


def _members(batches):
    for batch in batches:
        for row in batch.to_pylist():
            valid = np.frombuffer(row["valid"], bool)
            prints = np.frombuffer(row["prints"], np.int64).reshape(-1, 2)
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~valid)
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(np.frombuffer(row["sizes"], np.int64))], ["doc_id", "p1", "p2", "n_shingles"])


def _sets(k: int):
    """The sets of the wanted classes, other columns kept; a text of another set with the same identifier drops out."""

    def run(batches):
        for batch in batches:
            found = list(shingles(batch["text"], k))
            keep = pa.array([i for i, (f, a, b) in enumerate(zip(found, batch["p1"].to_pylist(), batch["p2"].to_pylist(), strict=True)) if fingerprint(f) == (a, b)], pa.int64())
            rest = [c for c in batch.schema.names if c not in ("text", "p1", "p2")]
            yield pa.RecordBatch.from_arrays([*[batch[c].take(keep) for c in rest], pa.array([found[i].tobytes() for i in keep.to_pylist()], pa.binary())], [*rest, "grams"])

    return run


def product(left: list[np.ndarray], right: list[np.ndarray] | None, bounds: Bounds) -> list[tuple[int, np.ndarray]]:
    """For sets of ``left`` the places of those in ``right`` that link with it; without ``right``, in ``left``."""
    other = left if right is None else right
    sizes = np.array([len(x) for x in other])
    keys, column = np.unique(np.concatenate(other), return_inverse=True)
    holders = np.repeat(np.arange(len(other)), sizes)[np.argsort(column, kind="stable")]
    count = np.bincount(column)
    start = np.cumsum(count) - count
    out = []
    for i, own in enumerate(left):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        at = at[keys[at] == own]
        n = count[at]
        overlap = np.bincount(holders[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(other))
        hit = (overlap > 0) & bounds.linked(overlap, len(own), sizes)
        if right is None:
            hit[i] = False
        if hit.any():
            out.append((i, np.flatnonzero(hit)))
    return out


def _link(bounds: Bounds):
    """Rows of a task come by ``task``, those of ``side`` 0 first; each pair of blocks gives links and counts."""

    def solve(rows):
        rows = list({r["node"]: r for r in rows}.values())  # rows may repeat
        ids = np.array([r["node"] for r in rows])
        copies = np.array([r["copies"] for r in rows])
        sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
        cut = sum(r["side"] == 0 for r in rows)
        if rows[0]["alone"]:
            linked = product(sets, None, bounds)
        elif 0 < cut < len(rows):
            linked = [(i, at + cut) for i, at in product(sets[:cut], sets[cut:], bounds)]
        else:
            linked = []
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, at in linked:
            links[i] += copies[at].sum()
            if not rows[0]["alone"]:
                links[at] += copies[i]
            joined = np.unique(np.append(label[at], label[i]))
            label[np.isin(label, joined)] = joined[0]
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(least[label[at]], pa.int64()), pa.array(links[at], pa.int64())], ["a", "b", "links"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["task"] != key:
                    if len(rows) > 1:
                        yield solve(rows)
                    key, rows = r["task"], []
                rows.append(r)
        if len(rows) > 1:
            yield solve(rows)

    return run


_ENDS = "ends array<struct<side:int,low:int,high:int,low_blocks:int,high_blocks:int>>"


def _with_ends(placed: DataFrame, bounds: Bounds, scratch: Scratch) -> DataFrame:
    """``placed`` (family, node, size) with ``ends``: the pairs of tiers that a set takes part in, and on which side.

    A family that fits one block is one tier. The tiers of another hold sets of sizes within the ratio that
    a link allows, so a tier meets itself and its neighbours, unless the sizes it holds rule that out."""
    whole = placed.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    whole = scratch.table(whole.select("family", ((F.col("n") <= BLOCK) & (F.col("grams") <= BLOCK_GRAMS)).alias("fits")), "whole")
    ratio = float(np.log(100 / bounds.percent)) or 1.0
    tier = F.when(F.col("fits"), F.lit(0)).otherwise(F.floor(F.log("size") / ratio).cast("int"))
    rows = scratch.table(placed.join(whole, "family").withColumn("tier", tier).drop("fits"), "tiered")
    tiers = rows.groupBy("family", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"), F.min("size").alias("least"), F.max("size").alias("most"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    tiers = scratch.table(tiers.select("family", "tier", blocks.alias("blocks"), "least", "most"), "tiers")
    upper = tiers.select("family", F.col("tier").alias("high"), F.col("blocks").alias("high_blocks"), F.col("least").alias("high_least"))
    meets = tiers.withColumn("high", F.explode(F.array(*[F.col("tier") + i for i in range(3)]))).join(upper, ["family", "high"])
    meets = meets.where((F.col("tier") == F.col("high")) | (100 * F.col("most") >= bounds.percent * F.col("high_least")))
    pair = [F.col("tier").alias("low"), "high", F.col("blocks").alias("low_blocks"), "high_blocks"]
    end = lambda side, at: F.struct(F.col(at).alias("at"), F.struct(F.lit(side).alias("side"), *pair).alias("end"))
    ends = meets.select("family", F.explode(F.when(F.col("tier") == F.col("high"), F.array(end(0, "tier"))).otherwise(F.array(end(0, "tier"), end(1, "high")))).alias("e"))
    ends = ends.groupBy("family", F.col("e.at").alias("tier")).agg(F.collect_list("e.end").alias("ends"))  # five at most
    return rows.join(scratch.table(ends, "ends"), ["family", "tier"]).drop("tier")


def _dealt(sets: DataFrame) -> DataFrame:
    """A row for each set and each pair of blocks that it takes part in, by ``task`` and ``side``."""
    e = sets.withColumn("e", F.explode("ends")).select("family", "node", "copies", "grams", "e.*")
    first_side = F.col("side") == 0
    own = F.pmod(F.xxhash64("node"), F.when(first_side, F.col("low_blocks")).otherwise(F.col("high_blocks"))).cast("int")
    others = F.sequence(F.lit(0), F.when(first_side, F.col("high_blocks")).otherwise(F.col("low_blocks")) - 1)
    e = e.withColumn("own", own).withColumn("other", F.explode(others))
    same = F.col("low") == F.col("high")
    i = F.when(same, F.least("own", "other")).when(first_side, F.col("own")).otherwise(F.col("other"))
    j = F.when(same, F.greatest("own", "other")).when(first_side, F.col("other")).otherwise(F.col("own"))
    side = F.when(same, (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side"))
    return e.select(F.struct("family", "low", i.alias("i"), "high", j.alias("j")).alias("task"), side.alias("side"), (same & (F.col("own") == F.col("other"))).alias("alone"), "node", "copies", "grams")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id, n_links.

    Two documents link when 100 * overlap >= ``percent`` * union of their sets of n-grams of ``k`` words
    (A-Z folded). ``class_id`` is the smallest identifier with the same set, ``component_id`` the
    smallest that links lead to, ``n_links`` the number of other rows linked. Null and empty texts and
    those without words have an empty set and link with nothing. Rows that repeat an identifier count
    one by one. A row with null identifier links with nothing and has null component and class. Other
    columns are ignored; an empty table gives an empty result.
    """
    W.bound_batches()
    spark = docs.sparkSession
    scratch, bounds, parts = Scratch(spark, "jaccard-join"), Bounds(percent), shuffle_partitions(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    packs = "pack long, ids binary, valid binary, sizes binary, prints binary, grams binary"
    # a pack is named by its task and its place there
    regions = rows.mapInArrow(_regions(k, bounds), packs).withColumn("pack", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("pack"))
    regions = scratch.table(regions, "regions", "none")
    members = regions.select("ids", "valid", "sizes", "prints").mapInArrow(_members, "doc_id long, p1 long, p2 long, n_shingles long")

    total = regions.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
    asked = regions.select("pack", "grams").mapInArrow(_requests(max(4 * parts, total // 8 // RANGE)), "part long, pack long, grams binary, counts binary")
    replies = asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_replies, "pack long, part long, totals binary")
    replies = scratch.table(replies, "replies")
    scratch.free()
    answers = replies.groupBy("pack").agg(F.collect_list(F.struct("part", "totals")).alias("replies"))  # of one pack, so bounded
    chosen = regions.join(answers, "pack", "left").select("ids", "valid", "sizes", "prints", "grams", "replies")
    survivors = scratch.table(chosen.mapInArrow(_survivors(bounds), "doc_id long, p1 long, p2 long, size long, grams array<long>"), "survivors")
    scratch.drop("replies")

    # tables of aggregates, so that a join deals both sides out and Spark can split a hot key
    groups = members.where("doc_id is not null and n_shingles > 0").groupBy("p1", "p2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("size"))
    groups = scratch.table(groups, "classes")
    # a class of equal sets is the node of its identifier, or of p1 where other classes have that identifier too
    twice = scratch.table(groups.groupBy("class_id").count().where("count > 1").select("class_id", F.lit(True).alias("twice")), "twice")
    groups = groups.join(twice, "class_id", "left").select("p1", "p2", "class_id", "copies", "size", F.when(F.col("twice"), F.col("p1")).otherwise(F.col("class_id")).alias("node"))
    groups = scratch.table(groups, "groups")
    classes = survivors.join(groups, ["p1", "p2"]).where("doc_id = class_id").select("p1", "p2", "node", "grams").dropDuplicates(["p1", "p2"])
    postings = scratch.table(classes.select(F.col("node").alias("rep"), F.explode("grams").alias("gram")), "postings")
    scratch.drop("survivors")
    pivots = postings.groupBy("gram").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other")).where("pivot <> other").select("gram", "pivot")
    pivots = scratch.table(pivots, "pivots")
    meets = postings.join(pivots, "gram").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    families = scratch.table(components(meets, scratch, "families"), "family")
    scratch.drop("postings", "pivots", "classes", "twice")

    places = scratch.table(families.withColumnRenamed("component", "family").join(groups, "node").select("family", "node", "size", "copies", F.col("class_id").alias("doc_id"), "p1", "p2"), "places")
    wanted = rows.join(_with_ends(places, bounds, scratch), "doc_id").select("family", "node", "copies", "ends", "p1", "p2", "text")
    sets = wanted.mapInArrow(_sets(k), f"family long, node long, copies long, {_ENDS}, grams binary")
    tasks = _dealt(sets).repartition(parts, "task").sortWithinPartitions("task", "side", "node")
    found = scratch.table(tasks.mapInArrow(_link(bounds), "a long, b long, links long"), "found")
    scratch.free()

    joined = components(found.select("a", "b"), scratch, "links")
    linked = scratch.table(joined.join(groups, "node").select("node", "component", "class_id"), "linked")
    heads = scratch.table(linked.groupBy(F.col("component").alias("a")).agg(F.min("class_id").alias("head")), "heads")
    named = salted(linked.select(F.col("component").alias("a"), F.col("node").alias("b")), heads).select(F.col("b").alias("node"), "head")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = groups.join(counts.join(named, "node", "full"), "node", "left").select("p1", "p2", "class_id", F.coalesce("head", "class_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return (
        members.join(classes, ["p1", "p2"], "left")
        .select("doc_id", "n_shingles", *[F.when(empty, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")], F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))
    )
