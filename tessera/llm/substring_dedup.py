"""Removal of passages that repeat, by prefix-partitioned suffix trees over words.

A window is a run of ``window`` words, so a repeated window is a node of the suffix tree of all texts at
that depth with two leaves or more. Suffixes are sampled: each window has an anchor, of its runs of
``gram`` words the one with the smallest hash, and equal windows have equal anchors at equal places. So
the tree holds only suffixes that begin at anchors (about one in fourteen), and beside it stands the tree
of what precedes them: a window is a node of the one together with a node of the other.

1. Prefixes are counted. The first is the anchor's run: where it occurs once, no window of that anchor
   repeats. Suffixes whose whole span (the words of all their windows) occurs again are done, and one of
   each such span stands for its copies from here on.
2. Prefixes that too many suffixes share are lengthened: half of an anchor's windows have so many words
   after the anchor in common, the other half so many before it. Where even those are shared by too many,
   the prefix becomes the whole window and counting it is all there is to do.
3. Each group of suffixes, which fits in memory, is sorted both ways by its words. Common prefixes of
   neighbours give the nodes, and those of ``window`` words with two leaves are the repeats.

Hashes name prefixes and copies of spans (128 bits beside the prefix); trees and windows compare words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from ..sources.scratch import Scratch

WINDOW = 35
GRAM = 8
#: Suffixes in one tree, about 1 KB each.
GROUP = 8192
#: Suffixes whose trees are built at a time.
FOREST = 32_768
_SPANS = "doc_id long, mark long, key long, first int, n int, at int, s1 long, s2 long, right long, left long"
_SUFFIXES = "gid long, lo int, hi int, whole boolean, doc_id long, mark long, first int, n int, at int, single boolean, words binary"


def smallest_at(h: np.ndarray, n: int) -> np.ndarray:
    """For each run of n hashes the place of its smallest, the first of equals."""
    if len(h) < n:
        return np.zeros(0, np.int64)
    at, width = np.arange(len(h)), 1
    while width < n:
        step = min(width, n - width)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        width += step
    return at


def _rows(texts: pa.Array, window: int, gram: int):
    """Yields for each text the hashes of its anchors' runs and their places."""
    space, values = W.is_space(), W.byte_values(False)
    for _, _, data, offsets in W.chunks(texts):
        starts, ends, first = W.split(data, offsets, space)
        words = W.hash_words(data, starts, ends, values)
        runs = W.hash_runs(words, gram)
        anchors = smallest_at(runs, window - gram + 1)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            at = np.unique(anchors[lo : max(lo, hi - window + 1)])
            yield runs[at], at - lo


def _anchors(window: int, gram: int):
    def run(batches):
        for batch in batches:
            keys, rows, places = [], [], []
            for i, (found, at) in enumerate(_rows(batch["text"], window, gram)):
                keys.append(found)
                rows.append(np.full(len(at), i))
                places.append(at)
            row = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            out = [batch["doc_id"].take(row), batch["mark"].take(row), pa.array(np.concatenate(places) if rows else [], pa.int32()), pa.array(np.concatenate(keys).astype(np.int64) if rows else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "mark", "place", "key"])

    return run


def _halves(window: int, gram: int) -> int:
    """Of the places where a window may begin before its anchor, those from this one on are the second half."""
    return (window - gram + 1) // 2


def _owned(part: pa.RecordBatch, window: int, gram: int):
    """Yields, chunk by chunk, columns of the wanted anchors: row, hash, first window, number of windows, place,
    two hashes of their span, and hashes of the words that each half of the windows has in common."""
    space, values = W.is_space(), W.byte_values(False)
    half, i = _halves(window, gram), 0
    for _, _, data, offsets in W.chunks(part["text"]):
        starts, ends, bounds = W.split(data, offsets, space)
        words = W.hash_words(data, starts, ends, values)
        runs = W.hash_runs(words, gram)
        anchors = smallest_at(runs, window - gram + 1)
        found = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at, first, n = np.unique(anchors[a : max(a, b - window + 1)], return_index=True, return_counts=True)
            keep = np.isin(at - a, np.asarray(part["places"][i].values))
            size = int(keep.sum())
            found.append((np.full(size, i), at[keep], first[keep], n[keep], np.full(size, a), np.full(size, b)))
            i += 1
        row, at, first, n, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
        begin, end = low + first, low + first + n - 1 + window
        again = W.mix(words ^ np.uint64(0x5851F42D4C957F2D))
        after = W.hash_spans(words, at, np.minimum(at + window - half + 1, high))
        before = W.hash_spans(words, np.maximum(at - half, low), at + gram)
        yield row, runs[at], first, n, at - low, W.hash_spans(words, begin, end), W.hash_spans(again, begin, end), after, before


def _spans(window: int, gram: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                row, key, first, n, at, *hashes = (np.concatenate(c) for c in zip(*_owned(part, window, gram), strict=True))
                rows = pa.array(row, pa.int64())
                out = [part["doc_id"].take(rows), part["mark"].take(rows), pa.array(key.astype(np.int64)), *[pa.array(x, pa.int32()) for x in (first, n, at)], *[pa.array(h.astype(np.int64)) for h in hashes]]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "mark", "key", "first", "n", "at", "s1", "s2", "right", "left"])

    return run


def _texts(window: int):
    """A row for each suffix with the words of its span, or for each of its windows where ``whole``; a space
    follows every word."""
    names = ["gid", "lo", "hi", "whole", "doc_id", "mark", "first", "n", "at", "single", "words"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for doc, mark, text, wanted in zip(part["doc_id"].to_pylist(), part["mark"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), part["suffixes"].to_pylist(), strict=True):
                    words = text.split()  # at the six ASCII white spaces
                    for s in wanted:
                        first, n, at = s["first"], s["n"], s["at"]
                        spans = [(first, n)]
                        if s["whole"]:
                            spans = [(i, 1) for i in range(max(first, at - s["hi"]), min(first + n - 1, at - s["lo"]) + 1)]
                        for i, k in spans:
                            rows.append((s["gid"], s["lo"], s["hi"], s["whole"], doc, mark, i, k, at - i, s["single"], b" ".join(words[i : i + k - 1 + window]) + b" "))
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _nodes(rows: np.ndarray, group: np.ndarray):
    """Sorts the rows of a matrix within their groups. Returns a function that numbers the nodes of the tree at
    a depth: rows of one group that agree in so many columns have one number."""
    order = np.lexsort([*rows.T[::-1], group])
    ahead, here = rows[order[:-1]], rows[order[1:]]
    common = np.where(group[order[1:]] == group[order[:-1]], np.logical_and.accumulate(ahead == here, axis=1).sum(1), -1)

    def at(depth: int) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        out[order] = np.concatenate([[0], np.cumsum(common < depth)])
        return out

    return at


def repeats_in(group, words: pa.Array, at, n, lo, hi, window: int, gram: int) -> np.ndarray:
    """For each suffix (a row) and each of its windows (a column) whether the window is also another suffix's.
    ``words`` are spans with a space after every word, ``at`` where the anchor stands in them."""
    data, offsets = W.string_buffers(words)
    starts, _, bounds = W.split(data, offsets, W.is_space())
    # a word with the space behind it ends where the next begins
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    ids = np.append(np.asarray(every.dictionary_encode().indices).astype(np.int32), -1)
    low, high, most = bounds[:-1][:, None], bounds[1:][:, None], window - gram
    after = (low[:, 0] + at)[:, None] + np.arange(window)
    before = (low[:, 0] + at)[:, None] - 1 - np.arange(most)
    after = _nodes(ids[np.where(after < high, after, -1)], group)
    before = _nodes(ids[np.where(before >= low, before, -1)], group) if most else lambda depth: np.zeros(len(n), np.int64)
    found = np.zeros((len(n), most + 2), bool)
    for back in range(most + 1):
        own = np.flatnonzero((lo <= back) & (back <= hi) & (back <= at) & (at - back < n))
        _, inverse, counts = np.unique(after(window - back)[own] * (len(n) + 1) + before(back)[own], return_inverse=True, return_counts=True)
        again = own[counts[inverse] > 1]
        found[again, at[again] - back] = True
    return found


def _trees(window: int, gram: int):
    """Suffixes come sorted by group. Yields the repeated windows of those marked ``single`` as runs."""

    def build(t: pa.Table):
        t = t.combine_chunks()
        col = lambda c: t[c].chunk(0)
        number = lambda c: np.asarray(col(c)).astype(np.int64)
        found = repeats_in(number("gid"), col("words").cast(pa.large_binary()), number("at"), number("n"), number("lo"), number("hi"), window, gram)
        found[~np.asarray(col("single"))] = False
        step = np.diff(np.pad(found, ((0, 0), (1, 0))).astype(np.int8), axis=1)
        (row, begin), (_, end) = np.nonzero(step == 1), np.nonzero(step == -1)
        rows = pa.array(row)
        return pa.RecordBatch.from_arrays([col("doc_id").take(rows), col("mark").take(rows), pa.array((number("first")[row] + begin).astype(np.int32)), pa.array((end - begin).astype(np.int32))], ["doc_id", "mark", "first", "n"])

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            if sum(b.num_rows for b in kept) < FOREST:
                continue
            t = pa.Table.from_batches(kept)
            gid = np.concatenate([np.asarray(b["gid"]) for b in kept])
            cut = int(np.searchsorted(gid, gid[-1]))
            if cut:
                yield build(t.slice(0, cut))
                kept = t.slice(cut).combine_chunks().to_batches()
        if kept:
            yield build(pa.Table.from_batches(kept))

    return run


def covered(words: int, first: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of so many words lie in n windows from ``first`` on."""
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + n - 1 + window, -1)
    return np.cumsum(change[:-1]) > 0


def _keep(window: int):
    def run(batches):
        space = W.is_space()
        for batch in batches:
            texts, counts, removed = [], [], []
            wanted = iter(batch["found"])
            for _, _, data, offsets in W.chunks(batch["text"]):
                starts, ends, first = W.split(data, offsets, space)
                raw = data.tobytes()
                for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    found = next(wanted)
                    kept = np.arange(lo, hi)
                    if found.is_valid and len(found.values):
                        first, n = (np.asarray(found.values.field(c)) for c in ("first", "n"))
                        kept = kept[~covered(hi - lo, first, n, window)]
                    counts.append(hi - lo)
                    removed.append(hi - lo - len(kept))
                    texts.append(b" ".join([raw[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, text (kept words joined by one space).

    Removes every word covered by a window whose words also start anywhere else, in the same document
    or another; windows are judged on the input. Null and empty texts have no words and give an empty
    text. Rows that repeat, with their identifier or another's or none, are documents of their own.
    Other columns are ignored; an empty table gives an empty result. ``group`` is how many suffixes a
    tree may hold; it changes no result.
    """
    W.bound_batches()
    spark = docs.sparkSession
    scratch, half, most = Scratch(spark, "substring-dedup"), _halves(window, gram), window - gram
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("doc_id", "text"))
    same = F.expr("r.mark = b.mark and r.doc_id <=> b.doc_id")
    # an identifier and a text may repeat together, and such rows are treated alike
    with_texts = lambda found: rows.hint("merge").alias("r").join(found.hint("merge").alias("b"), same)

    anchors = scratch.table(rows.mapInArrow(_anchors(window, gram), "doc_id long, mark long, place int, key long"), "anchors", "none")
    repeated = scratch.table(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    scratch.free()
    branches = anchors.hint("merge").join(repeated.hint("merge"), "key").groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places"))
    branches = scratch.table(branches, "branches")
    scratch.drop("anchors", "keys")
    spans = scratch.table(with_texts(branches).select("r.doc_id", "r.mark", "r.text", "b.places").mapInArrow(_spans(window, gram), _SPANS), "spans")
    scratch.drop("branches")

    one = F.min(F.struct("doc_id", "mark", "first", "n", "at", "right", "left")).alias("one")
    leaves = scratch.table(spans.groupBy("key", "s1", "s2").agg(F.count(F.lit(1)).alias("times"), one).select("key", "s1", "s2", "times", "one.*"), "leaves")
    copies = leaves.where("times > 1").select("key", "s1", "s2")
    done = scratch.table(spans.hint("merge").join(copies.hint("merge"), ["key", "s1", "s2"]).select("doc_id", "mark", "first", "n"), "done")
    scratch.drop("spans")
    nodes = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("spans"), F.min("times").alias("least")).where("spans > 1 and least = 1").select("key", "spans")
    nodes = scratch.table(nodes, "nodes")
    open_ = leaves.hint("merge").join(nodes.hint("merge"), "key").select("doc_id", "mark", "first", "n", "at", (F.col("times") == 1).alias("single"), "key", "right", "left", "spans")
    open_ = scratch.table(open_, "open")
    scratch.drop("leaves")
    columns = ["doc_id", "mark", "first", "n", "at", "single"]
    prefix = lambda c, lo, hi: F.struct(F.xxhash64(c, F.lit(lo)).alias("gid"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    suffixes = open_.where(F.col("spans") <= group).select(*columns, prefix("key", 0, most).alias("p"), F.lit(False).alias("whole"))
    if nodes.where(F.col("spans") > group).take(1):
        longer = open_.where(F.col("spans") > group).select(*columns, F.explode(F.array(prefix("right", 0, half - 1), prefix("left", half, most))).alias("p"))
        longer = longer.where("at - first >= p.lo and at - first - n + 1 <= p.hi")
        sizes = scratch.table(longer.groupBy("p.gid").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        longer = longer.withColumn("gid", F.col("p.gid")).hint("merge").join(sizes.hint("merge"), "gid")
        suffixes = suffixes.unionByName(longer.select(*columns, "p", (F.col("size") > group).alias("whole")))
    wanted = suffixes.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("p.gid", "p.lo", "p.hi", "whole", "first", "n", "at", "single")).alias("suffixes"))
    wanted = scratch.table(wanted, "wanted")
    scratch.drop("nodes", "open", "sizes")
    texts = scratch.table(with_texts(wanted).select("r.doc_id", "r.mark", "r.text", "b.suffixes").mapInArrow(_texts(window), _SUFFIXES), "texts")
    scratch.drop("wanted")
    trees = texts.where("not whole").repartition("gid").sortWithinPartitions("gid")
    found = trees.mapInArrow(_trees(window, gram), "doc_id long, mark long, first int, n int")
    deep = texts.where("whole").select("doc_id", "mark", "first", "n", "words", "single")
    often = scratch.table(deep.groupBy("words").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("words"), "deep")
    again = deep.where("single").hint("merge").join(often.hint("merge"), "words").select("doc_id", "mark", "first", "n")
    repeats = done.unionByName(found).unionByName(again).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "n")).alias("found"))
    repeats = scratch.table(repeats, "repeats")
    scratch.drop("done", "texts", "deep")
    marked = rows.hint("merge").alias("r").join(repeats.hint("merge").alias("b"), same, "left").select("r.doc_id", "r.text", "b.found")
    return marked.mapInArrow(_keep(window), "doc_id long, n_words long, n_removed long, text string")
