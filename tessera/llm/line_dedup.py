"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

1. Select. Of every window of ``run`` consecutive lines the smallest line hash is selected, the leftmost
   of equals. A selected position is one fingerprint however many windows it serves, and any repeated
   window has its fingerprint at the same place, so none is missed. A text shorter than a window is one
   window; so is a single line of ``heavy`` words or more.
2. Join. Positions whose hash is selected once in the corpus drop out; the others meet by their hash.
3. Extend. From each position that is left the match goes both ways over the neighbouring lines to the
   windows it serves, and these are compared line by line. The first occurrence of each stays, every
   later one marks its lines; a longer repeated run is the union of its windows.

Every join deals both sides out by key at every size, so that the cost of a row does not change with
the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

RUN = 3
#: Words that make one line a run of its own.
HEAVY = 50
_WORD = r"[^\x20\x09-\x0D]+"


def _positions(docs: DataFrame, run: int, heavy: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, pos, length, around): selected positions, the length of the windows they serve, and the
    hashes of the ``run`` - 1 lines before, of their own line and of those after (null outside the text)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where(F.col("text").isNotNull())
    weighty = lambda x: (F.char_length(x) >= 2 * heavy - 1) & (F.regexp_count(x, F.lit(_WORD)) >= heavy)
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("hash"), weighty(x).alias("heavy")))
    rows = rows.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").rlike(_WORD).alias("worded"), lines.alias("lines"))
    rows = rows.select("doc_id", "mark", "worded", F.col("lines.hash").alias("lines"), F.filter(F.transform("lines", lambda x, i: F.when(x["heavy"], i)), lambda i: i.isNotNull()).alias("heavy"))

    def smallest(start: Column) -> Column:
        own = [F.get("lines", start + i) for i in range(run)]
        least, at = F.least(*own) if run > 1 else own[0], start + (run - 1)
        for i in reversed(range(run - 1)):
            at = F.when(own[i] == least, start + i).otherwise(at)
        return at

    n = F.size("lines")
    whole = F.array((F.array_position("lines", F.array_min("lines")) - 1).cast("int"))
    selected = F.when(n >= run, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - run, F.lit(0))), smallest))).when(F.col("worded"), whole).otherwise(F.array().cast("array<int>"))
    around = lambda at: F.array(*[F.get("lines", at + i) for i in range(1 - run, run)])
    place = lambda length: lambda at: F.struct(at.alias("pos"), length.cast("int").alias("length"), around(at).alias("around"))
    single = F.when(n > 1, F.transform("heavy", place(F.lit(1)))).otherwise(F.array().cast("array<struct<pos:int,length:int,around:array<bigint>>>"))
    places = F.concat(F.transform(selected, place(F.least(n, F.lit(run)))), single)
    return rows.select("doc_id", "mark", F.explode(places).alias("p")).select("doc_id", "mark", "p.*")


def _windows(around: Column, pos: Column, length: Column, run: int) -> Column:
    """The windows that a position serves: start, and the hashes of their lines."""
    found = []
    for size in range(1, run + 1):
        for before in range(size):
            own = [F.get(around, F.lit(run - 1 - before + i)) for i in range(size)]
            fits = length == size
            for i, x in enumerate(own):
                # the leftmost of the smallest, and inside the text
                fits = fits & (x > own[before] if i < before else x.isNotNull() if i == before else x >= own[before])
            found.append(F.when(F.coalesce(fits, F.lit(False)), F.struct((pos - before).alias("start"), F.array(*own).alias("key"))))
    return F.filter(F.array(*found), lambda w: w.isNotNull())


def _marked(docs: DataFrame, run: int, heavy: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc_id, mark, n, flags): how many lines to delete and which, by identifier and hash of the text."""
    positions = scratch.table(_positions(docs, run, heavy, id_col, text_col).withColumn("print", F.get("around", F.lit(run - 1))), "positions")
    prints = scratch.table(positions.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "prints")
    met = positions.hint("merge").join(prints.hint("merge"), "print")
    served = met.select("doc_id", "mark", F.explode(_windows(F.col("around"), F.col("pos"), F.col("length"), run)).alias("w"))
    extended = scratch.table(served.select("doc_id", "mark", "w.*"), "extended")
    scratch.drop("positions", "prints")
    # rows that repeat an identifier and its text are one place here; the first of all places stays
    first = extended.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = scratch.table(first.select("key", "first"), "first")
    later = extended.hint("merge").join(first.hint("merge"), "key")
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    later = later.where(~here | (F.col("start") - F.col("first.start") >= F.size("key")))
    drop = later.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", F.size("key").alias("size"))).alias("runs"))
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1))))
    drop = drop.select("doc_id", "mark", gone.alias("gone"))
    rest = F.array_except(F.sequence(F.lit(0), F.array_max("gone")), F.col("gone"))
    # a flag for each line up to the last deleted, so that a text is filtered in one pass however long it is
    flag = lambda lines, value: F.transform(lines, lambda i: F.struct(i.alias("i"), F.lit(value).alias("gone")))
    flags = F.transform(F.array_sort(F.concat(flag(rest, False), flag(F.col("gone"), True))), lambda s: s["gone"])
    return scratch.table(drop.select("doc_id", "mark", F.size("gone").alias("n"), flags.alias("flags")), "drop")


def dedup_lines(docs: DataFrame, run: int = RUN, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from the text; all rows and other columns stay.

    Lines end at ``\\n``. A line is deleted if it lies in a run that already occurred: in a document with a
    smaller identifier, or earlier in its own without overlap. A run is ``run`` lines, a whole text of
    fewer lines that has a word, or one line of ``heavy`` words or more. Null identifiers come last; of
    documents with one identifier and different texts either may be the first. Rows that repeat
    identifier and text are treated alike. Null texts stay null, and a text all of whose lines go becomes
    empty. ``count_col`` adds the number of lines deleted. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # so that none clashes with a column of this operator
    drop = _marked(docs, run, heavy, id_col, text_col, scratch)
    scratch.drop("extended", "first")
    wide = docs.toDF(*names.values()).withColumn("_mark", F.xxhash64(F.col(names[text_col]).cast("string")))
    same = F.col(names[id_col]).cast("long").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark"))
    joined = wide.hint("merge").join(drop.hint("merge"), same, "left")
    kept = F.array_join(F.filter(F.split(names[text_col], "\n"), lambda x, i: ~F.coalesce(F.get("flags", i), F.lit(False))), "\n")
    text = F.when(F.col("n").isNull(), F.col(names[text_col])).otherwise(kept)
    out = [(text if c == text_col else F.col(name)).alias(c) for c, name in names.items()]
    if count_col:
        out.append(F.coalesce("n", F.lit(0)).cast("long").alias(count_col))
    return joined.select(*out)
