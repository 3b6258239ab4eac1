"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams of 1 to 3 characters. A document's own most
frequent n-grams are ranked likewise and compared with each profile by the out-of-place distance: the
sum over its n-grams of the difference of ranks, the greatest possible where the profile lacks one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .words import bound_batches

PROFILE = 400
#: Characters of which n-grams are counted at a time.
CHUNK = 1 << 20
UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The words of a text in lower case, each between single spaces; empty if there is no letter."""
    s = _NOT_LETTERS.sub(" ", text or "").strip()
    if not s or not (s.replace(" ", "").isalpha() or any(map(str.isalpha, s))):
        return ""
    return f" {s.lower()} "


def ngrams(s: str) -> np.ndarray:
    """N-grams of 1 to 3 characters as numbers of 21 bits a character; those of only spaces are left out."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != 32], two, three])


def ranked(keys: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, ties to the smaller."""
    found, counts = np.unique(keys, return_counts=True)
    if len(found) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        found, counts = found[keep], counts[keep]
    return found[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray  # sorted
    ranks: np.ndarray  # a row for each language: the rank of each gram, or size
    size: int

    def score(self, text: str | None) -> tuple[str, float]:
        s = letters(text)
        if not s or not self.languages:
            return UNDETERMINED, 0.0
        own = ranked(ngrams(s), self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == own, self.ranks[:, at], self.size)
        off = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(own)))).sum(1)
        best = int(off.argmin())
        return self.languages[best], float(1 - off[best] / (self.size * len(own)))


def _count_grams(batches):
    for b in batches:
        texts: dict[str, list] = {}
        for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
            if s := letters(text):
                texts.setdefault(lang, []).append(s)
        for lang, found in texts.items():
            totals: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            place = np.cumsum([len(s) for s in found]) // CHUNK
            cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(found))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                k, n = np.unique(np.concatenate([ngrams(s) for s in found[lo:hi]]), return_counts=True)
                k = np.concatenate([totals[0], k])
                u, inverse = np.unique(k, return_inverse=True)
                totals = u, np.bincount(inverse, np.concatenate([totals[1], n])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(totals[0]), pa.string()), pa.array(totals[0]), pa.array(totals[1])], ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles of all labelled rows of ``docs``; a language without a letter in any of them has none."""
    bound_batches()
    rows = docs.select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("gram")]
    # the first of each part of a language's grams, then the first of those
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order))
    counts = counts.withColumn("place", part).where(F.col("place") <= size)
    counts = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= size)
    top = counts.select("lang", "gram", "place").collect()  # size rows for each language
    languages = sorted({r["lang"] for r in top})
    grams = np.unique(np.array([r["gram"] for r in top], np.int64))
    ranks = np.full((len(languages), len(grams)), size, np.int64)
    for r in top:
        ranks[languages.index(r["lang"]), np.searchsorted(grams, r["gram"])] = r["place"] - 1
    return Profiles(languages, grams, ranks, size)


def predict(text: Column, profiles: Profiles) -> Column:
    """A struct of lang_pred and score. Null texts and those without a letter: ``und`` and 0."""
    bound_batches()

    @arrow_udf("struct<lang_pred string, score double>")
    def run(texts: pa.Array) -> pa.Array:
        found = [profiles.score(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Profiles are learned from all rows that ``held_out`` does not mark and that have text and label. If
    there are none, or a text is null or has no letter, the answer is ``und`` with score 0. The score
    is one less the distance over the greatest possible. Ties go to the first language by name.
    Repeated rows are judged one by one; other columns are ignored; an empty table gives an empty result.
    """
    profiles = learn_profiles(docs.where(~held_out), text_col, lang_col)
    found = predict(docs[text_col], profiles)
    return docs.select(docs[id_col].alias("doc_id"), held_out.alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")
