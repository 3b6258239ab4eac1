"""Quality classification with a factorisation machine.

Inputs are hashed words, structure statistics of the text and numeric metadata. Besides a linear term
each input has a vector of low rank, and every pair of inputs contributes the product of their vectors;
the sum over all pairs is half of (square of the sum less sum of the squares), so a document is scored
in time linear in its inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from . import words as W

BUCKETS = 1 << 15
RANK = 8
#: Expected number of labelled documents to learn from.
TRAIN_ROWS = 6_000
#: A share for each ASCII byte and one for all others, then 7 more statistics and one metadata column.
STATISTICS = 129 + 7 + 1


def features(texts: pa.Array, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, bucket and value of hashed words, and the matrix of statistics."""
    space, values = W.is_space(), W.byte_values(False)
    bounds, buckets, weights, stats = [np.zeros(1, np.int64)], [], [], []
    for lo, hi, data, offsets in W.chunks(texts):
        starts, ends, first = W.split(data, offsets, space)
        h = (W.hash_words(data, starts, ends, values) >> np.uint64(49)).astype(np.int64)
        n, size = hi - lo, np.diff(offsets)
        row = np.repeat(np.arange(n), np.diff(first))
        key, count = np.unique(row * BUCKETS + h, return_counts=True)
        distinct = np.bincount(key // BUCKETS, minlength=n)
        bounds.append(bounds[-1][-1] + np.cumsum(distinct))
        buckets.append(key % BUCKETS)
        weights.append((1 + np.log(count)) / np.sqrt(np.maximum(np.repeat(distinct, distinct), 1)))
        kinds = np.bincount(np.repeat(np.arange(n) * 129, size) + np.minimum(data, 128), minlength=n * 129).reshape(n, 129)
        counted, length = np.maximum(np.diff(first), 1), np.maximum(size, 1)
        top = np.zeros(n)
        np.maximum.at(top, key // BUCKETS, count)
        more = [np.log1p(size), np.log1p(np.diff(first)), size / counted, distinct / counted, top / counted, np.log1p(size / (kinds[:, 10] + 1)), kinds[:, 65:91].sum(1) / length, np.log1p(np.maximum(metadata[lo:hi], 0))]
        stats.append(np.column_stack([np.sqrt(kinds / length[:, None]), *more]))
    if not stats:
        return bounds[0], np.zeros(0, np.int64), np.zeros(0), np.zeros((0, STATISTICS))
    return np.concatenate(bounds), np.concatenate(buckets), np.concatenate(weights), np.concatenate(stats)


@dataclass
class Machine:
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def inputs(self, bounds, buckets, weights, stats):
        """Row, index and value of all inputs, by row."""
        n = len(stats)
        dense = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(STATISTICS)
        row = np.concatenate([np.repeat(np.arange(n), np.diff(bounds)), np.repeat(np.arange(n), STATISTICS)])
        index = np.concatenate([buckets, np.tile(np.arange(BUCKETS, BUCKETS + STATISTICS), n)])
        value = np.concatenate([weights, dense.ravel()])
        return row, index, value

    def sums(self, n, row, index, value):
        terms = self.factors[index] * value[:, None]
        pair = np.column_stack([np.bincount(row, t, n) for t in terms.T]) if n else np.zeros((0, self.factors.shape[1]))
        squares = np.bincount(row, (terms * terms).sum(1), n)
        return self.bias + np.bincount(row, self.linear[index] * value, n) + 0.5 * ((pair * pair).sum(1) - squares), pair, terms

    def score(self, texts: pa.Array, metadata: np.ndarray) -> np.ndarray:
        bounds, buckets, weights, stats = features(texts, metadata)
        out = np.zeros(len(stats))
        for lo in range(0, len(stats), 256):
            hi = min(lo + 256, len(stats))
            part = slice(bounds[lo], bounds[hi])
            raw, _, _ = self.sums(hi - lo, *self.inputs(bounds[lo : hi + 1] - bounds[lo], buckets[part], weights[part], stats[lo:hi]))
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return out


def fit(bounds, buckets, weights, stats, labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss. One class only: its share is the score of every text."""
    rng = np.random.default_rng(seed)
    scale = stats.std(0)
    share = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(stats.mean(0), np.where(scale > 1e-9, scale, 1), float(np.log(share / (1 - share))), np.zeros(BUCKETS + STATISTICS), rng.normal(0, 0.05, (BUCKETS + STATISTICS, RANK)))
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    seen_w, seen_v, seen_b = np.full(len(m.linear), 1e-6), np.full(m.factors.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            n = np.diff(bounds)[rows]
            at = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            row, index, value = m.inputs(np.concatenate([[0], np.cumsum(n)]), buckets[at], weights[at], stats[rows])
            raw, pair, terms = m.sums(len(rows), row, index, value)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            g = error[row] * value
            u, inverse = np.unique(index, return_inverse=True)
            grad = np.bincount(inverse, g) + decay * m.linear[u]
            seen_w[u] += grad**2
            m.linear[u] -= rate * grad / np.sqrt(seen_w[u])
            slope = g[:, None] * (pair[row] - terms)
            grad_v = np.column_stack([np.bincount(inverse, s) for s in slope.T]) + decay * m.factors[u]
            seen_v[u] += grad_v**2
            m.factors[u] -= rate * grad_v / np.sqrt(seen_v[u])
            seen_b += error.sum() ** 2
            m.bias -= rate * error.sum() / np.sqrt(seen_b)
    return m


def learn(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", meta_col="n_chars", label_col="quality", train_rows: int = TRAIN_ROWS) -> Machine:
    """Learns from the texts of ``docs`` that ``labels`` (id, 0 or 1) covers: all, or about ``train_rows``, chosen
    by a hash of the identifier among those that ``docs`` has. Rows that repeat identifier and text count once."""
    W.bound_batches()
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.join(docs.select(docs[id_col].alias("doc_id")).distinct(), "doc_id", "left_semi").count()
    if total > train_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(train_rows / total * (1 << 30)))
    meta = docs[meta_col].cast("double") if meta_col else F.lit(0.0)
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), meta.alias("meta")).join(known, "doc_id").select("doc_id", "text", "meta", "label").distinct()

    def run(batches):
        for b in batches:
            bounds, buckets, weights, stats = features(b["text"], b["meta"].fill_null(0).to_numpy(zero_copy_only=False))
            rows = [(buckets[x:y].astype(np.int32).tobytes(), weights[x:y].tobytes(), s.tobytes()) for x, y, s in zip(bounds[:-1], bounds[1:], stats, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array([r[i] for r in rows], pa.binary()) for i in range(3)], b["label"]], ["doc_id", "buckets", "weights", "stats", "label"])

    rows = chosen.mapInArrow(run, "doc_id long, buckets binary, weights binary, stats binary, label int").collect()  # about train_rows
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["stats"])))
    if not rows:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((1, STATISTICS)), np.zeros(0))
    buckets = [np.frombuffer(r["buckets"], np.int32) for r in rows]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in buckets])])
    return fit(bounds, np.concatenate(buckets).astype(np.int64), np.concatenate([np.frombuffer(r["weights"]) for r in rows]), np.array([np.frombuffer(r["stats"]) for r in rows]), np.array([r["label"] for r in rows], float))


def quality(text: Column, metadata: Column, machine: Machine) -> Column:
    """The score of a text. The model travels in the function; it has about 2.4 MB whatever the corpus."""
    W.bound_batches()

    @arrow_udf("double")
    def run(texts: pa.Array, meta: pa.Array) -> pa.Array:
        return pa.array(machine.score(texts, meta.fill_null(0).to_numpy(zero_copy_only=False)), pa.float64())

    return run(text, metadata)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, id_col="doc_id", text_col="text", meta_col="n_chars", label_col="quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learns from labelled rows that ``held_out`` does not mark; with no such row every score is 0.5.
    Null texts count as empty, null metadata as 0, null labels as none; of several labels of one
    document the greatest counts. Repeated rows are scored one by one; other columns are ignored; an
    empty table gives an empty result.
    """
    machine = learn(docs.where(~held_out), labels, id_col, text_col, meta_col, label_col)
    score = quality(docs[text_col], docs[meta_col].cast("double") if meta_col else F.lit(0.0), machine)
    scored = docs.select(docs[id_col].alias("doc_id"), held_out.alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
