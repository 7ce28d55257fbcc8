"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed byte n-grams. Every n-gram has r, the log ratio of its smoothed document frequencies
in toxic and other texts; a logistic regression is trained on the features r (stochastic gradient descent in numpy,
L2 penalty), so an n-gram weighs by how it separates the classes. Prediction sums r times weight over the set.

Training reads a bounded sample: at most about ``PER_CLASS`` labelled texts of each class outside the held-out fold,
drawn by a hash of their id; the ids are joined as a bounded broadcast, so no text is shuffled. Each sampled text
weighs as many as it stands for; a fifth of the sample turns raw scores into probabilities.

Defined cases: null and empty texts get the score of the intercept alone; an id with several labels is toxic if any
label says so; a row without an id is never held out and never trained on; without labels of both classes the score
is that of the only class (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.functions.expr import uniform01
from tabula.llm.common import documents, register
from tabula.llm.language_id import fold_of, lowered, ngrams, pieces

BUCKETS = 1 << 18
ORDERS = (4, 5, 6)
PER_CLASS = 2500  # bound of the labelled sample that reaches the driver, per class
MIN_DOCS = 3  # texts an n-gram must occur in
EPOCHS, BATCH, RATE, PENALTY = 20, 64, 0.5, 1e-4
FOLDS, HELD_OUT = 5, 0


class Model(NamedTuple):
    weight: np.ndarray  # r times the trained weight, one per bucket and a zero
    bias: float


def gram_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct hashed n-grams of each text."""
    out = []
    for lo, hi in pieces(texts):
        grams, starts = ngrams(texts[lo:hi], ORDERS, BUCKETS)
        ends = np.append(starts[1:], len(grams[0]))
        for a, b in zip(starts.tolist(), ends.tolist()):
            ids = np.unique(np.concatenate([g[a:b] for g in grams]))
            out.append(ids[ids < BUCKETS])
    return out


def _descend(sets: list[np.ndarray], y: np.ndarray, cost: np.ndarray, f: np.ndarray, pace0: float, rng) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression on features ``f``: averaged stochastic gradient descent."""
    w, bias, mean = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS + 1)
    steps, step = EPOCHS * -(-len(sets) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(sets))
        for lo in range(0, len(order), BATCH):
            part, pace = order[lo: lo + BATCH], 1 - step / steps
            ids = np.concatenate([sets[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(sets[i]) for i in part])
            z = np.bincount(row, weights=(f * w)[ids], minlength=len(part)) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * cost[part]
            w -= pace0 * pace * (np.bincount(ids, weights=err[row], minlength=BUCKETS) * f / len(part) + PENALTY * w)
            bias -= 0.5 * pace * err.mean()
            step += 1
            if step > steps // 2:
                mean[:-1] += w
                mean[-1] += bias
    mean /= max(1, step - steps // 2)
    return mean[:-1], float(mean[-1])


def _calibrate(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of the label on the raw score, by damped Newton steps; the targets
    are smoothed by one virtual text per class, so separable scores stay finite."""
    up, down = cost[y == 1].sum(), cost[y == 0].sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = x.T @ (cost * (p - target))
        h = (x * (cost * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / (np.abs(d).max() + 1e-12))
        a, b = a - d[0], b - d[1]
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(sets: list[np.ndarray], y: np.ndarray, cost: np.ndarray, seed: int = 11) -> Model:
    """``cost``: how many labelled texts each sampled one stands for. A fifth of the sample calibrates the scores."""
    weight = np.zeros(BUCKETS + 1)
    if not len(y) or y.all() or not y.any():
        share = float(np.mean(y)) if len(y) else 0.0
        return Model(weight, 30.0 if share else -30.0)
    counts = [np.bincount(np.concatenate([s for s, c in zip(sets, y) if c == k]), minlength=BUCKETS) for k in (1, 0)]
    r = np.log((1 + counts[0]) / (1 + np.sum(y == 1))) - np.log((1 + counts[1]) / (1 + np.sum(y == 0)))
    r[counts[0] + counts[1] < MIN_DOCS] = 0.0
    sets = [s[r[s] != 0] for s in sets]
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for k in (0, 1):  # both classes in both parts where they have five texts
        held[rng.permutation(np.flatnonzero(y == k))[::5] if np.sum(y == k) >= 5 else []] = True
    scale = 1.0 / np.sqrt(np.mean([np.sum(r[s] ** 2) for s in sets]) + 1e-9)  # features of unit mean square norm
    f, part = r * scale, np.flatnonzero(~held)
    w, bias = _descend([sets[i] for i in part], y[part], (cost / cost.mean())[part], f, RATE / scale, rng)
    z = np.array([(f * w)[s].sum() for s in sets]) + bias
    a, b = _calibrate(z[held], y[held], cost[held]) if held.any() and y[held].any() and not y[held].all() else (1.0, 0.0)
    weight[:-1] = a * f * w
    return Model(weight, a * bias + b)


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, labels and the inverse sampling rate of about ``PER_CLASS`` documents of each class."""
    pool = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    pool = pool.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    n = {r.y: r.n for r in pool.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = {c: min(1.0, PER_CLASS / max(1, n.get(c, 0))) for c in (0, 1)}
    drawn = pool.where(uniform01("doc_id", "toxic-train") < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])).limit(3 * PER_CLASS)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").where("text IS NOT NULL").limit(6 * PER_CLASS).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    return [lowered(r.text) for r in rows], np.array([r.y for r in rows], np.int64), np.array([1 / rate[r.y] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only the text is an input."""
    schema = "doc_id long, held_out boolean, score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weight, used = m.weight, m.weight != 0
        for b in batches:
            texts = [lowered(t) for t in b.column("text").to_pylist()]
            z = np.full(len(texts), m.bias)
            for lo, hi in pieces(texts):
                grams, starts = ngrams(texts[lo:hi], ORDERS, BUCKETS)
                ends = np.append(starts[1:], len(grams[0]))
                for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                    ids = np.concatenate([g[s:e] for g in grams])
                    z[lo + i] += weight[np.unique(ids[used[ids]])].sum()
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [x.split()[0] for x in schema.split(", ")])

    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


@register("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, trained on the labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts, y, cost = training_sample(docs, labels)
    return predict(docs, train(gram_sets(texts), y, cost))
