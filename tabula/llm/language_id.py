"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its byte n-grams (hashed into ``BUCKETS`` rows), the classes a softmax of a
linear map of it; embeddings and map are trained together by stochastic gradient descent in numpy. Since all of it is
linear up to the softmax, prediction looks every n-gram up in one table of class logits and averages.

Training reads a bounded sample, drawn by a hash of the id (texts and languages only): every language is cut at one
level so that about ``TRAIN_DOCS`` labelled documents remain, but not below ``LEAST`` a language, so that no language is
lost. A fifth of each language calibrates: a temperature for the probabilities and the least confidence at which the
accepted predictions reach ``TRUST``; there, each text weighs as many as it stands for. Predictions below it are
flagged as not accepted.

Defined cases: a null text or one without a letter is ``und`` with score 0; a row without an id is never held out and
never trained on; with no labelled document everything is ``und``; a single language gets score 1.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.functions.expr import uniform01
from tabula.llm.common import documents, register

BUCKETS = 1 << 15
DIM = 16
ORDERS = (2, 3, 4)
TRAIN_DOCS = 3000  # bound of the labelled sample that reaches the driver
LEAST = 100  # texts of a language that are always allowed
EPOCHS, BATCH, RATE = 5, 32, 40.0
TRUST = 0.995
FOLDS, HELD_OUT = 4, 2
PIECE = 1 << 20
UNKNOWN = "und"
_MUL = np.uint64(0x9E3779B97F4A7C15)


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def ngrams(texts: list[bytes], orders: tuple[int, ...], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams of texts that are framed by blanks: one array per order with an entry for each position
    (``buckets`` where the n-gram would leave its text), and the start of each text."""
    framed = [b" " + t + b" " for t in texts]
    data = np.frombuffer(b"".join(framed) + b"\0" * 8, np.uint8)
    ends = np.cumsum([len(t) for t in framed])
    n, out = int(ends[-1]), []
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    key = data[:n].astype(np.uint64)
    for k in range(1, max(orders) + 1):
        if k > 1:
            key = key | (data[k - 1: n + k - 1].astype(np.uint64) << np.uint64(8 * (k - 1)))
        if k in orders:
            h = (((key + (np.uint64(k) << np.uint64(56))) * _MUL) >> shift).astype(np.int32)
            for j in range(1, k):
                h[np.maximum(ends - j, 0)] = buckets
            out.append(h)
    return out, np.concatenate([[0], ends[:-1]])


def pieces(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        end, total = start, 0
        while end < len(texts) and (end == start or total + len(texts[end]) < size):
            total += len(texts[end])
            end += 1
        yield start, end
        start = end


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(unicodedata.category(c)[0] == "L" for c in text)


class Model(NamedTuple):
    classes: list[str]
    logits: np.ndarray  # (BUCKETS + 1, classes): embedding times map; the last row is zero
    bias: np.ndarray
    temperature: float
    threshold: float


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct hashed n-grams and their shares."""
    out = []
    for t in texts:
        ids = np.concatenate(ngrams([t], ORDERS, BUCKETS)[0])
        ids, times = np.unique(ids[ids < BUCKETS], return_counts=True)
        out.append((ids, (times / max(1, times.sum())).astype(np.float32)))
    return out


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that occur in the rows, and a row of shares of these for each."""
    used, place = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    x = np.zeros((len(rows), len(used)), np.float32)
    x[np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), place] = np.concatenate([r[1] for r in rows])
    return used, x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], cost: np.ndarray | None = None, seed: int = 7) -> Model | None:
    """Stochastic gradient descent on the embeddings and the map, then calibration on every fifth text of a language.
    ``cost``: how many labelled texts each sampled one stands for."""
    classes = sorted(set(labels))
    if not classes:
        return None
    y, rows = np.searchsorted(classes, labels), features(texts)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    calibration = fit = order
    if len(order) >= 10:
        held = np.zeros(len(order), bool)
        for k in range(len(classes)):  # languages with five texts are in both parts, others are learned only
            own = order[y[order] == k]
            held[own[::5] if len(own) >= 5 else []] = True
        calibration, fit = order[held[order]] if held.any() else order, order[~held[order]]
    parts = [fit[y[fit] == k] for k in np.unique(y[fit])]  # small languages are repeated, so that they are learned too
    fit = np.concatenate([np.resize(own, max(len(own), min(LEAST, max(map(len, parts))))) for own in parts])
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    out += rng.normal(0, 1 / DIM ** 0.5, out.shape).astype(np.float32)
    steps, step = EPOCHS * max(1, -(-len(fit) // BATCH)), 0
    for _ in range(EPOCHS):
        fit = rng.permutation(fit)
        for lo in range(0, len(fit), BATCH):
            part = fit[lo: lo + BATCH]
            used, x = dense([rows[i] for i in part])
            h = x @ emb[used]
            d = softmax(h @ out + bias)
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            pace = 1 - step / steps
            back = d @ out.T
            out -= np.float32(0.5 * pace) * (h.T @ d)
            bias -= np.float32(0.5 * pace) * d.sum(axis=0)
            emb[used] -= np.float32(RATE * pace) * (x.T @ back)
            step += 1
    table = np.vstack([emb @ out, np.zeros((1, len(classes)), np.float32)])
    z = np.vstack([rows[i][1] @ table[rows[i][0]] + bias for i in calibration]).astype(np.float64)
    truth = y[calibration]
    stands = (np.ones(len(y)) if cost is None else np.asarray(cost, float))[calibration]
    warm = np.geomspace(0.05, 20, 60)
    loss = [-np.average(np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12), weights=stands) for t in warm]
    temperature = float(warm[int(np.argmin(loss))])
    p = softmax(z / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    by = np.argsort(-top)
    trusted = np.flatnonzero(np.cumsum((right * stands)[by]) >= TRUST * np.cumsum(stands[by]))
    return Model(classes, table, bias, temperature, float(top[by][trusted[-1]]) if len(trusted) else 1.0)


def rates(counts: dict[str, int]) -> dict[str, float]:
    """Share of each language to draw: the level that leaves ``TRAIN_DOCS`` in all, and at least ``LEAST`` of each."""
    level, left = 0.0, TRAIN_DOCS
    for i, n in enumerate(sorted(counts.values())):
        level = left / (len(counts) - i)
        if n > level:
            break
        level, left = n, left - n
    return {k: min(1.0, max(level, LEAST) / n) for k, n in counts.items()}


def training_sample(docs: DataFrame) -> tuple[list[bytes], list[str], np.ndarray]:
    """Texts, languages and inverse sampling rates of labelled documents outside the held-out fold, drawn by a hash of
    the id per language."""
    pool = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    pool = pool.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT))
    counts = {r.lang: r.n for r in pool.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per class of the model
    rate = rates(counts)
    cut = [F.lit(x) for k, v in rate.items() if v < 1 for x in (k, v)]
    if cut:
        pool = pool.where(uniform01("doc_id", "lang-train") < F.coalesce(F.element_at(F.create_map(*cut), F.col("lang")), F.lit(1.0)))
    most = 2 * int(sum(v * counts[k] for k, v in rate.items())) + 100  # repeated ids are drawn together
    rows = pool.select("doc_id", "text", "lang").limit(most).collect()
    rows = sorted((r for r in rows if has_letter(r.text)), key=lambda r: (r.doc_id, r.lang, r.text))
    return [lowered(r.text) for r in rows], [r.lang for r in rows], np.array([1 / rate[r.lang] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row; only the text is an input."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x classes floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            raw = b.column("text").to_pylist()
            known = np.array([m is not None and has_letter(t) for t in raw], bool)
            texts = [lowered(t) for t in raw]
            best, score = np.zeros(len(raw), np.int64), np.zeros(len(raw))
            for lo, hi in pieces(texts) if m is not None else ():
                grams, starts = ngrams(texts[lo:hi], ORDERS, BUCKETS)
                total = sum(np.add.reduceat(m.logits[g], starts, axis=0) for g in grams)
                count = sum(np.add.reduceat((g < BUCKETS).astype(np.int64), starts) for g in grams)
                p = softmax((total / np.maximum(count, 1)[:, None] + m.bias).astype(np.float64) / m.temperature)
                best[lo:hi], score[lo:hi] = p.argmax(axis=1), p.max(axis=1)
            score[~known] = 0.0
            names = [m.classes[i] if k else UNKNOWN for i, k in zip(best, known)]
            accepted = known & (score >= m.threshold) if m is not None else known
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)],
                                             [x.split()[0] for x in schema.split(", ")])

    held = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


@register("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, trained on the folds that are not held out."""
    docs = documents(spark, sf_dir)
    return predict(docs, train(*training_sample(docs)))
