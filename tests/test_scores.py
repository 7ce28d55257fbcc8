"""Exact ROC over score ranges that a pooled bucketing would put into one bucket."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabula.operators import metrics


@pytest.fixture(scope="module")
def scored(spark):
    """One model spread over (0, 1), one with all its scores within 1e-9, one of a single score, one of a single class."""
    rng = np.random.default_rng(11)
    rows = []
    for m in ("wide", "narrow", "constant", "one class"):
        s = rng.uniform(size=700).round(3)
        y = (rng.uniform(size=700) < s).astype(int) if m != "one class" else np.ones(700, dtype=int)
        s = {"narrow": 0.5 + s * 1e-9, "constant": np.full(700, 0.25)}.get(m, s)
        rows += [(m, int(a), float(b)) for a, b in zip(y, s)]
    return rows, spark.createDataFrame(rows, "model string, label int, score double")


def auc(rows, m):
    pos = np.array([s for k, y, s in rows if k == m and y == 1])
    neg = np.array([s for k, y, s in rows if k == m and y == 0])
    if not len(pos) or not len(neg):
        return None
    return float(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean())


@pytest.mark.parametrize("size", [7, 100_000])
def test_auc_of_every_model(scored, size):
    rows, df = scored
    got = {r.model: r.roc_auc for r in metrics.roc_auc(df, ["model"], rows_per_bucket=size).collect()}
    assert got == {m: (None if auc(rows, m) is None else pytest.approx(auc(rows, m))) for m in got} and len(got) == 4


def test_buckets_follow_the_data(scored):
    _rows, df = scored
    c = metrics.score_cumulative(df, ["model"], rows_per_bucket=50)
    sizes = [r["count"] for r in c.where("model = 'narrow'").groupBy("b").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 150


def test_curve_does_not_depend_on_the_buckets(scored):
    _rows, df = scored
    curves = [sorted((r.model, r.fpr if r.fpr is not None else -1, r.tpr, r.threshold or -1) for r in metrics.roc_curve(df, ["model"], rows_per_bucket=n).collect())
              for n in (5, 100_000)]
    assert curves[0] == curves[1] and len(curves[0]) > 100


def test_no_keys_and_an_empty_table(spark, scored):
    rows, df = scored
    one = df.where("model = 'wide'")
    assert metrics.roc_auc(one, rows_per_bucket=9).first()[0] == pytest.approx(auc(rows, "wide"))
    assert metrics.roc_curve(df.limit(0), ["model"]).count() == 0
    nulls = df.withColumn("model", F.when(F.col("model") != "wide", F.col("model")))
    assert metrics.roc_auc(nulls, ["model"], rows_per_bucket=9).where("model is null").count() == 1
