"""Boosting over cells: the trees of Spark's own fit, whole profiles in the registered queries."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabula.operators import boosting, models, search, tuning
from tabula.plans import q_flow, q_models


def _rows(spark, n=1500, noise=0.1, seed=3):
    rng = np.random.default_rng(seed)
    q, d, flag = rng.integers(1, 51, n), rng.integers(0, 11, n) / 100, rng.integers(0, 3, n)
    price = q * rng.uniform(900, 2100, n)
    y = ((q >= 40) & (d >= 0.05)) ^ (rng.random(n) < noise)
    return spark.createDataFrame([(i, Vectors.dense([float(q[i]), float(price[i]), float(d[i]), float(flag[i] == 0), float(flag[i] == 1)]), int(y[i]))
                                  for i in range(n)], ["row_id", "features", "label"]).coalesce(2)


def _spark_fit(est, df):
    same = {p.name: v for p, v in est.extractParamMap().items() if est.isSet(p)}
    return GBTClassifier(**same).fit(df)


def _raw(model, df):
    return np.array([r[0][1] for r in model.transform(df).orderBy("row_id").select("rawPrediction").collect()])


@pytest.mark.parametrize("profile, overrides", [("A", {"n_estimators": 8, "max_depth": 3}), ("B", {"n_estimators": 4, "max_depth": 3, "gamma": 0.1})])
def test_cells_grow_the_trees_of_spark(spark, profile, overrides):
    """Shallow trees: among leaves of a few rows splits of equal gain abound, and rounding chooses."""
    df = _rows(spark, 3000)
    est = models.gbt(profile, overrides)
    ours, theirs = est.fit(df), _spark_fit(est, df)
    assert [t.numNodes for t in ours.trees] == [t.numNodes for t in theirs.trees]
    assert list(ours.treeWeights) == list(theirs.treeWeights)
    assert np.allclose(_raw(ours, df), _raw(theirs, df), atol=1e-9)
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)
    assert ours.getMaxIter() == est.getMaxIter() and ours.uid == est.uid


def test_deep_levels_in_chunks_grow_the_same_trees(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(3, 3000))
    splits = [boosting.feature_splits(v, 3000.0, 63) for v in x]
    bins = np.stack([np.searchsorted(s, v) for s, v in zip(splits, x)]).astype(np.uint8)
    y = np.where((x.sum(axis=0) > 1.5) ^ (rng.random(3000) < 0.3), 1.0, -1.0)
    p = boosting.Rounds(1, 12, 0.3, 1, 0.0, 1.0, 3, 42)  # the first tree's sums are whole numbers, so equal gains stay equal
    (whole, score), = boosting.boosted(bins, y, np.ones(3000), splits, p)
    monkeypatch.setattr(boosting, "HISTOGRAM", 500)  # a node or two a chunk
    (chunks, score2), = boosting.boosted(bins, y, np.ones(3000), splits, p)
    assert len(whole["id"]) > 500 and np.array_equal(whole["feature"], chunks["feature"]) and np.allclose(score, score2)


def test_more_cells_than_a_task_holds_are_left_to_spark(spark, monkeypatch):
    df = _rows(spark, 1000)
    est = models.gbt("A", {"n_estimators": 2, "max_depth": 2})
    ours = est.fit(df)
    monkeypatch.setattr(boosting, "CELL_BYTES", 0)
    assert est.cells(df) is None
    assert np.allclose(_raw(ours, df), _raw(est.fit(df), df), atol=1e-9)


def test_equal_rows_count_as_often_as_they_come(spark):
    df = _rows(spark, 600)
    three = df.unionAll(df).unionAll(df)
    est = models.gbt("B", {"n_estimators": 2, "max_depth": 2})
    assert est.cells(three).n == est.cells(df).n
    assert np.allclose(_raw(est.fit(three), df), _raw(_spark_fit(est, three), df), atol=1e-9)


def test_subsamples_are_repeatable_and_do_not_depend_on_partitions(spark):
    df = _rows(spark)
    est = models.gbt("A", {"n_estimators": 10, "subsample": 0.6, "colsample_bytree": 0.6})
    a, b = est.fit(df), est.fit(df.repartition(5))
    assert np.array_equal(_raw(a, df), _raw(b, df))
    assert abs(a.evaluateEachIteration(df)[-1] - _spark_fit(est, df).evaluateEachIteration(df)[-1]) < 0.05


def test_trial_over_cells_equals_the_staged_fit(spark):
    df = _rows(spark)
    train, valid = df.where("row_id < 1000"), df.where("row_id >= 1000")
    est = models.gbt("B", {"n_estimators": 60, "max_depth": 2, "learning_rate": 0.2})
    counts = est.held_counts(est.cells(train, valid), patience=5)
    model, n = search.staged_fit(est, train, valid, patience=5)
    out = search.first_trees(model, n).transform(valid).groupBy("label", F.col("prediction").cast("int").alias("p")).count().collect()
    assert {r["n_trees"] for r in counts} == {n}
    assert {(r["label"], r["prediction"]): r["n"] for r in counts if r["n"]} == {(r["label"], r["p"]): r["count"] for r in out}


def test_comparison_over_cells_equals_fits_over_rows(spark, monkeypatch):
    df = _rows(spark).withColumn("fold", F.col("row_id") % 3)
    ests = {"A": lambda: models.gbt("A", {"n_estimators": 2, "max_depth": 2})}
    ours = {(r["model"], r["fold"]): r["f1"] for r in search.cv_compare(df, ests).collect()}
    monkeypatch.setattr(boosting, "CELL_BYTES", 0)
    theirs = {(r["model"], r["fold"]): r["f1"] for r in search.cv_compare(df, ests).collect()}
    assert ours == pytest.approx(theirs) and len(ours) == 3


def test_registered_fits_use_whole_profiles(spark, monkeypatch, tmp_path):
    """F19 to F23: no override cuts the trees of fit_gbt_*, stacking or compare_all."""
    seen = {}

    class Stop(Exception):
        pass

    def stop(_train, _valid, base, **_kw):
        seen["stacking"] = {n: e.getMaxIter() for n, e in base.items() if isinstance(e, GBTClassifier)}
        raise Stop

    class Part:
        def part(self, _name):
            return spark.createDataFrame([], "row_id int")

        fit_rows = lambda self: self.part("train")

    monkeypatch.setattr(q_models, "prepare", lambda *_a, **_k: Part())
    monkeypatch.setattr(models, "stacking", stop)
    monkeypatch.setattr(boosting.BoostedTrees, "fit", lambda self, _df: seen.setdefault("fit", []).append(self.getMaxIter()))
    monkeypatch.setattr(models, "score", lambda *_a: None)
    monkeypatch.setattr(q_models, "_eval", lambda *_a: None)
    for q in (q_models.q_fit_gbt_a, q_models.q_fit_gbt_b, q_models.q_fit_gbt_c):
        q(spark, "")
    with pytest.raises(Stop):
        q_models.q_stacking(spark, "")

    class Prepared:
        def transform(self, df):
            return df.selectExpr("1 AS row_id", "0 AS label", "0 AS features")

    monkeypatch.setattr(q_flow, "parts", lambda *_a: [spark.range(1)] * 3)
    monkeypatch.setattr(q_flow.flow, "fold_sets", lambda *_a, **_k: [])
    monkeypatch.setattr(q_flow.flow, "fit_preparation", lambda *_a: Prepared())
    monkeypatch.setattr(q_flow.flow, "training_rows", lambda *_a: None)
    monkeypatch.setattr(tuning, "compare_models", lambda _s, _r, _h, members, _st: members)
    members = q_flow.q_compare_all(spark, "")
    assert seen["fit"] == [100, 100, 1000]
    assert seen["stacking"] == {"gbt_a": 100, "gbt_b": 100, "gbt_c": 1000}
    assert {n: e.getMaxIter() for n, e in members.items() if isinstance(e, GBTClassifier)} == {
        "XGBoost": 100, "LGBMClassifier": 100, "CatBoostClassifier": 1000}
