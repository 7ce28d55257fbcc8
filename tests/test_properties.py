"""Property tests for the operators whose results depend on hashing, resampling or fitted models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabula.operators import explain, metrics, models, neighbors, resample, split
from tabula.plans.fixtures import planted


def test_split_exact_disjoint(spark):
    p = planted(spark, SF_SMALL).select("row_id", "y")
    s = split.three_way_split(p, "y", "row_id", 0.2, 0.2, 42)
    counts = split.class_counts(p, "y")
    test = split.split_allocation(counts, 0.2)
    got = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    for c, n in counts.items():
        assert got[(c, "test")] == test[c]
        assert sum(v for (cc, _), v in got.items() if cc == c) == n
    assert s.select("row_id").distinct().count() == p.count()


def test_kfold_balanced(spark):
    p = planted(spark, SF_SMALL).select("row_id", "y")
    f = split.stratified_kfold(p, "y", "row_id", 5, 42)
    by = {}
    for r in f.groupBy("y", "fold").count().collect():
        by.setdefault(r.y, []).append(r["count"])
    for sizes in by.values():
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    ref = rng.normal(size=(300, 5))
    qs = rng.normal(size=(40, 5))
    rdf = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(ref)], "r_id long, v array<double>, label int")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "q_id long, v array<double>")
    for metric, block in (("euclidean", 8192), ("manhattan", 8192), ("euclidean", 5)):
        # block=5 splits every 16-row cell into salted sub-blocks (the hot-cell path)
        got = neighbors.knn(qdf, rdf, 4, metric, cell_rows=16, block_rows=block).collect()
        res = {}
        for r in got:
            res.setdefault(r.q_id, []).append((r["rank"], r.r_id))
        for qi, q in enumerate(qs):
            d = np.sqrt(((ref - q) ** 2).sum(1)) if metric == "euclidean" else np.abs(ref - q).sum(1)
            want = list(np.lexsort((np.arange(len(ref)), d))[:4])
            assert [rid for _, rid in sorted(res[qi])] == want


def test_smote_points_on_segments(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist(), 0) for i in range(40)] + [(100 + i, (rng.normal(size=3) + 3).tolist(), 1) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    syn = resample.smote_samples(df, "y", "id", "v", k=5, seed=42).collect()
    assert len(syn) == 28
    vec = {r[0]: np.array(r[1]) for r in rows}
    for r in syn:
        a, b = vec[r.base_id], vec[r.neighbor_id]
        assert np.allclose(np.array(r.v), a + r.gap * (b - a))
        assert r.neighbor_id >= 100 and r.neighbor_id != r.base_id


def test_auc_invariant_to_monotone_transform(spark):
    df = spark.createDataFrame([(int(i % 3 == 0), float((i * 37) % 101) / 101) for i in range(500)], "label int, score double")
    a1 = metrics.roc_auc(df).first()[0]
    a2 = metrics.roc_auc(df.withColumn("score", F.exp(F.col("score") * 3))).first()[0]
    assert a1 == pytest.approx(a2)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ref = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(
        df.withColumn("label", F.col("label").cast("double")))
    assert a1 == pytest.approx(ref)


def test_tree_shap_additive_and_gbt_learns(spark):
    from tabula.plans.learning import prepare
    p = prepare(spark, SF_SMALL)
    m = models.gbt("A", {"n_estimators": 8, "max_depth": 3}).fit(p.part("train"))
    scored = models.score(m, p.part("validation"))
    assert metrics.roc_auc(scored).first()[0] > 0.9
    shap, base = explain.shap_tree(p.part("validation"), m, p.prep.names)
    tot = shap.groupBy("row_id").agg(F.sum("shap").alias("s"))
    raw = m.transform(p.part("validation")).select("row_id", (F.col("rawPrediction").getItem(1) if False else F.lit(0.0)).alias("_"))
    from pyspark.ml.functions import vector_to_array
    margin = m.transform(p.part("validation")).select("row_id", (2 * vector_to_array("rawPrediction")[1]).alias("m"))
    j = tot.join(margin, "row_id").collect()
    assert len(j) > 0 and raw is not None
    for r in j:
        assert r.s + base == pytest.approx(r.m, abs=1e-6)


def test_exact_quantiles_band_path_matches_percentile(spark):
    """Force the narrowing path (map_limit=1) and compare with Spark's exact ``percentile``."""
    from tabula.operators import profile
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cols = ["l_extendedprice", "l_quantity", "l_discount"]
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = profile.exact_quantiles(li, cols, probs, map_limit=1)
    ref = li.agg(*[F.percentile(F.col(c).cast("double"), list(probs)).alias(c) for c in cols]).first()
    for c in cols:
        assert got[c] == pytest.approx(list(ref[c]), rel=1e-12, abs=1e-9)


def test_holdout_search_keeps_the_best_prefix(spark):
    """A label that one tree of depth 1 hardly helps: the trial goes on until patience ends, on resampled rows."""
    import inspect

    from pyspark.ml.linalg import Vectors

    from tabula.operators import search
    from tabula.plans import q_models

    rng = np.random.default_rng(5)
    x = rng.uniform(size=(800, 3))
    y = ((x.sum(axis=1) > 1.5) ^ (rng.uniform(size=800) < 0.1)).astype(int)
    data = spark.createDataFrame([(i, float(c), Vectors.dense(v)) for i, (v, c) in enumerate(zip(x.tolist(), y))], ["row_id", "label", "features"])
    train, valid = data.where("row_id < 500").cache(), data.where("row_id >= 500").cache()
    seen = []

    def resampled(df):
        seen.append(df.count())
        return df.union(df.where("label = 1"))

    est = lambda c: models.gbt("A", {"max_depth": 1, "learning_rate": 0.1, **c})
    model, params, trials = search.holdout_search(train, valid, est, {"n_estimators": ("quniform", 40, 40, 1)}, max_evals=1, resample=resampled)
    row = trials.head()
    losses = est({"n_estimators": 40}).fit(resampled(train)).evaluateEachIteration(valid)
    assert seen[0] == 500 and model.getNumTrees == 40
    assert row.n_trees == search.best_prefix(losses) > 10 and row.f1 > 0.6
    short = search.first_trees(model, 3)
    assert short.getNumTrees == 3 and np.isclose(short.evaluateEachIteration(valid)[2], model.evaluateEachIteration(valid)[2])
    assert search.best_prefix([5, 4, 3] + [3.5] * 10 + [1]) == 3 and search.best_prefix([5, 4, 3] + [3.5] * 9 + [1]) == 13
    assert inspect.signature(q_models._holdout).parameters["max_evals"].default == 20


def test_staged_fit_equals_the_whole_fit(spark):
    """Stages stop early, and keep the rounds that fitting everything at once would keep."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from tabula.operators import models, search

    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] + x[:, 1] > 0) ^ (rng.random(600) < 0.2)).astype(int)
    rows = [(Vectors.dense(a), int(b)) for a, b in zip(x, y)]
    train, valid = (spark.createDataFrame(part, ["features", "label"]).coalesce(2) for part in (rows[:400], rows[400:]))
    est = models.gbt("A", {"n_estimators": 60, "max_depth": 3, "subsample": 0.7, "colsample_bytree": 0.7})
    model, n = search.staged_fit(est, train, valid, patience=4, stage=8)
    whole = est.fit(train).evaluateEachIteration(valid)
    assert n == search.best_prefix(whole, 4) and model.getNumTrees < 60
