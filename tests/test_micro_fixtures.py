"""Literal micro-fixtures with hand-computed answers (null / NaN, ties, Yates, constants, unseen)."""

import math

import pytest
from pyspark.sql import functions as F

from tabula.operators import association, columns, ensemble, metrics, prep, profile, split


def approx(x, rel=1e-5):
    return pytest.approx(x, rel=rel, abs=1e-9)


def test_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 9, 4, 11)], "x double")
    r = profile.skew_kurtosis(df, ["x"], digits=6).first()
    assert r["skewness"] == approx(0.467046)
    assert r["kurtosis"] == approx(-2.416978)


def test_pairwise_null_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (9.0, 4.0), (4.0, 7.0), (11.0, 1.0)], "a double, b double")
    rows = {(r.feature_a, r.feature_b): r.corr for r in association.corr_matrix(df, ["a", "b"]).collect()}
    assert rows[("a", "b")] == approx(-0.289250)
    assert rows[("b", "a")] == approx(-0.289250)
    assert rows[("a", "a")] == approx(1.0)


def test_percentiles_linear(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 9, 4, 11)], "x double")
    r = profile.percentiles(df, ["x"], (0.01, 0.05, 0.25)).first()
    assert (r["p1"], r["p5"], r["p25"]) == (approx(1.04), approx(1.2), approx(2.0))


def test_median_with_null(spark):
    df = spark.createDataFrame([(2.0,), (None,), (4.0,), (7.0,), (1.0,)], "x double")
    assert prep.fit_medians(df, ["x"])["x"] == approx(3.0)


def test_mode_tie_lowest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c string")
    assert prep.fit_modes(df, ["c"], sentinel=None)["c"] == "a"


def test_missing_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,)], "x double")
    r = profile.missing_summary(df).first()
    assert r["missing_count"] == 2 and r["missing_pct"] == approx(66.67)


def test_one_hot_unseen_and_null(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row_id int, c string")
    test = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "row_id int, c string")
    model = prep.one_hot_pipeline(["c"]).fit(train)
    from pyspark.ml.functions import vector_to_array
    got = {r.row_id: list(r.v) for r in model.transform(test).select("row_id", vector_to_array("c__ohe").alias("v")).collect()}
    assert got == {1: [1.0, 0.0, 0.0], 2: [0.0, 0.0, 0.0], 3: [0.0, 0.0, 0.0]}
    assert prep.one_hot_labels(model)["c"] == ["a", "b", "c"]


def test_constant_scale(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    out = prep.apply_scaler(df, prep.fit_scaler(df, ["x"])).collect()
    assert [r.x for r in out] == [0.0, 0.0, 0.0]


def test_binarize(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (None,)], "x int")
    assert [r.x for r in columns.binarize_columns(df, ["x"]).collect()] == [0, 1, 1, 0]


def test_cooccurrence(spark):
    df = spark.createDataFrame([("unknown", "unknown"), ("unknown", "k"), ("k", "unknown"), ("unknown", "unknown")],
                               "a string, b string")
    got = {(r.feature_a, r.feature_b): (r["count"], r.pct) for r in profile.sentinel_cooccurrence(df, ["a", "b"]).collect()}
    assert got[("a", "a")] == (3, approx(75.0)) and got[("a", "b")] == (2, approx(50.0))
    assert got[("b", "a")] == (2, approx(50.0)) and got[("b", "b")] == (3, approx(75.0))


def test_yates_2x2(spark):
    cells = spark.createDataFrame([("p", "x", "u", 10), ("p", "x", "v", 20), ("p", "y", "u", 30), ("p", "y", "v", 40)],
                                  "k string, a string, b string, count long")
    r = association.cramers_from_cells(cells, ["k"]).first()
    assert r["chi2"] == approx(0.446429) and r["cramers_v"] == approx(0.066815)


def test_constant_category_is_null(spark):
    df = spark.createDataFrame([("a", "0"), ("a", "1"), ("a", "1")], "x string, y string")
    assert association.cramers_v(df, "x", "y").first()["cramers_v"] is None


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)], "label int, score double")
    assert metrics.roc_auc(df).first()["roc_auc"] == approx(0.875)
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    assert metrics.roc_auc(one).first()["roc_auc"] is None


def test_weighted_report(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 0], [0, 1, 1, 1, 0])), "label int, prediction int")
    r = metrics.weighted_prf(df).first()
    assert (r.precision, r.recall, r.f1) == (approx(0.866667), approx(0.8), approx(0.8))


def test_vif_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 5.0, 5.01, 10.0, 11.0, float("inf"))], "v double")
    got = [r.bin_label for r in columns.bin_labels(df, "v").collect()]
    assert got == [None, "Acceptable", "High", "High", "Severe", "Severe"]


def test_vote_tie_goes_low(spark):
    df = spark.createDataFrame([(1, "m1", 0), (1, "m2", 1), (1, "m3", 1), (1, "m4", 0)], "row_id int, model string, prediction int")
    assert ensemble.vote_hard(df).first()["prediction"] == 0


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "y int")
    got = {r["class"]: r.weight for r in split.class_weights(df, "y").collect()}
    assert got == {0: approx(0.625), 1: approx(2.5)}


def test_split_counts_largest_remainder(spark):
    df = spark.createDataFrame([(i, 0 if i < 90 else 1) for i in range(100)], "id int, y int")
    s = split.stratified_split(df, "y", "id", 0.2, 42)
    c = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert c[(0, "test")] == 18 and c[(1, "test")] == 2
    t = split.three_way_split(df, "y", "id", 0.2, 0.2, 42)
    c3 = {(r.y, r.split): r["count"] for r in t.groupBy("y", "split").count().collect()}
    assert (c3[(0, "train")], c3[(1, "train")]) == (58, 6)
    assert (c3[(0, "validation")], c3[(1, "validation")]) == (14, 2)
    assert (c3[(0, "test")], c3[(1, "test")]) == (18, 2)


def test_smote_counts(spark):
    from tabula.operators import resample
    rows = [(i, [float(i), float(i % 3)], 0) for i in range(6)] + [(10 + i, [10.0 + i, 1.0 * i], 1) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    out = resample.smote(df, "y", "id", "v", k=5, seed=42)
    c = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert c == {0: 6, 1: 6}
    syn = resample.smote_samples(df, "y", "id", "v", k=5, seed=42).collect()
    assert len(syn) == 3 and all(0 <= r.gap < 1 for r in syn)
    assert math.isfinite(sum(x for r in syn for x in r.v))


def test_filter_sentinel_keeps_missing(spark):
    df = spark.createDataFrame([(999,), (5,), (None,)], "pdays int")
    assert sorted([r.pdays for r in columns.filter_sentinel(df, "pdays", 999).collect()], key=lambda v: (v is None, v)) == [5, None]


def test_drop_ignores_missing_and_dots(spark):
    df = spark.createDataFrame([(1, 2.0)], "`emp.var.rate` int, b double")
    assert columns.drop_columns(df, ["emp.var.rate", "nope"]).columns == ["b"]
    assert columns.rename_dots(spark.createDataFrame([(1,)], "`a.b` int")).columns == ["a_b"]


def test_delimiter_detection(spark, tmp_path):
    from tabula.sources import files
    p = tmp_path / "x.csv"
    p.write_text("a;b.c;d\n1;2;x\n3;4;y\n")
    df = files.load_data(spark, str(p), "csv")
    assert df.columns == ["a", "b_c", "d"] and df.count() == 2
    assert files.detect_delimiter(spark, str(p)) == ";"
    _ = F  # keep import used


def test_vif_of_a_linear_dependence_is_infinite(spark):
    rows = [(float(i), float(i * i % 7), float(i) + float(i * i % 7), float((i * 31) % 11)) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {r.feature: (r.vif, r.severity) for r in association.vif(df, ["a", "b", "c", "d"]).collect()}
    assert all(got[f] == (math.inf, "Severe") for f in "abc") and 0 < got["d"][0] < 100


def test_crosstab_has_its_empty_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "x"), ("c", None)], "p string, q string")
    got = {(r.x_value, r.y_value): r["count"] for r in association.crosstab(df, "p", "q").collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 1}


def test_null_classes_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 0), ("b", 5.0, 1), (None, 9.0, 1)], "g string, v double, y int")
    assert sorted((r["class"], round(r.proportion, 6)) for r in profile.class_distribution(df, "g").collect()) == [("a", 0.666667), ("b", 0.333333)]
    assert {(r.value, r.target_rate, r.n) for r in profile.target_rate_by_value(df, "g", "y").collect()} == {("a", 0.5, 2), ("b", 1.0, 1)}
    assert {r.group: (r.median, r.n) for r in profile.box_stats(df, "v", "g", chunk=1).collect()} == {"a": (2.0, 2), "b": (5.0, 1)}


def test_encode_integers_in_their_own_order(spark):
    df = spark.createDataFrame([(10,), (2,), (9,), (2,), (None,)], "t int")
    got = columns.encode_target(df, "t", "code")
    assert {(r.t, r.code) for r in got.collect()} == {(2, 0), (9, 1), (10, 2), (None, None)} and got.schema["t"].dataType.typeName() == "integer"


def test_delimiter_and_json_array(spark, tmp_path):
    from tabula.sources import files
    (tmp_path / "a.csv").write_text("x;y;z\n1,5;2;3\n2,5;3;4\n")  # one constant comma a line below the header
    (tmp_path / "b.csv").write_text("p,q;y;z\n1,5;2;3\n2,5;3;4\n")
    assert files.detect_delimiter(spark, str(tmp_path / "a.csv")) == files.detect_delimiter(spark, str(tmp_path / "b.csv")) == ";"
    (tmp_path / "a.json").write_text('\n [{"a": 1},\n {"a": 2}]\n')
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": 2}\n')
    for name in ("a.json", "b.json"):
        df = files.load_json(spark, str(tmp_path / name))
        assert df.columns == ["a"] and sorted(r.a for r in df.collect()) == [1, 2]


def test_rank_by_abs_breaks_ties(spark):
    from tabula.operators import report
    df = spark.createDataFrame([("b", -2.0), ("a", 2.0), ("c", 3.0), ("d", None)], "f string, v double")
    assert {r.f: r["rank"] for r in report.rank_by_abs(df, "v", "f").collect()} == {"c": 1, "a": 2, "b": 3, "d": 4}


def test_logistic_penalty_follows_the_rows(spark):
    """At the optimum w + C * sum(weight * dloss) = 0 for weighted rows whose weights do not add up to their number."""
    import numpy as np
    from pyspark.ml.linalg import Vectors
    from tabula.operators import models
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(200, 3)), rng.uniform(0.5, 4, 200)
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    df = spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)], ["features", "label", "weight"])
    m = models.BalancedLogistic(C=0.7).fit(df)
    beta = m.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ beta + m.intercept)))
    assert np.abs(beta + 0.7 * x.T @ (w * (p - y))).max() < 0.05
