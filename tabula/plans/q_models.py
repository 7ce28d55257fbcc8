"""Registered learning queries: preparation pipeline, learners, search, scoring and explanation.

Learners are fitted on the planted-label ``lineitem`` (whole table, exact 64/16/20 split). Queries
whose result depends on a fitted model are rows-only checks; permutation importance, linear SHAP and
its summaries use a fixed rule / fixed coefficients so that DuckDB can reproduce them exactly.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabula.operators import boosting, explain, metrics, models, report, resample, search
from tabula.plans import q_prepare  # noqa: F401  (registered first: its oracles are reused below)
from tabula.plans.fixtures import PLANTED_SQL, planted
from tabula.plans.learning import CATEGORICAL, NOISE, NUMERIC, prepare
from tabula.plans.registry import ORACLE, register, rounded
from tabula.session import discard, materialize, scratch_dir
from tabula.sources import files

SHORT = {"n_estimators": 20}  # boosted fits of voting_models, cv_compare and tree_importance (full profiles in models.GBT_PROFILES)


def _eval(scored, name, method="fit"):
    s = scored.withColumn("model", F.lit(name)).withColumn("method", F.lit(method))
    return metrics.evaluate_models(s)


# ---------------------------------------------------------------- F7 / F8 / E1

def _assemble_sql() -> str:
    from tabula.plans.q_prepare import _RANK, _alloc_sql
    return f"""
WITH p AS {PLANTED_SQL}, cnt AS (SELECT y, count(*) AS n_c FROM p GROUP BY y),
a1 AS {_alloc_sql('cnt', 'n_c', 0.2, 'test_c')},
rest AS (SELECT y, n_c - test_c AS m_c, test_c FROM cnt JOIN a1 USING (y)),
a2 AS {_alloc_sql('rest', 'm_c', 0.2, 'val_c')},
r AS (SELECT row_id, y, l_returnflag, l_linestatus, {_RANK} AS rk, test_c, val_c FROM p JOIN rest USING (y) JOIN a2 USING (y)),
s AS (SELECT *, CASE WHEN rk <= test_c THEN 'test' WHEN rk <= test_c + val_c THEN 'validation' ELSE 'train' END AS split FROM r),
tc AS (SELECT y, count(*) AS n_t FROM s WHERE split = 'train' GROUP BY y),
tt AS (SELECT sum(n_t) AS n_all, count(*) AS k FROM tc),
nf AS (SELECT CAST(4 + count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) AS INTEGER) AS n_features
       FROM s WHERE split = 'train')
SELECT row_id, y AS label, split,
  CASE WHEN split = 'train' THEN CAST(floor((rk - test_c - val_c - 1) * 3 / n_t) AS INTEGER) ELSE -1 END AS fold,
  round(CASE WHEN split = 'train' THEN n_all / (k * n_t) ELSE 1.0 END, 6) AS weight, n_features
FROM s JOIN tc USING (y), tt, nf"""


@register("assemble_features", _assemble_sql())
def q_assemble_features(spark, sf):
    """the assembled training table (split, folds, balanced weights, feature-vector width)."""
    p = prepare(spark, sf)
    return rounded(p.data.select("row_id", "label", "split", "fold", "weight",
                                 F.size(vector_to_array("features")).alias("n_features")))


@register("pipeline_fit_score")
def q_pipeline_fit_score(spark, sf):
    """prep (fitted on train) -> SMOTE on train only -> logistic regression -> validation metrics."""
    p = prepare(spark, sf)
    train = materialize(resample.smote_features(p.part("train")), "resampled")  # the fit reads it several times
    model = models.BalancedLogistic(C=1.0).fit(train)
    return _eval(models.score(model, p.part("validation")), "LogisticRegression", "smote")


@register("batch_score")
def q_batch_score(spark, sf):
    p = prepare(spark, sf)
    model = models.logistic_regression(weight_sum=p.weight_sum).fit(p.fit_rows())
    return models.score(model, p.part("validation"))


@register("feature_names", f"""
WITH p AS {PLANTED_SQL}, n AS (SELECT unnest({list(NUMERIC)!r}) AS name, generate_subscripts({list(NUMERIC)!r}, 1) AS i),
c AS ({" UNION ALL ".join(f"SELECT '{c}_' || {c} AS name, {k} AS g FROM (SELECT DISTINCT {c} FROM p)" for k, c in enumerate(CATEGORICAL))})
SELECT name AS feature, CAST(i - 1 AS INTEGER) AS ordinal FROM n UNION ALL
SELECT name, CAST({len(NUMERIC)} + row_number() OVER (ORDER BY g, name) - 1 AS INTEGER) FROM c""")
def q_feature_names(spark, sf):
    """the names of the assembled vector, in order."""
    names = prepare(spark, sf).prep.names
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, ordinal int")


# ---------------------------------------------------------------- M1-M6, M8

def _exact_rule_sql(model: str) -> str:
    """The planted label is a two-split rule that a tree learner recovers exactly, so a fitted model's metrics are
    those of the rule itself."""
    hit = "CASE WHEN CAST(l_quantity >= 40 AND l_discount >= 0.05 AS INTEGER) = y THEN 1.0 ELSE 0.0 END"
    return (f"SELECT '{model}' AS model, 'fit' AS method, {', '.join(f'CAST(avg({hit}) AS DOUBLE) AS {m}' for m in ('precision', 'recall', 'f1', 'roc_auc'))} "
            f"FROM {PLANTED_SQL} p")


@register("fit_decision_tree", _exact_rule_sql("DecisionTree"))
def q_fit_decision_tree(spark, sf):
    p = prepare(spark, sf)
    m = models.decision_tree().fit(p.fit_rows())
    return _eval(models.score(m, p.part("validation")), "DecisionTree")


@register("fit_logistic")
def q_fit_logistic(spark, sf):
    p = prepare(spark, sf)
    m = models.logistic_regression(C=1.0, weight_sum=p.weight_sum).fit(p.fit_rows())
    return _eval(models.score(m, p.part("validation")), "LogisticRegression")


def _fit_gbt(spark, sf, profile):
    p = prepare(spark, sf)
    m = models.gbt(profile).fit(p.part("train"))
    return _eval(models.score(m, p.part("validation")), f"GBT-{profile}")


@register("fit_gbt_a", _exact_rule_sql("GBT-A"))
def q_fit_gbt_a(spark, sf):
    return _fit_gbt(spark, sf, "A")


@register("fit_gbt_b", _exact_rule_sql("GBT-B"))
def q_fit_gbt_b(spark, sf):
    return _fit_gbt(spark, sf, "B")


@register("fit_gbt_c", _exact_rule_sql("GBT-C"))
def q_fit_gbt_c(spark, sf):
    return _fit_gbt(spark, sf, "C")


@register("fit_knn")
def q_fit_knn(spark, sf):
    p = prepare(spark, sf)
    s = models.knn_scores(p.part("train"), p.part("validation"), k=3)
    s = s.join(p.part("validation").select("row_id", "label"), "row_id")
    return _eval(s, "KNN")


@register("stacking")
def q_stacking(spark, sf):
    p = prepare(spark, sf, folds=5)
    base = {"decision_tree": models.decision_tree(), "knn": "knn",
            "gbt_a": models.gbt("A"), "gbt_b": models.gbt("B"), "gbt_c": models.gbt("C")}
    out = models.stacking(p.part("train"), p.part("validation"), base, fold_col="fold")
    return _eval(out, "Stacking")


@register("voting_models")
def q_voting_models(spark, sf):
    """Soft and hard voting over the six estimators: DT, kNN, LR and the three boosters (long-form vote)."""
    p = prepare(spark, sf)
    tr, va = p.part("train"), p.part("validation")
    rows, shared = materialize(p.fit_rows(), "fit"), boosting.Shared(tr)
    fitted = {"dt": models.decision_tree().fit(rows), "lr": models.BalancedLogistic().fit(rows)}
    discard(rows)
    fitted.update({f"gbt_{k.lower()}": shared.fit(models.gbt(k, SHORT)) for k in ("A", "B", "C")})
    long = (models.knn_scores(tr, va, k=3).join(va.select("row_id", "label"), "row_id")
            .select("row_id", "label", "prediction", "score", F.lit("knn").alias("model")))
    for name, m in fitted.items():
        s = models.score(m, va).withColumn("model", F.lit(name))
        long = long.unionByName(s)
    long = materialize(long, "votes")  # both votes read it
    soft = models.voting(long, "soft").join(va.select("row_id", "label"), "row_id")
    hard = models.voting(long, "hard").join(va.select("row_id", "label"), "row_id")
    soft_e = metrics.weighted_prf(soft.withColumn("model", F.lit("voting_soft")), ["model"])
    hard_e = metrics.weighted_prf(hard.withColumn("model", F.lit("voting_hard")), ["model"])
    return soft_e.unionByName(hard_e)


# ---------------------------------------------------------------- T2-T8

@register("random_search")
def q_random_search(spark, sf):
    """Randomized search over the logistic-regression space (whole grid: 5 configs), 3 stratified folds,
    SMOTE inside each fold, weighted F1, refit of the best on all training rows."""
    p = prepare(spark, sf, folds=3)
    tr = p.part("train")
    best, params, summary = search.random_search(
        tr, lambda c: models.BalancedLogistic(C=float(c["C"])),
        search.SEARCH_SPACES["LogisticRegression"], n_iter=20, resample=resample.smote_features, model_name="LogisticRegression")
    return summary


def _holdout(spark, sf, profile, max_evals=20):
    """On the label with flipped rows: without them the loss of a tree learner never stops falling."""
    p = prepare(spark, sf, noise=NOISE)
    best, params, trials = search.holdout_search(p.part("train"), p.part("validation"), lambda c: models.gbt(profile, c),
                                                 search.HOLDOUT_SPACES[profile], max_evals=max_evals,
                                                 model_name=f"GBT-{profile}", resample=resample.smote_features)
    return trials


@register("holdout_search_a")
def q_holdout_search_a(spark, sf):
    return _holdout(spark, sf, "A")


@register("holdout_search_b")
def q_holdout_search_b(spark, sf):
    return _holdout(spark, sf, "B")


@register("holdout_search_c")
def q_holdout_search_c(spark, sf):
    return _holdout(spark, sf, "C")


@register("cv_compare")
def q_cv_compare(spark, sf):
    p = prepare(spark, sf, folds=5)
    ests = {f"GBT-{k}": (lambda k=k: models.gbt(k, SHORT)) for k in ("A", "B", "C")}
    return search.cv_summary(search.cv_compare(p.part("train"), ests))


# ---------------------------------------------------------------- X1-X5

@register("tree_importance")
def q_tree_importance(spark, sf):
    p = prepare(spark, sf)
    m = models.gbt("A", SHORT).fit(p.fit_rows())
    return explain.tree_importance(m, p.prep.names)


@register("shap_tree")
def q_shap_tree(spark, sf):
    """TreeSHAP of the whole booster profile A, every training row; on the label with flipped rows, whose trees are deep."""
    p = prepare(spark, sf, noise=NOISE)
    train = p.fit_rows()
    m = models.gbt("A").fit(p.part("train"))
    shap, base = explain.shap_tree(train, m, p.prep.names)
    return shap.withColumn("base_value", F.lit(base))


def _rule_tree(spark, sf):
    """A fitted tree of depth 2 on the planted label, its SHAP table over the training rows, and its base value."""
    p = prepare(spark, sf)
    m = models.decision_tree(max_depth=2, weight_col=None).fit(p.fit_rows())
    return explain.shap_tree(p.part("train"), m, p.prep.names, label_is_class=True, scale=1.0)


# The tree splits on quantity, then (where that passes) on discount. With q, d the two conditions, w the share of rows
# with q and r the positive share among them, the value of knowing nothing, q, d, both: w*r, q*r, d*w, q*d.
_TREE_SHAP_SQL = f"""(WITH tr AS (SELECT row_id FROM ({_assemble_sql()}) a WHERE split = 'train'),
  t AS (SELECT row_id, CAST(l_quantity >= 40 AS INTEGER) AS q, CAST(l_discount >= 0.05 AS INTEGER) AS d FROM {PLANTED_SQL} p JOIN tr USING (row_id)),
  c AS (SELECT avg(q) AS w, sum(q * d) * 1.0 / sum(q) AS r FROM t),
  v AS (SELECT row_id, w * r AS v0, q * r AS vq, d * w AS vd, q * d AS vqd FROM t, c),
  names AS ({ORACLE["feature_names"]})
SELECT row_id, feature, v0 AS base_value, CASE feature
  WHEN 'l_quantity' THEN ((vq - v0) + (vqd - vd)) / 2 WHEN 'l_discount' THEN ((vd - v0) + (vqd - vq)) / 2 ELSE 0.0 END AS shap
FROM v, names)"""


@register("shap_tree_rule", f"SELECT row_id, feature, round(shap, 6) AS shap, round(base_value, 6) AS base_value FROM {_TREE_SHAP_SQL} s")
def q_shap_tree_rule(spark, sf):
    """X3 on a fitted tree whose SHAP values have a closed form."""
    shap, base = _rule_tree(spark, sf)
    return rounded(shap.select("row_id", "feature", "shap", F.lit(base).alias("base_value")))


@register("shap_tree_mean_abs", f"""
SELECT feature, round(avg(abs(shap)), 6) AS mean_abs_shap,
  CAST(row_number() OVER (ORDER BY round(avg(abs(shap)), 9) DESC, feature) AS INTEGER) AS rank FROM {_TREE_SHAP_SQL} s GROUP BY feature""")
def q_shap_tree_mean_abs(spark, sf):
    """X4 on a fitted tree: the bar chart's numbers."""
    return rounded(explain.shap_mean_abs(_rule_tree(spark, sf)[0]))


@register("explain_row_tree", f"""
WITH s AS {_TREE_SHAP_SQL}, one AS (SELECT *, row_number() OVER (ORDER BY abs(shap) DESC, feature) AS rank FROM s
  WHERE row_id = (SELECT min(row_id) FROM s))
SELECT row_id, feature, round(shap, 6) AS shap, CAST(rank AS INTEGER) AS rank FROM one WHERE rank <= 2
UNION ALL SELECT row_id, 'other features', round(sum(shap), 6), 3 FROM one WHERE rank > 2 GROUP BY row_id
UNION ALL SELECT row_id, 'base value', round(max(base_value), 6), 0 FROM one GROUP BY row_id""")
def q_explain_row_tree(spark, sf):
    """X5 on a fitted tree: the training row of the least id."""
    shap, base = _rule_tree(spark, sf)
    rid = shap.agg(F.min("row_id")).first()[0]
    return rounded(explain.explain_row(shap, rid, base, top=2).select("row_id", "feature", "shap", "rank"))


RULE_FEATURES = ["l_quantity", "l_discount", "l_extendedprice"]


def _rule(c):
    return ((c["l_quantity"] >= 40) & (c["l_discount"] >= 0.05)).cast("int")


def _perm_sql() -> str:
    feats = RULE_FEATURES
    shuf_cols = ", ".join(f"{f} AS s_{f}" for f in feats)
    acc = []
    for f in feats:
        q = "s_l_quantity" if f == "l_quantity" else "l_quantity"
        d = "s_l_discount" if f == "l_discount" else "l_discount"
        acc.append(f"SELECT '{f}' AS feature, rep, avg(CASE WHEN CAST({q} >= 40 AND {d} >= 0.05 AS INTEGER) = y "
                   f"THEN 1.0 ELSE 0.0 END) AS acc FROM j GROUP BY rep")
    return f"""
WITH p AS {PLANTED_SQL},
pos AS (SELECT row_id, y, {", ".join(feats)}, row_number() OVER (ORDER BY md5(row_id || ':42:base')) AS i FROM p),
reps AS (SELECT CAST(range AS INTEGER) AS rep FROM range(10)),
shuf AS (SELECT rep, {shuf_cols}, row_number() OVER (PARTITION BY rep ORDER BY md5(row_id || ':42:' || rep)) AS i
         FROM p, reps),
j AS (SELECT * FROM pos JOIN shuf USING (i)),
base AS (SELECT avg(CASE WHEN CAST(l_quantity >= 40 AND l_discount >= 0.05 AS INTEGER) = y THEN 1.0 ELSE 0.0 END) AS b FROM p),
per AS ({" UNION ALL ".join(acc)}),
imp AS (SELECT feature, avg(b - acc) AS importance, stddev_pop(b - acc) AS importance_std FROM per, base GROUP BY feature)
SELECT feature, round(importance, 6) AS importance, round(importance_std, 6) AS importance_std,
  CAST(row_number() OVER (ORDER BY importance DESC, CASE feature {" ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(feats))} END) AS INTEGER) AS rank
FROM imp"""


@register("permutation_importance", _perm_sql())
def q_permutation_importance(spark, sf):
    df = planted(spark, sf).select("row_id", F.col("y").alias("label"), *RULE_FEATURES)
    return rounded(explain.permutation_importance(df, _rule, RULE_FEATURES, n_repeats=10, seed=42))


def _perm_model_sql() -> str:
    feats = [*NUMERIC, *CATEGORICAL]
    acc = []
    for o, f in enumerate(feats):
        q = "s.l_quantity" if f == "l_quantity" else "t.l_quantity"
        d = "s.l_discount" if f == "l_discount" else "t.l_discount"
        acc.append(f"""SELECT '{f}' AS feature, {o} AS o, rep, avg(CASE WHEN CAST({q} >= 40 AND {d} >= 0.05 AS INTEGER) = t.y
  THEN 1.0 ELSE 0.0 END) AS acc FROM pos t JOIN par ON true JOIN pos s ON s.i = (t.i * a + b) % n GROUP BY rep""")
    return f"""
WITH pos AS (SELECT l_quantity, l_discount, y, row_number() OVER (ORDER BY md5(row_id || ':42:base')) - 1 AS i FROM {PLANTED_SQL} p),
cnt AS (SELECT count(*) AS n FROM pos), reps AS (SELECT range AS rep FROM range(10)),
par AS (SELECT rep, n, min(2 + CAST('0x' || substr(md5('42:' || rep || ':a'), 1, 5) AS BIGINT) + g.range) AS a,
  min(CAST('0x' || substr(md5('42:' || rep || ':b'), 1, 12) AS BIGINT) % n) AS b
  FROM reps, cnt, range(1000) g WHERE gcd(2 + CAST('0x' || substr(md5('42:' || rep || ':a'), 1, 5) AS BIGINT) + g.range, n) = 1 GROUP BY rep, n),
per AS ({" UNION ALL ".join(acc)})
SELECT feature, round(avg(1.0 - acc), 6) AS importance, round(stddev_pop(1.0 - acc), 6) AS importance_std,
  CAST(row_number() OVER (ORDER BY avg(1.0 - acc) DESC, o) AS INTEGER) AS rank FROM per GROUP BY feature, o"""


@register("permutation_importance_model", _perm_model_sql())
def q_permutation_importance_model(spark, sf):
    """X2 on a fitted tree, over all rows: it has learnt the planted rule, so its baseline accuracy is 1."""
    p = prepare(spark, sf)
    m = models.decision_tree().fit(p.fit_rows())
    names = p.prep.names
    groups = {f: [i for i, n in enumerate(names) if n == f or (f in CATEGORICAL and n.startswith(f + "_"))] for f in (*NUMERIC, *CATEGORICAL)}
    return rounded(explain.permutation_importance_model(p.data, m, groups, n_repeats=10, seed=42))


# fixed coefficients of a linear margin (a model stated as a rule, so the oracle can reproduce it)
LIN_COEFS = {"l_quantity": 0.0812345678, "l_discount": 24.6913578, "l_tax": -3.90123457}
LIN_INTERCEPT = -5.0


def _shap_lin_sql() -> str:
    parts = [f"SELECT row_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {c} * ({f} - avg({f}) OVER ()) AS shap FROM p"
             for f, c in LIN_COEFS.items()]
    return f"(WITH p AS {PLANTED_SQL} {' UNION ALL '.join(parts)})"


def _shap_lin(spark, sf):
    p = planted(spark, sf)
    return explain.shap_linear(p, LIN_COEFS)


@register("shap_linear", f"SELECT row_id, feature, round(value, 6) AS value, round(shap, 6) AS shap FROM {_shap_lin_sql()} s")
def q_shap_linear(spark, sf):
    return rounded(_shap_lin(spark, sf))


@register("shap_mean_abs", f"""
SELECT feature, round(avg(abs(shap)), 6) AS mean_abs_shap,
  CAST(row_number() OVER (ORDER BY avg(abs(shap)) DESC, feature) AS INTEGER) AS rank
FROM {_shap_lin_sql()} s GROUP BY feature""")
def q_shap_mean_abs(spark, sf):
    return rounded(explain.shap_mean_abs(_shap_lin(spark, sf)))


_EXPLAIN_ROW_SQL = f"""
WITH s AS {_shap_lin_sql()},
r AS (SELECT min(row_id) AS rid FROM {PLANTED_SQL} p),
one AS (SELECT s.*, row_number() OVER (ORDER BY abs(shap) DESC, feature) AS rank FROM s, r WHERE s.row_id = r.rid),
base AS (SELECT {LIN_INTERCEPT} + {" + ".join(f"{c} * avg({f})" for f, c in LIN_COEFS.items())} AS b FROM {PLANTED_SQL} p)
SELECT row_id, feature, round(value, 6) AS value, round(shap, 6) AS shap, CAST(rank AS INTEGER) AS rank FROM one WHERE rank <= 2
UNION ALL SELECT row_id, 'other features', NULL, round(sum(shap), 6), 3 FROM one WHERE rank > 2 GROUP BY row_id
UNION ALL SELECT (SELECT rid FROM r), 'base value', NULL, round(b, 6), 0 FROM base"""


@register("explain_row", _EXPLAIN_ROW_SQL)
def q_explain_row(spark, sf):
    p = planted(spark, sf)
    rid = p.agg(F.min("row_id")).first()[0]
    base = explain.linear_base_value(LIN_COEFS, LIN_INTERCEPT, p)
    return rounded(explain.explain_row(_shap_lin(spark, sf), rid, base, top=2))


# ---------------------------------------------------------------- S4

def _write_report_sql() -> str:
    parts = [f"SELECT '{t}' AS \"table\", count(*) AS rows FROM ({ORACLE[q]}) x"
             for t, q in (("summary", "summary_table"), ("roc_curves", "roc_curves_all"),
                          ("reports", "reports_all"), ("test_report", "test_report"))]
    return "\nUNION ALL\n".join(parts)


@register("write_report", _write_report_sql())
def q_write_report(spark, sf):
    """The report sink: the four report tables written as Parquet to the shared scratch folder, read back."""
    from tabula.plans.fixtures import scored_fixture

    sc = scored_fixture(spark, sf)
    val, test = sc.where(F.col("split") == "validation"), sc.where(F.col("split") == "test")
    ev = metrics.evaluate_models(val)
    winner = report.best_model(ev)
    tables = {"summary": report.summary_table(ev, metrics.evaluate_models(test)),
              "roc_curves": report.roc_curves_all(val), "reports": report.reports_all(val),
              "test_report": report.test_report(test, winner)}
    base = scratch_dir(spark, "report")
    paths = files.write_report(tables, base)
    counts = [spark.read.parquet(pth).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
              for name, pth in paths.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
