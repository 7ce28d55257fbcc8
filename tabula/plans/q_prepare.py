"""Registered queries: sources, projections, splits, preparation, metrics and reports, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabula.functions import expr
from tabula.functions.expr import qcol
from tabula.operators import columns as cols_ops
from tabula.operators import ensemble, metrics, prep, report, split
from tabula.operators import profile as prof
from tabula.plans.fixtures import (
    NULLS_SQL,
    ORDERS_SENTINEL_SQL,
    PLANTED_SQL,
    SCORED_SQL,
    lineitem_nulls,
    orders_sentinel,
    planted,
    scored_fixture,
    table,
)
from tabula.plans.registry import register, rounded
from tabula.session import scratch_dir
from tabula.sources import files

# ---------------------------------------------------------------- S1-S3

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _scan_profile(df):
    """(column_name, dtype, n_non_null, n_distinct) of a re-read table: one aggregate."""
    aggs = []
    for i, c in enumerate(df.columns):
        aggs += [F.count(qcol(c)).alias(f"n{i}"), F.countDistinct(qcol(c)).alias(f"d{i}")]
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                        F.col(f"n{i}").alias("n_non_null"), F.col(f"d{i}").alias("n_distinct"))
               for i, c in enumerate(df.columns)]
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def _scan_sql(types: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS n_non_null, count(DISTINCT {c}) AS n_distinct FROM orders"
        for c, t in types.items())


@register("scan_csv_profile", _scan_sql({"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string",
                                         "o_totalprice": "double", "o_orderdate": "timestamp",
                                         "o_orderpriority": "string"}))
def q_scan_csv_profile(spark, sf):
    """Write orders as ';'-separated CSV to the shared scratch folder, scan it back with delimiter detection."""
    path = scratch_dir(spark, "orders_csv")
    table(spark, sf, "orders").select(*ORDER_COLS).write.option("header", True).option("sep", ";").csv(path)
    return _scan_profile(files.load_data(spark, path, "csv"))


@register("scan_json_profile", _scan_sql({"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderdate": "string",
                                          "o_orderpriority": "string", "o_orderstatus": "string",
                                          "o_totalprice": "double"}))
def q_scan_json_profile(spark, sf):
    """Write orders as JSON lines, scan them back (inferred schema)."""
    path = scratch_dir(spark, "orders_json")
    table(spark, sf, "orders").select(*ORDER_COLS).write.json(path)
    return _scan_profile(files.load_data(spark, path, "json"))


@register("preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 5""")
def q_preview(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return rounded(files.preview(o, "o_orderkey", 5))


# ---------------------------------------------------------------- P1-P12

@register("drop_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
  l_returnflag, l_linestatus FROM lineitem""")
def q_drop_columns(spark, sf):
    return cols_ops.drop_columns(table(spark, sf, "lineitem"), ["l_tax", "l_shipdate", "no_such_column"])


@register("extract_target", f"SELECT row_id, l_quantity, l_discount, y AS label FROM {PLANTED_SQL} p")
def q_extract_target(spark, sf):
    return cols_ops.extract_target(planted(spark, sf).select("row_id", "l_quantity", "l_discount", "y"), "y")


@register("filter_sentinel", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem
WHERE l_discount <> 0.0 OR l_discount IS NULL""")
def q_filter_sentinel(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return cols_ops.filter_sentinel(li, "l_discount", 0.0)


@register("binarize", """
SELECT l_orderkey, l_linenumber, coalesce(CAST(nullif(l_linenumber - 1, 3) >= 1 AS INTEGER), 0) AS x
FROM lineitem""")
def q_binarize(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_linenumber") - 1, F.lit(3)).alias("x"))
    return cols_ops.binarize_columns(li, ["x"], 1)


@register("encode_target", """
SELECT o_orderkey, o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS label
FROM orders""")
def q_encode_target(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return cols_ops.encode_target(o, "o_orderstatus", "label")


@register("map_target", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label_map,
  CAST(o_orderstatus = 'F' AS INTEGER) AS label_flag FROM orders""")
def q_map_target(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    o = cols_ops.map_target(o, "o_orderstatus", {"F": 1, "O": 0})
    return cols_ops.equals_flag(o, "o_orderstatus", "F").drop("o_orderstatus")


@register("sentinel_to_null", f"""
SELECT o_orderkey, nullif(o_orderpriority, 'unknown') AS o_orderpriority, nullif(segment, 'unknown') AS segment
FROM {ORDERS_SENTINEL_SQL} t""")
def q_sentinel_to_null(spark, sf):
    o = orders_sentinel(spark, sf).select("o_orderkey", "o_orderpriority", "segment")
    return cols_ops.sentinel_to_null_columns(o, ["o_orderpriority", "segment"])


@register("distinct_values", "SELECT DISTINCT o_orderpriority AS value FROM orders")
def q_distinct_values(spark, sf):
    return cols_ops.distinct_values(table(spark, sf, "orders"), "o_orderpriority")


@register("bin_labels", """
SELECT CASE WHEN v > 0 AND v <= 5 THEN 'Acceptable' WHEN v > 5 AND v <= 10 THEN 'High'
            WHEN v > 10 THEN 'Severe' END AS bin_label, count(*) AS count
FROM (SELECT l_quantity / 5 AS v FROM lineitem) t GROUP BY 1""")
def q_bin_labels(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_quantity") / 5).alias("v"))
    return cols_ops.bin_labels(li, "v").groupBy("bin_label").count()


# ---------------------------------------------------------------- R1-R3, R5

def _alloc_sql(counts_cte: str, n_col: str, size: float, out: str) -> str:
    """SQL of the largest-remainder allocation: returns (y, <out>) = rows of the smaller side per class."""
    return f"""(SELECT y, {n_col} - (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS {out} FROM (
  SELECT *, n_train - sum(fl) OVER () AS need, row_number() OVER (ORDER BY cont - fl DESC, y) AS rk FROM (
    SELECT y, {n_col}, n_train, n_train * {n_col} / n AS cont, floor(n_train * {n_col} / n) AS fl FROM (
      SELECT y, {n_col}, sum({n_col}) OVER () AS n,
        sum({n_col}) OVER () - CAST(ceil(CAST({size} AS DOUBLE) * sum({n_col}) OVER ()) AS BIGINT) AS n_train
      FROM {counts_cte}) a) b) c)"""


_RANK = "row_number() OVER (PARTITION BY y ORDER BY md5(row_id || ':42'))"


@register("stratified_split", f"""
WITH p AS {PLANTED_SQL}, cnt AS (SELECT y, count(*) AS n_c FROM p GROUP BY y),
alloc AS {_alloc_sql('cnt', 'n_c', 0.2, 'test_c')}
SELECT row_id, y, CASE WHEN {_RANK} <= test_c THEN 'test' ELSE 'train' END AS split
FROM p JOIN alloc USING (y)""")
def q_stratified_split(spark, sf):
    return split.stratified_split(planted(spark, sf).select("row_id", "y"), "y", "row_id", 0.2, 42)


@register("three_way_split", f"""
WITH p AS {PLANTED_SQL}, cnt AS (SELECT y, count(*) AS n_c FROM p GROUP BY y),
a1 AS {_alloc_sql('cnt', 'n_c', 0.2, 'test_c')},
rest AS (SELECT y, n_c - test_c AS m_c, test_c FROM cnt JOIN a1 USING (y)),
a2 AS {_alloc_sql('rest', 'm_c', 0.2, 'val_c')}
SELECT row_id, y, CASE WHEN {_RANK} <= test_c THEN 'test' WHEN {_RANK} <= test_c + val_c THEN 'validation'
  ELSE 'train' END AS split
FROM p JOIN rest USING (y) JOIN a2 USING (y)""")
def q_three_way_split(spark, sf):
    return split.three_way_split(planted(spark, sf).select("row_id", "y"), "y", "row_id", 0.2, 0.2, 42)


@register("stratified_kfold", f"""
SELECT row_id, y, CAST((({_RANK} - 1) * 5) // count(*) OVER (PARTITION BY y) AS INTEGER) AS fold
FROM {PLANTED_SQL} p""")
def q_stratified_kfold(spark, sf):
    return split.stratified_kfold(planted(spark, sf).select("row_id", "y"), "y", "row_id", 5, 42)


@register("class_weights", f"""
SELECT y AS class, count(*) AS count, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM {PLANTED_SQL} p GROUP BY y""")
def q_class_weights(spark, sf):
    return rounded(split.class_weights(planted(spark, sf), "y"))


# ---------------------------------------------------------------- F1-F6

def _mode_sql(src: str, c: str, where: str = "TRUE") -> str:
    return (f"(SELECT v FROM (SELECT nullif({c}, 'unknown') AS v, count(*) AS n FROM {src} t WHERE {where} "
            f"GROUP BY 1) m WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 1)")


@register("mode_impute_fit", f"""
SELECT 'o_orderpriority' AS column_name, {_mode_sql(ORDERS_SENTINEL_SQL, 'o_orderpriority')} AS mode
UNION ALL SELECT 'segment', {_mode_sql(ORDERS_SENTINEL_SQL, 'segment')}""")
def q_mode_impute_fit(spark, sf):
    modes = prep.fit_modes(orders_sentinel(spark, sf), ["o_orderpriority", "segment"])
    # the fitted state is k scalars; return it as a tiny DataFrame
    return spark.createDataFrame(list(modes.items()), "column_name string, mode string")


@register("mode_impute_apply", f"""
SELECT o_orderkey,
  coalesce(nullif(o_orderpriority, 'unknown'), {_mode_sql(ORDERS_SENTINEL_SQL, 'o_orderpriority', "o_orderstatus = 'F'")}) AS o_orderpriority,
  coalesce(nullif(segment, 'unknown'), {_mode_sql(ORDERS_SENTINEL_SQL, 'segment', "o_orderstatus = 'F'")}) AS segment
FROM {ORDERS_SENTINEL_SQL} t""")
def q_mode_impute_apply(spark, sf):
    o = orders_sentinel(spark, sf)
    train = o.where(F.col("o_orderstatus") == "F")
    out, _ = prep.unknown_values_replace(o.select("o_orderkey", "o_orderpriority", "segment"), keep=[],
                                         modes=prep.fit_modes(train, ["o_orderpriority", "segment"]))
    return out


@register("median_impute", f"""
SELECT l_orderkey, l_linenumber,
  round(coalesce(l_discount, (SELECT median(l_discount) FROM {NULLS_SQL} a)), 6) AS l_discount,
  round(coalesce(l_tax, (SELECT median(l_tax) FROM {NULLS_SQL} b)), 6) AS l_tax
FROM {NULLS_SQL} t""")
def q_median_impute(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rounded(prep.apply_medians(df, prep.fit_medians(df, ["l_discount", "l_tax"])))


@register("standard_scale", """
SELECT l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) OVER ()) / coalesce(nullif(stddev_pop(l_quantity) OVER (), 0), 1), 6) AS l_quantity,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / coalesce(nullif(stddev_pop(l_extendedprice) OVER (), 0), 1), 6) AS l_extendedprice,
  round((l_linestatus_const - avg(l_linestatus_const) OVER ()) / coalesce(nullif(stddev_pop(l_linestatus_const) OVER (), 0), 1), 6) AS l_linestatus_const
FROM (SELECT *, 5.0 AS l_linestatus_const FROM lineitem) t""")
def q_standard_scale(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                             F.lit(5.0).alias("l_linestatus_const"))
    cols = ["l_quantity", "l_extendedprice", "l_linestatus_const"]
    return rounded(prep.apply_scaler(df, prep.fit_scaler(df, cols)))


@register("mode_impute_nulls", f"""
SELECT l_orderkey, l_linenumber, coalesce(l_returnflag,
  (SELECT l_returnflag FROM {NULLS_SQL} a WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
  AS l_returnflag FROM {NULLS_SQL} t""")
def q_mode_impute_nulls(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag")
    return prep.apply_modes(df, prep.fit_modes(df, ["l_returnflag"], sentinel=None), sentinel=None)


@register("one_hot", f"""
SELECT row_id, 'l_returnflag_' || l_returnflag AS feature_value, 1.0 AS value FROM {PLANTED_SQL} p
WHERE l_returnflag IN (SELECT DISTINCT l_returnflag FROM {PLANTED_SQL} q WHERE l_linestatus = 'F')
UNION ALL
SELECT row_id, 'l_linestatus_' || l_linestatus, 1.0 FROM {PLANTED_SQL} p
WHERE l_linestatus IN (SELECT DISTINCT l_linestatus FROM {PLANTED_SQL} q WHERE l_linestatus = 'F')""")
def q_one_hot(spark, sf):
    p = planted(spark, sf).select("row_id", "l_returnflag", "l_linestatus")
    cats = ["l_returnflag", "l_linestatus"]
    model = prep.one_hot_pipeline(cats).fit(p.where(F.col("l_linestatus") == "F"))
    return prep.one_hot_long(p, model, cats)


# ---------------------------------------------------------------- E2-E10, W2, W4, M7, X6, X7

_VAL = f"(SELECT * FROM {SCORED_SQL} s0 WHERE split = 'validation')"
_TEST = f"(SELECT * FROM {SCORED_SQL} s0 WHERE split = 'test')"


def _val(spark, sf):
    return scored_fixture(spark, sf).where(F.col("split") == "validation")


def _test(spark, sf):
    return scored_fixture(spark, sf).where(F.col("split") == "test")


def _per_class_sql(src: str) -> str:
    return f"""(SELECT model, method, class, tp, support, predicted,
    CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
  FROM (SELECT model, method, c.class,
      CAST(sum(CASE WHEN label = c.class AND prediction = c.class THEN 1 ELSE 0 END) AS BIGINT) AS tp,
      CAST(sum(CASE WHEN label = c.class THEN 1 ELSE 0 END) AS BIGINT) AS support,
      CAST(sum(CASE WHEN prediction = c.class THEN 1 ELSE 0 END) AS BIGINT) AS predicted
    FROM {src} s, (SELECT DISTINCT label AS class FROM {src} a UNION SELECT DISTINCT prediction FROM {src} b) c
    GROUP BY model, method, c.class) x)"""


def _pc_f1(src: str) -> str:
    return (f"(SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) "
            f"ELSE 0.0 END AS f1 FROM {_per_class_sql(src)} y)")


def _wprf_sql(src: str) -> str:
    return f"""(SELECT model, method, sum(support * precision) / sum(support) AS precision,
    sum(support * recall) / sum(support) AS recall, sum(support * f1) / sum(support) AS f1
  FROM {_pc_f1(src)} z GROUP BY model, method)"""


def _auc_sql(src: str) -> str:
    return f"""(SELECT model, method, CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - fp + 0.5 * neg)) / (max(P) * max(N)) END AS roc_auc
  FROM (SELECT *, sum(neg) OVER (PARTITION BY model, method ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp,
      sum(pos) OVER (PARTITION BY model, method) AS P, sum(neg) OVER (PARTITION BY model, method) AS N
    FROM (SELECT model, method, score AS s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
        sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM {src} t GROUP BY 1, 2, 3) d) c
  GROUP BY model, method)"""


@register("weighted_prf", f"SELECT model, method, round(precision, 6) AS precision, round(recall, 6) AS recall, "
          f"round(f1, 6) AS f1 FROM {_wprf_sql(_VAL)} w")
def q_weighted_prf(spark, sf):
    return rounded(metrics.weighted_prf(_val(spark, sf), ["model", "method"]))


@register("roc_auc", f"SELECT model, method, round(roc_auc, 6) AS roc_auc FROM {_auc_sql(_VAL)} a")
def q_roc_auc(spark, sf):
    return rounded(metrics.roc_auc(_val(spark, sf), ["model", "method"]))


def _roc_sql(src: str) -> str:
    return f"""(WITH d AS (SELECT model, method, score AS s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
      sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM {src} t GROUP BY 1, 2, 3),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model, method) AS P,
      sum(neg) OVER (PARTITION BY model, method) AS N
    FROM d WINDOW w AS (PARTITION BY model, method ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
  l AS (SELECT *, lag(tp) OVER o AS ltp, lag(fp) OVER o AS lfp, lead(tp) OVER o AS ntp, lead(fp) OVER o AS nfp
    FROM c WINDOW o AS (PARTITION BY model, method ORDER BY s DESC))
  SELECT model, method, s AS threshold, fp / N AS fpr, tp / P AS tpr FROM l
  WHERE ltp IS NULL OR ntp IS NULL OR ntp - 2 * tp + ltp <> 0 OR nfp - 2 * fp + lfp <> 0
  UNION ALL SELECT DISTINCT model, method, NULL, 0.0, 0.0 FROM d)"""


@register("roc_curve", f"SELECT model, method, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, "
          f"round(tpr, 6) AS tpr FROM {_roc_sql(_VAL)} r")
def q_roc_curve(spark, sf):
    return rounded(metrics.roc_curve(_val(spark, sf), ["model", "method"]))


def _report_sql(src: str, accuracy: bool, digits: int) -> str:
    acc = (f"""UNION ALL SELECT model, method, 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT)
  FROM {_pc_f1(src)} z GROUP BY model, method""" if accuracy else "")
    return f"""(SELECT model, method, class, round(precision, {digits}) AS precision, round(recall, {digits}) AS recall,
    round(f1, {digits}) AS f1, support FROM (
  SELECT model, method, CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM {_pc_f1(src)} z
  UNION ALL SELECT model, method, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT)
  FROM {_pc_f1(src)} z GROUP BY model, method
  UNION ALL SELECT model, method, 'weighted avg', sum(support * precision) / sum(support),
    sum(support * recall) / sum(support), sum(support * f1) / sum(support), CAST(sum(support) AS BIGINT)
  FROM {_pc_f1(src)} z GROUP BY model, method {acc}) r)"""


@register("classification_report", f"SELECT * FROM {_report_sql(_VAL, True, 6)} r")
def q_classification_report(spark, sf):
    return rounded(metrics.classification_report(_val(spark, sf), ["model", "method"]))


_EVAL_SQL = (f"(SELECT w.model, w.method, w.precision, w.recall, w.f1, a.roc_auc FROM {_wprf_sql(_VAL)} w "
             f"JOIN {_auc_sql(_VAL)} a ON w.model = a.model AND w.method = a.method)")


@register("evaluate_models", f"SELECT model, method, round(precision, 6) AS precision, round(recall, 6) AS recall, "
          f"round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc FROM {_EVAL_SQL} e")
def q_evaluate_models(spark, sf):
    return rounded(metrics.evaluate_models(_val(spark, sf)))


_BEST_SQL = f"(SELECT model, method FROM {_EVAL_SQL} e ORDER BY roc_auc DESC NULLS LAST, model, method LIMIT 1)"


@register("best_model", f"SELECT model, method, round(precision, 6) AS precision, round(recall, 6) AS recall, "
          f"round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc FROM {_EVAL_SQL} e "
          f"ORDER BY roc_auc DESC NULLS LAST, model, method LIMIT 1")
def q_best_model(spark, sf):
    return rounded(report.best_model(metrics.evaluate_models(_val(spark, sf))))


_PARAMS_SQL = "(SELECT * FROM (VALUES ('m1', 'random_search', 'maxDepth=5'), ('m2', 'random_search', 'maxDepth=3'), " \
              "('m3', 'holdout', 'stepSize=0.1')) AS t(model, method, params))"


def _params_df(spark):
    return spark.createDataFrame([("m1", "random_search", "maxDepth=5"), ("m2", "random_search", "maxDepth=3"),
                                  ("m3", "holdout", "stepSize=0.1")], "model string, method string, params string")


@register("summary_table", f"""
SELECT e.model, e.method, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
  round(roc_auc, 4) AS roc_auc, params, 'Validation' AS split,
  (e.model, e.method) IN (SELECT (model, method) FROM {_BEST_SQL} b) AS is_best
FROM {_EVAL_SQL} e LEFT JOIN {_PARAMS_SQL} p ON e.model = p.model AND e.method = p.method
UNION ALL
SELECT w.model, w.method, round(w.precision, 4), round(w.recall, 4), round(w.f1, 4), round(a.roc_auc, 4),
  CAST(NULL AS VARCHAR), 'Test', TRUE
FROM {_wprf_sql(_TEST)} w JOIN {_auc_sql(_TEST)} a ON w.model = a.model AND w.method = a.method
WHERE (w.model, w.method) IN (SELECT (model, method) FROM {_BEST_SQL} b)""")
def q_summary_table(spark, sf):
    val = metrics.evaluate_models(_val(spark, sf))
    test = metrics.evaluate_models(_test(spark, sf))
    return report.summary_table(val, test, _params_df(spark))


@register("roc_curves_all", f"""
SELECT r.model, r.method, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr,
  r.model || ' ' || r.method || ' (AUC = ' || printf('%.3f', a.roc_auc) || ')' AS series
FROM {_roc_sql(_VAL)} r JOIN {_auc_sql(_VAL)} a ON r.model = a.model AND r.method = a.method
UNION ALL SELECT 'chance', 'chance', NULL, 0.0, 0.0, 'chance'
UNION ALL SELECT 'chance', 'chance', NULL, 1.0, 1.0, 'chance'""")
def q_roc_curves_all(spark, sf):
    return rounded(report.roc_curves_all(_val(spark, sf)))


@register("reports_all", f"SELECT * FROM {_report_sql(_VAL, False, 4)} r")
def q_reports_all(spark, sf):
    return report.reports_all(_val(spark, sf))


@register("test_report", f"SELECT * FROM {_report_sql(f'(SELECT t.* FROM {_TEST} t JOIN {_BEST_SQL} b ON t.model = b.model AND t.method = b.method)', True, 4)} r")
def q_test_report(spark, sf):
    winner = report.best_model(metrics.evaluate_models(_val(spark, sf)))
    return report.test_report(_test(spark, sf), winner)


@register("rank_by_abs", """
SELECT feature, round(r, 6) AS corr, CAST(row_number() OVER (ORDER BY abs(r) DESC, feature) AS INTEGER) AS rank
FROM (SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS r FROM lineitem
      UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem
      UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem) t""")
def q_rank_by_abs(spark, sf):
    li = table(spark, sf, "lineitem")
    feats = ["l_quantity", "l_discount", "l_tax"]
    row = li.agg(*[F.struct(F.lit(c).alias("feature"), F.corr(c, "l_extendedprice").alias("corr")).alias(c) for c in feats])
    long = row.select(F.inline(F.array(*[F.col(c) for c in feats])))
    return rounded(report.rank_by_abs(long, "corr", "feature"))


@register("vote_soft", f"""
SELECT row_id, round(avg(score), 9) AS score, CAST(round(avg(score), 9) >= 0.5 AS INTEGER) AS prediction
FROM {SCORED_SQL} s GROUP BY row_id""")
def q_vote_soft(spark, sf):
    return ensemble.vote_soft(scored_fixture(spark, sf), digits=9)


@register("vote_hard", f"""
SELECT row_id, CASE WHEN 2 * sum(prediction) > count(*) THEN 1 ELSE 0 END AS prediction, count(*) AS n_votes
FROM {SCORED_SQL} s GROUP BY row_id""")
def q_vote_hard(spark, sf):
    return ensemble.vote_hard(scored_fixture(spark, sf))


@register("error_rows", f"SELECT model, method, row_id, label, prediction FROM {_VAL} v WHERE label <> prediction")
def q_error_rows(spark, sf):
    return cols_ops.misclassified(_val(spark, sf)).select("model", "method", "row_id", "label", "prediction")


@register("error_counts", f"""
SELECT model, method, label, prediction, count(*) AS count,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY model, method), 6) AS pct_of_errors
FROM {_VAL} v WHERE label <> prediction GROUP BY 1, 2, 3, 4""")
def q_error_counts(spark, sf):
    from tabula.operators.explain import error_counts
    return rounded(error_counts(_val(spark, sf), ["model", "method"]))


@register("error_summary", f"""
SELECT model, method, count(*) AS n_rows, CAST(sum(CAST(label <> prediction AS INTEGER)) AS BIGINT) AS n_errors,
  round(avg(CAST(label <> prediction AS INTEGER)) * 100, 6) AS error_pct FROM {_VAL} v GROUP BY 1, 2""")
def q_error_summary(spark, sf):
    """X6: rows, errors and their percentage, per model."""
    from tabula.operators.explain import error_summary
    return rounded(error_summary(_val(spark, sf), ["model", "method"]))


@register("error_describe", "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max
FROM {PLANTED_SQL} p JOIN (SELECT row_id FROM {_VAL} v WHERE model = 'm1' AND label <> prediction) e USING (row_id)"""
    for c in ("l_quantity", "l_discount")) + ") d")
def q_error_describe(spark, sf):
    errs = cols_ops.misclassified(_val(spark, sf).where(F.col("model") == "m1")).select("row_id")
    rows = planted(spark, sf).join(errs, "row_id", "left_semi")
    return rounded(prof.describe(rows, ["l_quantity", "l_discount"]))


_FOLDED = ("(SELECT model, CAST(CAST(floor((CAST(('0x' || substr(md5(row_id || ':5'), 1, 8)) AS UBIGINT) "
           f"/ 4294967296.0) * 5) AS INTEGER) AS VARCHAR) AS method, label, prediction FROM {_VAL} v)")


@register("cv_summary", f"""
SELECT model, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1, count(*) AS n_folds
FROM {_wprf_sql(_FOLDED)} w GROUP BY model""")
def q_cv_summary(spark, sf):
    """T7's aggregation: per-fold weighted F1 -> mean and population std per model (fold = md5 fifth)."""
    from tabula.functions.expr import uniform01
    from tabula.operators.search import cv_summary

    v = _val(spark, sf).withColumn("fold", F.floor(uniform01("row_id", 5) * 5).cast("int"))
    per_fold = metrics.weighted_prf(v, ["model", "fold"])
    return rounded(cv_summary(per_fold, ["model"]))


@register("attach_predictions", f"""
SELECT p.row_id, round(p.l_quantity, 6) AS l_quantity, round(p.l_discount, 6) AS l_discount, v.label, v.prediction,
  round(v.score, 6) AS score
FROM {PLANTED_SQL} p JOIN (SELECT * FROM {_VAL} s WHERE model = 'm1') v ON p.row_id = v.row_id""")
def q_attach_predictions(spark, sf):
    """J1: predictions re-attached to their feature rows by key (an explicit row_id equi-join)."""
    preds = _val(spark, sf).where(F.col("model") == "m1").select("row_id", "label", "prediction", "score")
    feats = planted(spark, sf).select("row_id", "l_quantity", "l_discount")
    return rounded(feats.join(preds, "row_id"))


@register("feature_roles", """
WITH c AS (SELECT column_name, column_type, row_number() OVER () - 1 AS i FROM (DESCRIBE SELECT * FROM orders))
SELECT column_name AS feature, CASE WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'numeric' END AS role,
  CAST(CASE WHEN column_type = 'VARCHAR' THEN i END AS INTEGER) AS ordinal
FROM c WHERE column_type IN ('VARCHAR', 'BIGINT', 'INTEGER', 'DOUBLE') AND column_name != 'o_orderstatus'""")
def q_feature_roles(spark, sf):
    """P3 and P4: roles by type without the target, and the ordinals of the columns that are not numeric."""
    o = table(spark, sf, "orders")
    numeric, categorical = expr.feature_roles(o, "o_orderstatus")
    at = {o.columns[i]: i for i in expr.categorical_indices(o, numeric)}
    rows = [(c, "numeric", None) for c in numeric] + [(c, "categorical", at[c]) for c in categorical]
    return spark.createDataFrame(rows, "feature string, role string, ordinal int")
