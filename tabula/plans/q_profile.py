"""Registered profile and association queries (A1-A25, P-family, S3) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabula.operators import association as assoc
from tabula.operators import profile as prof
from tabula.plans.fixtures import (
    NULLS_SQL,
    ORDERS_SENTINEL_SQL,
    PLANTED_SQL,
    lineitem_nulls,
    orders_sentinel,
    planted,
    table,
)
from tabula.plans.registry import register, rounded

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- A8 / A11 (minimum slice)

@register("class_distribution", """
SELECT o_orderstatus AS class, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS proportion
FROM orders GROUP BY o_orderstatus""")
def q_class_distribution(spark, sf):
    return rounded(prof.class_distribution(table(spark, sf, "orders"), "o_orderstatus"))


@register("target_rate_by_value", f"""
SELECT l_linenumber AS value, round(avg(y), 6) AS target_rate, count(*) AS n
FROM {PLANTED_SQL} p GROUP BY l_linenumber""")
def q_target_rate_by_value(spark, sf):
    return rounded(prof.target_rate_by_value(planted(spark, sf), "l_linenumber", "y"))


# ---------------------------------------------------------------- A1 / A2

@register("shape_types", """
SELECT column_name,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS dtype,
  CAST(ordinal_position - 1 AS INTEGER) AS ordinal,
  (SELECT count(*) FROM lineitem) AS n_rows,
  CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = 'lineitem') AS INTEGER) AS n_cols
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def q_shape_types(spark, sf):
    return prof.shape_types(table(spark, sf, "lineitem"))


def _describe_sql(src: str, cols: list[str]) -> str:
    return _union([f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {src}""" for c in cols])


@register("describe", _describe_sql("lineitem", LI_NUM))
def q_describe(spark, sf):
    return rounded(prof.describe(table(spark, sf, "lineitem"), LI_NUM))


# ---------------------------------------------------------------- A3-A7

NULL_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus"]


@register("null_counts", _union([
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM {NULLS_SQL} t"
    for c in NULL_COLS]))
def q_null_counts(spark, sf):
    return prof.null_counts(lineitem_nulls(spark, sf))


@register("missing_summary", "SELECT column_name, missing_count, missing_pct, CAST(row_number() OVER ("
          "ORDER BY missing_pct DESC, ordinal) AS INTEGER) AS rank FROM (" + _union([
              f"SELECT '{c}' AS column_name, {i} AS ordinal, CAST(count(*) - count({c}) AS BIGINT) AS missing_count, "
              f"round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct FROM {NULLS_SQL} t"
              for i, c in enumerate(NULL_COLS)]) + ") s WHERE missing_count > 0")
def q_missing_summary(spark, sf):
    return prof.missing_summary(lineitem_nulls(spark, sf))


SENT_COLS = ["o_orderstatus", "o_orderpriority", "segment"]


@register("sentinel_share", "SELECT * FROM (" + _union([
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} = 'unknown' THEN 1 ELSE 0 END), 6) AS share "
    f"FROM {ORDERS_SENTINEL_SQL} t" for c in SENT_COLS]) + ") s WHERE share > 0")
def q_sentinel_share(spark, sf):
    return rounded(prof.sentinel_share(orders_sentinel(spark, sf), SENT_COLS))


@register("numeric_sentinel_share", """
SELECT 'l_discount' AS column_name, round(avg(CASE WHEN l_discount = 0.0 THEN 1 ELSE 0 END), 6) AS share
FROM lineitem""")
def q_numeric_sentinel_share(spark, sf):
    return rounded(prof.numeric_sentinel_share(table(spark, sf, "lineitem"), "l_discount", 0.0))


@register("value_counts_topk", """
SELECT l_quantity AS value, count(*) AS count,
  CAST(row_number() OVER (ORDER BY count(*) DESC, l_quantity) AS INTEGER) AS rank
FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 5""")
def q_value_counts_topk(spark, sf):
    return prof.value_counts_topk(table(spark, sf, "lineitem"), "l_quantity", 5)


# ---------------------------------------------------------------- A9 / A10

_cooc_pairs = [(a, b) for a in SENT_COLS for b in SENT_COLS]


@register("sentinel_cooccurrence", _union([
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
    f"CAST(sum(CASE WHEN {a} = 'unknown' AND {b} = 'unknown' THEN 1 ELSE 0 END) AS BIGINT) AS count, "
    f"round(sum(CASE WHEN {a} = 'unknown' AND {b} = 'unknown' THEN 1 ELSE 0 END) / count(*) * 100, 6) AS pct "
    f"FROM {ORDERS_SENTINEL_SQL} t" for a, b in _cooc_pairs]))
def q_sentinel_cooccurrence(spark, sf):
    return rounded(prof.sentinel_cooccurrence(orders_sentinel(spark, sf), SENT_COLS))


RATE_COLS = ["o_orderpriority", "segment"]


@register("target_rate_sentinel", _union([
    f"SELECT '{c}' AS column_name, "
    f"round(avg(CASE WHEN {c} = 'unknown' THEN y END) * 100, 6) AS rate_unknown, "
    f"round(avg(CASE WHEN coalesce({c} = 'unknown', false) THEN NULL ELSE y END) * 100, 6) AS rate_known, "
    f"round(avg(y) * 100, 6) AS rate_overall FROM {ORDERS_SENTINEL_SQL} t" for c in RATE_COLS]))
def q_target_rate_sentinel(spark, sf):
    return rounded(prof.target_rate_sentinel(orders_sentinel(spark, sf), "y", RATE_COLS))


# ---------------------------------------------------------------- A12-A17

MOM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("skew_kurtosis", "SELECT feature, round(sk, 3) AS skewness, round(ku, 3) AS kurtosis, "
          "CASE WHEN abs(sk) > 1 THEN 'High skew' ELSE '' END AS skew_flag, "
          "CAST(row_number() OVER (ORDER BY abs(sk) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM (" + _union([
              f"SELECT '{c}' AS feature, skewness({c}) AS sk, kurtosis({c}) AS ku FROM lineitem" for c in MOM_COLS]) + ") m")
def q_skew_kurtosis(spark, sf):
    return prof.skew_kurtosis(table(spark, sf, "lineitem"), MOM_COLS)


PCT_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("percentiles", _union([
    f"SELECT '{c}' AS feature, " + ", ".join(
        f"round(quantile_cont({c}, {p}), 6) AS p{round(p * 100)}" for p in prof.PERCENTILES) + " FROM lineitem"
    for c in PCT_COLS]))
def q_percentiles(spark, sf):
    return rounded(prof.percentiles(table(spark, sf, "lineitem"), PCT_COLS))


@register("iqr", """
SELECT 'value' AS feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
  round((q3 - q1) / 2, 6) AS quartile_deviation
FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) q""")
def q_iqr(spark, sf):
    return rounded(prof.iqr(table(spark, sf, "events"), ["value"]))


@register("histogram", """
WITH mm AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30)),
c AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n
      FROM events, mm WHERE value IS NOT NULL GROUP BY 1)
SELECT 'value' AS feature, bins.bin,
  round(lo + bins.bin * ((hi - lo) / 30), 6) AS bin_lo,
  round(CASE WHEN bins.bin = 29 THEN hi ELSE lo + (bins.bin + 1) * ((hi - lo) / 30) END, 6) AS bin_hi,
  coalesce(c.n, 0) AS count
FROM bins CROSS JOIN mm LEFT JOIN c ON c.bin = bins.bin""")
def q_histogram(spark, sf):
    return rounded(prof.histogram(table(spark, sf, "events"), ["value"], bins=30))


@register("box_stats", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
                  quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL GROUP BY event_type),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS hf FROM q)
SELECT e.event_type AS "group", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN value >= lf AND value <= hf THEN value END), 6) AS whisker_lo,
  round(max(CASE WHEN value >= lf AND value <= hf THEN value END), 6) AS whisker_hi,
  CAST(sum(CASE WHEN value >= lf AND value <= hf THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
  count(*) AS n, round(q3 - q1, 6) AS iqr
FROM events e JOIN f ON e.event_type = f.event_type WHERE value IS NOT NULL
GROUP BY e.event_type, q1, med, q3""")
def q_box_stats(spark, sf):
    return rounded(prof.box_stats(table(spark, sf, "events"), "value", "event_type"))


@register("scatter_pairs", "SELECT l_discount AS x, l_tax AS y, count(*) AS count FROM lineitem GROUP BY 1, 2")
def q_scatter_pairs(spark, sf):
    return prof.scatter_pairs(table(spark, sf, "lineitem"), "l_discount", "l_tax")


# ---------------------------------------------------------------- A18-A21

CORR_SRC = "(SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS l_net, l_quantity, l_discount FROM lineitem)"
CORR_COLS = ["l_extendedprice", "l_net", "l_quantity", "l_discount"]


def _corr_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l_net"),
                     "l_quantity", "l_discount")


@register("corr_matrix", _union([
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM {CORR_SRC} t"
    for a in CORR_COLS for b in CORR_COLS]))
def q_corr_matrix(spark, sf):
    return rounded(assoc.corr_matrix(_corr_frame(spark, sf), CORR_COLS))


@register("high_corr_pairs", "SELECT feature_a, feature_b, round(r, 6) AS corr, CAST(row_number() OVER ("
          "ORDER BY abs(r) DESC, ia, ib) AS INTEGER) AS rank FROM (" + _union([
              f"SELECT '{CORR_COLS[i]}' AS feature_a, '{CORR_COLS[j]}' AS feature_b, {i} AS ia, {j} AS ib, "
              f"corr({CORR_COLS[i]}, {CORR_COLS[j]}) AS r FROM {CORR_SRC} t"
              for i in range(len(CORR_COLS)) for j in range(i + 1, len(CORR_COLS))]) + ") s WHERE abs(r) >= 0.7")
def q_high_corr_pairs(spark, sf):
    return rounded(assoc.high_corr_pairs(_corr_frame(spark, sf), CORR_COLS, 0.7))


TC_COLS = ["l_quantity", "l_discount", "l_extendedprice", "l_tax"]


@register("target_correlation", "SELECT feature, round(r, 6) AS corr, CASE WHEN r IS NULL THEN NULL "
          "WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS band, "
          "CAST(row_number() OVER (ORDER BY abs(r) ASC NULLS LAST, ordinal) AS INTEGER) AS rank FROM (" + _union([
              f"SELECT '{c}' AS feature, {i} AS ordinal, corr(CAST(y AS DOUBLE), {c}) AS r FROM {PLANTED_SQL} p"
              for i, c in enumerate(TC_COLS)]) + ") s")
def q_target_correlation(spark, sf):
    return rounded(assoc.target_correlation(planted(spark, sf), TC_COLS, "y"))


VIF_COLS = ["l_quantity", "l_extendedprice", "l_tax"]


@register("vif", """
WITH g AS (SELECT sum(l_quantity * l_quantity) AS a11, sum(l_quantity * l_extendedprice) AS a12,
                  sum(l_quantity * l_tax) AS a13, sum(l_extendedprice * l_extendedprice) AS a22,
                  sum(l_extendedprice * l_tax) AS a23, sum(l_tax * l_tax) AS a33
           FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_tax IS NOT NULL),
d AS (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM g),
v AS (SELECT 'l_quantity' AS feature, 0 AS ordinal, a11 * (a22 * a33 - a23 * a23) / det AS vif FROM d
      UNION ALL SELECT 'l_extendedprice', 1, a22 * (a11 * a33 - a13 * a13) / det FROM d
      UNION ALL SELECT 'l_tax', 2, a33 * (a11 * a22 - a12 * a12) / det FROM d)
SELECT feature, round(vif, 4) AS vif,
  CASE WHEN vif > 0 AND vif <= 5 THEN 'Acceptable' WHEN vif > 5 AND vif <= 10 THEN 'High'
       WHEN vif > 10 THEN 'Severe' END AS severity,
  CAST(row_number() OVER (ORDER BY vif DESC, ordinal) AS INTEGER) AS rank
FROM v""")
def q_vif(spark, sf):
    return rounded(assoc.vif(table(spark, sf, "lineitem"), VIF_COLS), 4)


# ---------------------------------------------------------------- A22-A25

@register("crosstab", """
WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem
           WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT x FROM c), (SELECT DISTINCT y FROM c))
SELECT g.x AS x_value, g.y AS y_value, coalesce(n, 0) AS count FROM g LEFT JOIN c ON g.x = c.x AND g.y = c.y""")
def q_crosstab(spark, sf):
    """The full table: flag and status leave cells empty, which count 0."""
    return assoc.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


def cramers_sql(cells_sql: str, keys: list[str]) -> str:
    """Oracle Cramér's V over the full grid (zero cells explicit); Yates when dof = 1."""
    k = ", ".join(keys)
    kk = " AND ".join(f"r.{x} = c.{x}" for x in keys)
    return f"""
WITH cells AS ({cells_sql}),
ra AS (SELECT {k}, a, sum(cnt) AS ra FROM cells GROUP BY {k}, a),
cb AS (SELECT {k}, b, sum(cnt) AS cb FROM cells GROUP BY {k}, b),
dims AS (SELECT {k}, count(*) AS kk, sum(ra) AS n FROM ra GROUP BY {k}),
dimc AS (SELECT {k}, count(*) AS rr FROM cb GROUP BY {k}),
grid AS (SELECT {", ".join("r." + x for x in keys)}, r.a, c.b, r.ra, c.cb FROM ra r JOIN cb c ON {kk}),
full_grid AS (SELECT g.*, coalesce(x.cnt, 0) AS o, g.ra * g.cb / d.n AS e, d.n, d.kk, m.rr
  FROM grid g JOIN dims d USING ({k}) JOIN dimc m USING ({k}) LEFT JOIN cells x USING ({k}, a, b)),
chi AS (SELECT {k}, max(n) AS n, max(kk) AS kk, max(rr) AS rr,
  CASE WHEN max((kk - 1) * (rr - 1)) = 0 THEN 0.0
       WHEN max((kk - 1) * (rr - 1)) = 1 THEN sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e)
       ELSE sum(pow(o - e, 2) / e) END AS chi2
  FROM full_grid GROUP BY {k})
SELECT {k}, round(chi2, 6) AS chi2,
  round(CASE WHEN n * (least(kk, rr) - 1) > 0 THEN sqrt(chi2 / (n * (least(kk, rr) - 1))) END, 6) AS cramers_v,
  CAST(n AS BIGINT) AS n
FROM chi"""


@register("cramers_v", cramers_sql(
    "SELECT 'l_returnflag' AS feature_a, 'l_linestatus' AS feature_b, l_returnflag AS a, l_linestatus AS b, "
    "count(*) AS cnt FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 3, 4",
    ["feature_a", "feature_b"]))
def q_cramers_v(spark, sf):
    return rounded(assoc.cramers_v(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@register("cramers_v_yates", cramers_sql(
    f"SELECT 'l_linestatus' AS feature_a, 'y' AS feature_b, l_linestatus AS a, CAST(y AS VARCHAR) AS b, "
    f"count(*) AS cnt FROM {PLANTED_SQL} p WHERE l_linestatus IS NOT NULL GROUP BY 3, 4",
    ["feature_a", "feature_b"]))
def q_cramers_v_yates(spark, sf):
    return rounded(assoc.cramers_v(planted(spark, sf), "l_linestatus", "y"))


CV_TARGET_COLS = ["l_returnflag", "l_linestatus", "l_qbucket"]
_CV_SRC = f"(SELECT *, CAST(CAST(floor(l_quantity / 10) AS INTEGER) AS VARCHAR) AS l_qbucket FROM {PLANTED_SQL} p0)"


def _cv_target_frame(spark, sf):
    return planted(spark, sf).withColumn("l_qbucket", F.floor(F.col("l_quantity") / 10).cast("int").cast("string"))


@register("cramers_v_target",
          "SELECT feature, cramers_v, CASE WHEN cramers_v IS NULL THEN NULL WHEN cramers_v >= 0.5 THEN 'strong' "
          "WHEN cramers_v >= 0.1 THEN 'moderate' ELSE 'weak' END AS band, "
          "CAST(row_number() OVER (ORDER BY cramers_v ASC NULLS LAST, CASE feature "
          + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CV_TARGET_COLS)) + " END) AS INTEGER) AS rank FROM ("
          + cramers_sql(_union([
              f"SELECT '{c}' AS feature, {c} AS a, CAST(y AS VARCHAR) AS b, count(*) AS cnt FROM {_CV_SRC} s "
              f"WHERE {c} IS NOT NULL GROUP BY 2, 3" for c in CV_TARGET_COLS]), ["feature"]) + ") v")
def q_cramers_v_target(spark, sf):
    return rounded(assoc.cramers_v_target(_cv_target_frame(spark, sf), CV_TARGET_COLS, "y"))


CV_MATRIX_COLS = ["p_brand", "p_type", "p_size_s"]
_PART_SRC = "(SELECT p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size_s FROM part)"


@register("cramers_v_matrix", "SELECT feature_a, feature_b, cramers_v FROM (" + cramers_sql(_union([
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {a} AS a, {b} AS b, count(*) AS cnt FROM {_PART_SRC} t "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 3, 4" for a in CV_MATRIX_COLS for b in CV_MATRIX_COLS]),
    ["feature_a", "feature_b"]) + ") v")
def q_cramers_v_matrix(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_type", F.col("p_size").cast("string").alias("p_size_s"))
    return rounded(assoc.cramers_v_matrix(part, CV_MATRIX_COLS))
