"""Registered kNN (M3) and SMOTE (R4) queries on ``embeddings`` with brute-force DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabula.functions.expr import uniform01
from tabula.operators import neighbors, resample
from tabula.plans.fixtures import table
from tabula.plans.registry import register, rounded

K = 3


def emb(spark, sf):
    """embeddings as array<double>, a 20 % query side by md5 uniform, and a binary minority target."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label",
                    (uniform01("vec_id", 42) < 0.2).alias("is_q"),
                    (F.col("label") == 0).cast("int").alias("y"))


EMB_SQL = """(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label,
    (CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':42'), 1, 8)) AS UBIGINT) / 4294967296.0) < 0.2 AS is_q,
    CAST(label = 0 AS INTEGER) AS y
  FROM embeddings)"""

_MANHATTAN = "list_sum(list_transform(list_zip(qv, rv), lambda x: abs(x[1] - x[2])))"


def _nn_sql(dist: str) -> str:
    return f"""(SELECT * FROM (
    SELECT q_id, r_id, r_label, distance, row_number() OVER (PARTITION BY q_id ORDER BY distance, r_id) AS rank
    FROM (SELECT q.vec_id AS q_id, r.vec_id AS r_id, r.label AS r_label, {dist} AS distance
          FROM (SELECT vec_id, v AS qv FROM {EMB_SQL} a WHERE is_q) q,
               (SELECT vec_id, v AS rv, label FROM {EMB_SQL} b WHERE NOT is_q) r) d) x WHERE rank <= {K})"""


def _knn(spark, sf, metric):
    e = emb(spark, sf)
    return neighbors.knn(e.where("is_q").select(F.col("vec_id").alias("q_id"), "v"),
                         e.where("NOT is_q").select(F.col("vec_id").alias("r_id"), "v", "label"), K, metric)


@register("knn_neighbors", f"""
SELECT q_id, CAST(rank AS INTEGER) AS rank, r_id, round(distance, 6) AS distance, r_label
FROM {_nn_sql('list_distance(qv, rv)')} n""")
def q_knn_neighbors(spark, sf):
    return rounded(_knn(spark, sf, "euclidean"))


def _vote_sql(nn: str, weighted: bool) -> str:
    if weighted:
        w = ("CASE WHEN max(CASE WHEN distance = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q_id) = 1 "
             "THEN CAST(distance = 0 AS DOUBLE) ELSE 1.0 / distance END")
    else:
        w = "1.0"
    return f"""SELECT q_id, first(r_label ORDER BY votes DESC, r_label) AS prediction FROM (
  SELECT q_id, r_label, sum(w) AS votes FROM (SELECT *, {w} AS w FROM {nn} n) a GROUP BY q_id, r_label) v
GROUP BY q_id"""


@register("knn_exact", _vote_sql(_nn_sql("list_distance(qv, rv)"), False))
def q_knn_exact(spark, sf):
    return neighbors.knn_vote(_knn(spark, sf, "euclidean"), "uniform")


@register("knn_manhattan", _vote_sql(_nn_sql(_MANHATTAN), False))
def q_knn_manhattan(spark, sf):
    return neighbors.knn_vote(_knn(spark, sf, "manhattan"), "uniform")


@register("knn_distance_weighted", _vote_sql(_nn_sql("list_distance(qv, rv)"), True))
def q_knn_distance_weighted(spark, sf):
    return neighbors.knn_vote(_knn(spark, sf, "euclidean"), "distance")


# ---------------------------------------------------------------- SMOTE

def _hex32(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS UBIGINT)"


SMOTE_SQL = f"""(WITH e AS {EMB_SQL},
cnt AS (SELECT CAST(sum(y) AS BIGINT) AS n_min, CAST(count(*) - sum(y) AS BIGINT) AS n_maj FROM e),
par AS (SELECT n_min, n_maj, n_maj - n_min AS n_new, least(5, n_min - 1) AS k,
               (n_maj - n_min) // n_min AS q, (n_maj - n_min) % n_min AS extra FROM cnt),
m AS (SELECT vec_id, v FROM e WHERE y = 1),
nn AS (SELECT * FROM (SELECT a.vec_id AS q_id, b.vec_id AS r_id, b.v AS nv,
          row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
        FROM m a, m b WHERE a.vec_id <> b.vec_id) x, par WHERE rank <= k),
alloc AS (SELECT m.*, q + CASE WHEN row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42')) <= extra
                               THEN 1 ELSE 0 END AS n_children FROM m, par),
ch AS (SELECT vec_id, v, UNNEST(range(0, n_children)) AS child FROM alloc WHERE n_children > 0),
ck AS (SELECT *, CAST(vec_id AS VARCHAR) || ':' || CAST(child AS VARCHAR) AS key FROM ch)
SELECT ck.vec_id AS base_id, CAST(ck.child AS INTEGER) AS child, nn.r_id AS neighbor_id,
  {_hex32("key || ':44'")} / 4294967296.0 AS gap, ck.v, nn.nv
FROM ck, par JOIN nn ON TRUE
WHERE nn.q_id = ck.vec_id AND nn.rank = ({_hex32("key || ':43'")} % par.k) + 1)"""


@register("smote", f"""
SELECT base_id, child, neighbor_id, round(gap, 6) AS gap,
  round(v[1] + gap * (nv[1] - v[1]), 6) AS x_first,
  round(list_sum(list_transform(list_zip(v, nv), lambda x: x[1] + gap * (x[2] - x[1]))), 6) AS x_sum
FROM {SMOTE_SQL} s""")
def q_smote(spark, sf):
    e = emb(spark, sf)
    syn = resample.smote_samples(e, "y", "vec_id", "v", k=5, seed=42, minority=1, majority=0)
    return rounded(syn.select("base_id", "child", "neighbor_id", "gap", F.col("v")[0].alias("x_first"),
                              F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("x_sum")))


@register("smote_counts", f"""
SELECT y, count(*) AS count FROM (SELECT y FROM {EMB_SQL} e UNION ALL SELECT 1 FROM {SMOTE_SQL} s) t GROUP BY y""")
def q_smote_counts(spark, sf):
    e = emb(spark, sf)
    out = resample.smote(e.select(F.col("vec_id"), "v", "y"), "y", "vec_id", "v", k=5, seed=42)
    return out.groupBy("y").count()
