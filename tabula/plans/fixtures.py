"""Driver-table stand-ins for the reference's bank table (each with the identical SQL for the oracle).

* planted binary target on ``lineitem``: ``y = l_quantity >= 40 AND l_discount >= 0.05``;
  ``row_id`` is the natural key string (orderkey:linenumber:partkey:suppkey:shipdate), unique
  because whole rows are unique;
* string sentinel 'unknown': ``orders.o_orderpriority = '4-NOT SPECIFIED'`` and, via the customer
  join, ``c_mktsegment = 'BUILDING'``;
* real nulls: ``nullif`` injections on ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- planted lineitem -------------------------------------------------------------------------

PLANTED_SQL = """(SELECT *,
    concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS row_id,
    CAST(l_quantity >= 40 AND l_discount >= 0.05 AS INTEGER) AS y
  FROM lineitem)"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "*",
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.col("l_shipdate").cast("date").cast("string")).alias("row_id"),
        ((F.col("l_quantity") >= 40) & (F.col("l_discount") >= 0.05)).cast("int").alias("y"),
    )


# ---- lineitem with injected nulls -------------------------------------------------------------

NULLS_SQL = """(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
    nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax,
    nullif(l_returnflag, 'R') AS l_returnflag, l_linestatus
  FROM lineitem)"""


def lineitem_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
                     F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"),
                     F.nullif(F.col("l_returnflag"), F.lit("R")).alias("l_returnflag"), "l_linestatus")


# ---- orders with sentinels ----------------------------------------------------------------------

ORDERS_SENTINEL_SQL = """(SELECT o_orderkey, o_orderstatus,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE o_orderpriority END AS o_orderpriority,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE c_mktsegment END AS segment,
    o_totalprice,
    CAST(o_orderstatus = 'F' AS INTEGER) AS y
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def orders_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    return j.select(
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("unknown"))
         .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("unknown")).otherwise(F.col("c_mktsegment")).alias("segment"),
        "o_totalprice",
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
    )


# ---- orders as a client table: string target, sentinels, nulls, a count to binarize, a column to drop ------------

CLIENTS_SQL = """(SELECT CAST(o_orderkey AS VARCHAR) AS row_id,
    CASE WHEN coalesce(o_totalprice >= 300000 AND c_nationkey % 4 >= 1 AND o_orderpriority IN ('1-URGENT', '2-HIGH'), false)
      <> (substr(md5(CAST(o_orderkey AS VARCHAR) || ':noise'), 1, 1) = '0') THEN 'yes' ELSE 'no' END AS y,
    CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice END AS price, c_acctbal AS balance, c_nationkey % 4 AS previous,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE o_orderpriority END AS priority,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE c_mktsegment END AS segment,
    nullif(o_orderstatus, 'P') AS status, year(o_orderdate) AS duration
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that depends on three columns and has a sixteenth of its rows flipped."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    j = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    row_id, previous = F.col("o_orderkey").cast("string"), F.col("c_nationkey") % 4
    rule = F.coalesce((F.col("o_totalprice") >= 300000) & (previous >= 1) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(False))
    flipped = F.substring(F.md5(F.concat(row_id, F.lit(":noise"))), 1, 1) == "0"
    return j.select(
        row_id.alias("row_id"), F.when(rule != flipped, F.lit("yes")).otherwise(F.lit("no")).alias("y"),
        F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice")).alias("price"), F.col("c_acctbal").alias("balance"),
        previous.alias("previous"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("unknown")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("unknown")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), F.year("o_orderdate").alias("duration"))


# ---- deterministic scored table for the metric operators ---------------------------------------
# Three synthetic "models" whose scores blend the planted label with md5 uniforms; scores are floored
# to 2 decimals so ties occur. split: 80 % validation / 20 % test. One md5 per row supplies all four
# uniforms (its four 8-hex-digit slices).

def _u_sql(slot: int) -> str:
    return f"(CAST(('0x' || substr(md5(row_id || ':1'), {1 + 8 * slot}, 8)) AS UBIGINT) / 4294967296.0)"


SCORED_SQL = f"""(SELECT model, method, row_id, y AS label, split, score,
    CAST(score >= 0.5 AS INTEGER) AS prediction
  FROM (
    SELECT row_id, y, CASE WHEN {_u_sql(3)} < 0.8 THEN 'validation' ELSE 'test' END AS split,
      floor((0.6 * y + 0.4 * {_u_sql(0)}) * 100) / 100 AS s1,
      floor((0.3 * y + 0.7 * {_u_sql(1)}) * 100) / 100 AS s2,
      floor({_u_sql(2)} * 100) / 100 AS s3
    FROM {PLANTED_SQL} p0) b,
  LATERAL (VALUES ('m1', 'random_search', s1), ('m2', 'random_search', s2), ('m3', 'holdout', s3)) AS v(model, method, score))"""


def scored_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabula.functions.expr import hash_key

    p = planted(spark, sf_dir)
    y = F.col("y")
    h = hash_key("row_id", 1)

    def u(slot):
        return F.conv(F.substring(h, 1 + 8 * slot, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    s1 = F.floor((0.6 * y + 0.4 * u(0)) * 100) / 100
    s2 = F.floor((0.3 * y + 0.7 * u(1)) * 100) / 100
    s3 = F.floor(u(2) * 100) / 100
    base = p.select("row_id", y.alias("label"),
                    F.when(u(3) < 0.8, F.lit("validation")).otherwise(F.lit("test")).alias("split"),
                    F.array(F.struct(F.lit("m1").alias("model"), F.lit("random_search").alias("method"), s1.alias("score")),
                            F.struct(F.lit("m2").alias("model"), F.lit("random_search").alias("method"), s2.alias("score")),
                            F.struct(F.lit("m3").alias("model"), F.lit("holdout").alias("method"), s3.alias("score"))).alias("m"))
    long = base.select("row_id", "label", "split", F.inline("m"))
    return long.select("model", "method", "row_id", "label", "split", "score",
                       (F.col("score") >= 0.5).cast("int").alias("prediction"))
