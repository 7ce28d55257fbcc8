"""Mixing sources to target weights.

Tokens are summed per source; a source's rate is its target over its size; each document is emitted
floor(rate) times plus one more copy when a hash-seeded uniform of its id falls below the fraction. The
targets are a water level: weight times one level, but at most ``MAX_REPEAT`` times the source, with the
level set so that the targets add up to the corpus (which is what resharing the excess until none is above
converges to). The level is read off the sources sorted by cap over weight: one small row per source.

Defined cases: null text has size 0 and takes nothing; null is a source of its own, ordered last; rows
with one id share their draw; an empty table or all-empty texts give target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabula.functions.expr import uniform01
from tabula.llm.common import DOC_COLUMNS, documents, register, small, word_count
from tabula.session import materialize

MAX_REPEAT = 3
SEED = "mix"


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))


def source_weights(sized: DataFrame) -> DataFrame:
    """One row per source: total size and weight 1, 2, 3, repeating in code-point order, null last."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    return (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long")))


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target``: the water level times the weight, capped at ``MAX_REPEAT`` times the source's size."""
    cap, everything = F.col("source_size") * MAX_REPEAT, W.partitionBy()
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = sources.withColumn("cap", cap)
    s = s.select("*", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)).alias("full"), F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)).alias("full_weight"),
                 F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("weights"))
    rest, open_weight = F.col("total") - F.col("full"), F.col("weights") - F.col("full_weight")
    # the first source (by ratio) whose cap is at or above the level of the sources that are left sets the level
    holds = F.col("cap") * open_weight >= rest * F.col("weight")
    level = F.min(F.when(holds, F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("full_weight").alias("fw"), rest.alias("rest"), open_weight.alias("open")))).over(everything)
    return (s.withColumn("level", level)
            .select("source", "source_size", F.when(F.col("cap") * F.col("level.open") <= F.col("level.rest") * F.col("weight"), F.col("cap").cast("double"))
                    .otherwise(F.col("level.rest") * F.col("weight") / F.col("level.open")).alias("target")))


def copies(rate: Column, doc_id: Column) -> Column:
    """floor(rate) plus a Bernoulli copy with the fraction's probability, drawn from the id."""
    draw = uniform01(F.coalesce(doc_id.cast("string"), F.lit("null")), SEED)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_counts(sized: DataFrame) -> DataFrame:
    """Per document: size, its source's size and target, copies, words taken. The source table is joined null-safe."""
    t = targets(source_weights(sized)).withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (sized.join(t, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
            .withColumn("copies", copies(rate, F.col("doc_id"))).withColumn("taken", F.col("copies") * F.col("size")))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: every document as many times as its rate says. The targets (a row per source) are
    written out and counted, and broadcast while they are few, so that texts stay where they are."""
    d = docs.select(*DOC_COLUMNS)
    t = small(materialize(targets(source_weights(with_sizes(d))).withColumnRenamed("source", "s"), "targets"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    n = copies(rate, F.col("doc_id")).cast("int")
    return (d.join(t, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("copy", F.explode(F.array_repeat(F.lit(0), n))).select(*DOC_COLUMNS))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
a AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS f, coalesce(sum(weight) OVER o, 0) AS fw, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (total - f)::BIGINT AS rest, (weights - fw)::BIGINT AS open FROM a WHERE cap * (weights - fw) >= (total - f) * weight ORDER BY cap / weight, fw LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cap * open <= rest * weight THEN cap::DOUBLE ELSE (rest * weight)::DOUBLE / open::DOUBLE END AS target FROM w, l),
r AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate,
        ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':mix'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""


@register("op6_source_mixing", ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document contributes to the mix; sizes go to a shared scratch table (two passes read them)."""
    sized = materialize(with_sizes(documents(spark, sf_dir)), "sizes")
    return mix_counts(sized).select("doc_id", "size", "source_size", "target", "copies", "taken")
