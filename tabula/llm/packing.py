"""Packing into optimal length buckets.

Documents longer than ``MAX_LEN`` tokens are cut into segments of that length plus a rest, so nothing is
lost. A global histogram of segment lengths (at most ``MAX_LEN`` rows) feeds a dynamic program that chooses
``N_BUCKETS`` boundaries with the least total padding; the histogram, not the documents, reaches the driver.
Inside a bucket every segment is padded to the boundary, so a batch of a token budget holds
budget // boundary segments: a segment's batch is its rank in the bucket, in hash order, divided by that.
Ranks come from counts per (bucket, hash block) plus a rank inside the block, so no bucket is one task.

Defined cases: null and empty texts have no segment; equal rows are separate segments; an empty table gives
no buckets and no rows; with fewer distinct lengths than buckets every length is its own boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabula.functions.expr import hash_key
from tabula.llm.common import documents, register, word_count

MAX_LEN = 2048
N_BUCKETS = 8
TOKEN_BUDGET = 16384
BLOCK_DIGITS = 3  # 16**3 hash blocks per bucket
SEED = "pack"


def segments(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, segment, first_token, n_tokens): the pieces of every document with at least one token."""
    sized = docs.select("doc_id", word_count(F.col("text")).alias("size")).where("size > 0")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / max_len).cast("long")))
    return (sized.select("doc_id", "size", piece.alias("segment"))
            .select("doc_id", "segment", (F.col("segment") * max_len).alias("first_token"),
                    F.least(F.lit(max_len).cast("long"), F.col("size") - F.col("segment") * max_len).alias("n_tokens")))


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, k: int = N_BUCKETS) -> list[int]:
    """Boundaries (each an occurring length) of at most ``k`` buckets with the least padding.

    best[j] is the least cost of covering the first j distinct lengths; one layer per bucket, each layer a
    vectorised minimum over the bucket's start. Ties take the smallest start. O(k * distinct lengths squared).
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if n <= k:
        return [int(v) for v in x]
    total, mass = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    far = np.iinfo(np.int64).max // 4
    best, cuts = np.full(n + 1, far), []
    best[0] = 0
    for _ in range(k):
        layer, start = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + x[j - 1] * (total[j] - total[:j]) - (mass[j] - mass[:j])
            start[j] = int(np.argmin(cost))
            layer[j] = cost[start[j]]
        cuts.append(start)
        best = layer
    out, j = [], n
    for start in reversed(cuts):
        out.append(int(x[j - 1]))
        j = int(start[j])
    return out[::-1]


def pack(docs: DataFrame, k: int = N_BUCKETS, max_len: int = MAX_LEN, budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per segment: its bucket, padded length and batch inside the bucket."""
    seg = segments(docs, max_len)
    histogram = seg.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # at most max_len rows
    bounds = optimal_boundaries(np.array([r.n_tokens for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), k) or [max_len]
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    h = hash_key(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("segment")), SEED)
    placed = (seg.withColumn("bucket", bucket).withColumn("padded", F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1))
              .withColumn("h", h).withColumn("block", F.substring("h", 1, BLOCK_DIGITS)))
    sizes = placed.groupBy("bucket", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("bucket").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("bucket", "block", F.coalesce(before, F.lit(0)).alias("offset"))
    local = F.row_number().over(W.partitionBy("bucket", "block").orderBy("h", "doc_id", "segment")) - 1
    ranked = placed.withColumn("local", local).join(offsets, ["bucket", "block"])
    per_batch = F.floor(F.lit(budget) / F.col("padded"))
    return ranked.select("doc_id", "segment", "first_token", "n_tokens", "bucket", "padded",
                         F.floor((F.col("offset") + F.col("local")) / F.greatest(per_batch, F.lit(1))).cast("long").alias("batch"))


def _oracle(k: int = N_BUCKETS) -> str:
    """The dynamic program as one CTE per layer over the histogram; ties take the smallest start, as above."""
    layers = ["l0 AS (SELECT 0::BIGINT AS j, 0::HUGEINT AS cost)"]
    for i in range(1, k + 1):
        layers.append(f"l{i} AS (SELECT b.j, min(p.cost + b.x * (b.t - a.t) - (b.m - a.m)) AS cost, "
                      f"arg_min(p.j, (p.cost + b.x * (b.t - a.t) - (b.m - a.m)) * 100000 + p.j) AS i "
                      f"FROM l{i - 1} p JOIN c a ON a.j = p.j JOIN c b ON b.j > p.j GROUP BY b.j)")
    back = [f"e{k} AS (SELECT x AS v, i FROM l{k} JOIN c USING (j) WHERE j = (SELECT max(j) FROM c))"]
    for i in range(k - 1, 0, -1):
        back.append(f"e{i} AS (SELECT c.x AS v, l{i}.i FROM e{i + 1} JOIN l{i} ON l{i}.j = e{i + 1}.i JOIN c ON c.j = l{i}.j)")
    cut = " UNION ALL ".join(f"SELECT v FROM e{i}" for i in range(1, k + 1))
    return rf"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT doc_id, size, unnest(range(0, (size - 1) // {MAX_LEN} + 1)) AS segment FROM d WHERE size > 0),
g AS (SELECT doc_id, segment, segment * {MAX_LEN} AS first_token, least({MAX_LEN}, size - segment * {MAX_LEN}) AS n_tokens FROM s),
h AS (SELECT n_tokens AS x, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT row_number() OVER (ORDER BY x) AS j, x, sum(n) OVER (ORDER BY x) AS t, sum(n * x) OVER (ORDER BY x) AS m FROM h UNION ALL SELECT 0, 0, 0, 0),
{", ".join(layers)},
{", ".join(back)},
cuts AS (SELECT CASE WHEN (SELECT count(*) FROM h) <= {k} THEN NULL ELSE v END AS v FROM ({cut}) UNION ALL SELECT x FROM h WHERE (SELECT count(*) FROM h) <= {k}),
b AS (SELECT v AS padded, row_number() OVER (ORDER BY v) - 1 AS bucket FROM cuts WHERE v IS NOT NULL),
p AS (SELECT g.*, (SELECT min(padded) FROM b WHERE padded >= n_tokens) AS padded FROM g),
q AS (SELECT p.*, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(doc_id::VARCHAR || '/' || segment::VARCHAR || ':{SEED}'), doc_id, segment) - 1 AS r FROM p JOIN b USING (padded))
SELECT doc_id, segment, first_token, n_tokens, bucket::INT AS bucket, padded, (r // greatest({TOKEN_BUDGET} // padded, 1))::BIGINT AS batch FROM q
"""


@register("op8_length_packing", _oracle())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of all documents; a token is a word here, so the result is the same with any vocabulary files."""
    return pack(documents(spark, sf_dir))
