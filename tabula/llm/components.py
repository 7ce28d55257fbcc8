"""Connected components by alternating large-star and small-star steps over an edge table.

Each step is a grouped minimum (pre-aggregated) and a join back on the same key, so a hub of many edges is no
task's single group. Steps are written to the shared scratch folder; the loop ends when a pair of steps leaves
the edges as they were. The driver sees one row of counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.session import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
    return r.n, r.h


def components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns a, b. Returns (node, root): every node of an edge that is not its component's least."""
    e = materialize(edges.select("a", "b").where("a != b").distinct(), "edges")
    before = _digest(e)
    while before[0]:
        e = materialize(_small_star(_large_star(e)), "edges")
        after = _digest(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
