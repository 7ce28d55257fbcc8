"""Voting over several models' scores (M7 kernel) on a long ``(row_id, model, score, prediction)`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.functions.expr import np_round


def vote_soft(long: DataFrame, row_id: str = "row_id", score: str = "score", threshold: float = 0.5,
              extra: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """Mean positive-class probability per row; class 1 when the mean reaches the threshold.

    ``digits`` rounds the mean before the comparison (makes ties at the threshold engine-independent).
    """
    mean = F.avg(score)
    g = long.groupBy(row_id, *extra).agg((np_round(mean, digits) if digits is not None else mean).alias("score"))
    return g.withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def vote_hard(long: DataFrame, row_id: str = "row_id", prediction: str = "prediction",
              extra: tuple[str, ...] = ()) -> DataFrame:
    """Majority of predicted labels per row; ties go to the lowest label (``mode`` deterministic)."""
    return long.groupBy(row_id, *extra).agg(
        F.mode(F.col(prediction), deterministic=True).cast("int").alias("prediction"),
        F.count(F.lit(1)).alias("n_votes"))
