"""The query catalog: importing the query modules fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.plans import q_flow, q_models, q_neighbors, q_prepare, q_profile  # noqa: F401
from tabula.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted-label lineitem -> exact stratified 64/16/20 split -> prep fitted on train -> balanced
    logistic regression -> validation and test metrics of the model in one grouped evaluation."""
    from tabula.operators import metrics, models
    from tabula.plans.learning import prepare

    p = prepare(spark, sf_dir)
    model = models.logistic_regression(C=1.0, weight_sum=p.weight_sum).fit(p.part("train"))
    scored = models.score(model, p.data.where(F.col("split") != "train"), keep=("row_id", "label", "split"))
    scored = scored.withColumn("model", F.lit("LogisticRegression")).withColumn("method", F.col("split"))
    return metrics.evaluate_models(scored, ["model", "method"])
