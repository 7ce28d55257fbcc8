"""The training flow over the planted-label table: exact stratified 64/16/20 split -> preparation fitted on the train
part (median imputation, population scaling, mode imputation, one-hot) -> balanced weights and stratified folds on
train. Label encoding, dropped columns, binarizing and the sentinel imputer are operators of their own with their own
queries; this table has none of the columns they act on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.functions.expr import uniform01
from tabula.operators import prep, split
from tabula.operators.search import in_even_partitions
from tabula.plans.fixtures import planted
from tabula.session import materialize

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]


@dataclass
class Prepared:
    data: DataFrame        # row_id, label, split, fold (train only, else -1), weight, features
    prep: prep.PrepModel
    weight_sum: float

    def part(self, name: str) -> DataFrame:
        return self.data.where(F.col("split") == name)

    def fit_rows(self) -> DataFrame:
        """The train part in partitions of even, bounded size, for a learner's many passes."""
        return in_even_partitions(self.part("train"))


NOISE = 0.1  # share of flipped labels where a query needs a label that no tree learns exactly


def noisy(label: Column, row_id: Column, share: float) -> Column:
    """``label``, flipped for a hash-drawn share of the rows."""
    return F.when(uniform01(row_id, "noise") < share, 1 - label).otherwise(label) if share else label


def prepare(spark: SparkSession, sf_dir: str, folds: int = 3, seed: int = 42, noise: float = 0.0) -> Prepared:
    """The shared preparation: one exact split, prep fitted on train rows only, balanced weights, folds; ``noise`` is
    the share of flipped labels."""
    # the split table and the prepared table are read by several fits: each is written once to the shared folder, so
    # neither depends on an executor's cache
    base = materialize(planted(spark, sf_dir).select("row_id", *NUMERIC, *CATEGORICAL, noisy(F.col("y"), F.col("row_id"), noise).alias("label")), "base")
    base = materialize(split.three_way_split(base, "label", "row_id", 0.2, 0.2, seed), "split")
    train = base.where(F.col("split") == "train")
    model = prep.fit_prep(train, NUMERIC, CATEGORICAL)
    data = model.transform(base)
    tr = data.where(F.col("split") == "train")
    counts = split.class_counts(train, "label")  # one pass; reused by the folds and the weights
    tr = split.stratified_kfold(tr, "label", "row_id", folds, seed, counts=counts)
    tr = split.with_class_weights(tr, "label", counts=counts)
    other = (data.where(F.col("split") != "train").withColumn("fold", F.lit(-1))
             .withColumn("weight", F.lit(1.0)))
    cols = ["row_id", "label", "split", "fold", "weight", "features"]
    out = materialize(tr.select(*cols).unionByName(other.select(*cols)), "prepared")
    return Prepared(out, model, float(sum(counts.values())))
