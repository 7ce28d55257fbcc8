"""Learners (M1-M8) on ``pyspark.ml`` plus kNN scoring, voting and stacking over DataFrames.

The reference's three boosting libraries are re-aimed as ``GBTClassifier`` *profiles*: their default
hyper-parameters translated to Spark parameters where an equivalent exists (trees, depth, learning
rate, row subsampling, column subsampling per node, minimum leaf size, minimum gain); parameters with
no Spark counterpart are dropped. Decision tree and logistic regression use balanced class weights
as in the reference; boosters and kNN do not.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabula.operators import boosting, ensemble, split
from tabula.operators.neighbors import knn

# Default hyper-parameters of the reference's boosters, as Spark GBT parameters.
# A: n_estimators 100, max_depth 6, learning_rate 0.3 (subsample 1, colsample 1)
# B: n_estimators 100, learning_rate 0.1, max_depth -1 with num_leaves 31 (~ depth 5), min_child_samples 20
# C: iterations 1000, depth 6, learning_rate 0.03
GBT_PROFILES = {
    "A": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3},
    "B": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "minInstancesPerNode": 20},
    "C": {"maxIter": 1000, "maxDepth": 6, "stepSize": 0.03},
}
MAX_TREE_DEPTH = 30  # Spark's limit stands in for "unlimited" depth


def decision_tree(max_depth: int | None = None, min_samples_leaf: int = 1, criterion: str = "gini",
                  seed: int = 42, weight_col: str | None = "weight", max_bins: int = 64,
                  features: str = "features", label: str = "label") -> DecisionTreeClassifier:
    """Decision tree (``max_depth=None`` -> Spark's maximum depth); balanced weights via ``weight_col``."""
    dt = DecisionTreeClassifier(featuresCol=features, labelCol=label, seed=seed, impurity=criterion,
                                maxDepth=MAX_TREE_DEPTH if max_depth in (None, -1) else int(max_depth),
                                minInstancesPerNode=int(min_samples_leaf), maxBins=max_bins)
    if weight_col:
        dt.setWeightCol(weight_col)
    return dt


def logistic_regression(C: float = 1.0, weight_sum: float = 1.0, weight_col: str | None = "weight",
                        max_iter: int = 100, features: str = "features", label: str = "label") -> LogisticRegression:
    """L2 logistic regression equivalent to ``½‖w‖² + C·Σ wᵢ·lossᵢ``: regParam = 1 / (C · Σw)."""
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (C * weight_sum),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-6)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


class BalancedLogistic:
    """``logistic_regression`` whose penalty uses the weight sum of the rows it is fitted on, whatever those are
    (one fold, an oversampled set, all rows)."""

    def __init__(self, C: float = 1.0, weight_col: str | None = "weight", **kw):
        self.C, self.weight_col, self.kw = C, weight_col, kw

    def fit(self, df: DataFrame):
        total = df.agg(F.sum(self.weight_col) if self.weight_col else F.count(F.lit(1))).head()[0] or 1.0
        return logistic_regression(self.C, float(total), self.weight_col, **self.kw).fit(df)


def booster_params(profile: str, overrides: Mapping | None = None) -> dict:
    """Spark GBT parameters of a profile with library-style overrides translated (see ``translate``)."""
    p = dict(GBT_PROFILES[profile])
    p.update(translate(overrides or {}))
    return p


def translate(params: Mapping) -> dict:
    """Library hyper-parameter names -> Spark GBT / tree parameters; names without an equivalent drop out. A bound on the
    leaves bounds the depth at which a full tree has as many."""
    out = {}
    for k, v in params.items():
        if k in ("n_estimators", "iterations"):
            out["maxIter"] = int(v)
        elif k == "learning_rate":
            out["stepSize"] = float(v)
        elif k in ("max_depth", "depth"):
            out["maxDepth"] = MAX_TREE_DEPTH if v in (None, -1) else int(v)
        elif k == "subsample":
            out["subsamplingRate"] = float(v)
        elif k == "colsample_bytree":
            out["featureSubsetStrategy"] = "all" if float(v) >= 1.0 else str(float(v))
        elif k in ("min_child_samples", "min_samples_leaf"):
            out["minInstancesPerNode"] = int(v)
        elif k == "gamma":
            out["minInfoGain"] = float(v)
        elif k == "criterion":
            out["impurity"] = str(v)
    if "num_leaves" in params:
        full = math.ceil(math.log2(max(2, int(params["num_leaves"]))))
        out["maxDepth"] = min(out.get("maxDepth", MAX_TREE_DEPTH), full)
    return out


def gbt(profile: str = "A", overrides: Mapping | None = None, seed: int = 42, features: str = "features",
        label: str = "label", validation_col: str | None = None, validation_tol: float = 0.01,
        max_bins: int = 64) -> GBTClassifier:
    """A ``GBTClassifier`` with a booster profile (logistic loss); see ``boosting`` for how it is fitted."""
    p = booster_params(profile, overrides)
    g = boosting.BoostedTrees(featuresCol=features, labelCol=label, seed=seed, lossType="logistic", maxBins=max_bins, **p)
    if validation_col:
        g.setParams(validationIndicatorCol=validation_col, validationTol=validation_tol)
    return g


def score(model, df: DataFrame, keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """(keep..., prediction int, score = P(class 1)) from a fitted ``pyspark.ml`` classifier."""
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array(F.col("probability"))[1].alias("score"))


# ---------------------------------------------------------------- kNN as a learner (M3)

def knn_scores(train: DataFrame, test: DataFrame, k: int = 3, metric: str = "euclidean", weights: str = "uniform",
               id_col: str = "row_id", features: str = "features", label: str = "label") -> DataFrame:
    """kNN class-1 probability (vote share, or 1/d weight share) and prediction for every test row."""
    def arr(df, idn):
        return df.select(F.col(id_col).alias(idn), vector_to_array(F.col(features)).alias("v"),
                         *([F.col(label).alias("label")] if idn == "r_id" else []))
    neigh = knn(arr(test, "q_id"), arr(train, "r_id"), k, metric)
    if weights == "uniform":
        w = F.lit(1.0)
    else:
        z = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("q_id"))
        neigh = neigh.withColumn("__z", z)
        w = F.when(F.col("__z") == 1, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
    agg = neigh.groupBy("q_id").agg((F.sum(w * (F.col("r_label") == 1).cast("double")) / F.sum(w)).alias("score"))
    return agg.select(F.col("q_id").alias(id_col), "score", (F.col("score") > 0.5).cast("int").alias("prediction"))


# ---------------------------------------------------------------- stacking (M8)

def stacking(train: DataFrame, valid: DataFrame, base: Mapping[str, object], fold_col: str = "fold",
             meta_C: float = 1.0, id_col: str = "row_id", features: str = "features", label: str = "label",
             k_knn: int = 3, parallelism: int = 4) -> DataFrame:
    """Stacked generalisation: out-of-fold class-1 probabilities of the base learners -> LR meta learner.

    ``base`` maps a name to a ``pyspark.ml`` estimator or the string ``"knn"``. Bases are refit on the
    whole training set to score ``valid``. Returns valid's (row_id, label, prediction, score).
    """
    from pyspark.ml.feature import VectorAssembler

    from concurrent.futures import ThreadPoolExecutor

    from pyspark import StorageLevel

    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())
    names = [f"p_{n}" for n in base]
    fit_sets = {f: boosting.Shared(train if f is None else train.where(F.col(fold_col) != f)) for f in [*folds, None]}

    def one(job):
        """Fit one base learner on one fit set and materialise its class-1 scores (runs in a driver thread)."""
        fold, name = job
        apply_df = valid if fold is None else train.where(F.col(fold_col) == fold)
        est = base[name]
        if est == "knn":
            s = knn_scores(fit_sets[fold].rows, apply_df, k_knn, id_col=id_col, features=features, label=label)
        else:
            s = score(fit_sets[fold].fit(est), apply_df, keep=(id_col,))
        s = s.select(id_col, F.col("score").alias(f"p_{name}")).persist(StorageLevel.MEMORY_AND_DISK)
        s.count()
        return job, s

    jobs = [(f, n) for f in [*folds, None] for n in base]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        done = dict(pool.map(one, jobs))

    def joined(fold):
        out = None
        for n in base:
            s = done[(fold, n)]
            out = s if out is None else out.join(s, id_col)
        return out

    oof = None
    for f in folds:
        oof = joined(f) if oof is None else oof.unionByName(joined(f))
    meta_in = VectorAssembler(inputCols=names, outputCol="meta_x").transform(
        oof.join(train.select(id_col, label), id_col))
    meta_in = split.with_class_weights(meta_in, label).persist(StorageLevel.MEMORY_AND_DISK)  # balanced, as the LR model
    meta = BalancedLogistic(meta_C, features="meta_x", label=label).fit(meta_in)
    meta_in.unpersist()
    vs = joined(None).join(valid.select(id_col, label), id_col)
    vs = VectorAssembler(inputCols=names, outputCol="meta_x").transform(vs)
    out = meta.transform(vs)
    return out.select(id_col, label, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array(F.col("probability"))[1].alias("score"))


def voting(scored_long: DataFrame, kind: str = "soft", id_col: str = "row_id") -> DataFrame:
    """Soft or hard vote over a long (row_id, model, score, prediction) table of several models."""
    if kind == "soft":
        return ensemble.vote_soft(scored_long, id_col)
    return ensemble.vote_hard(scored_long, id_col)
