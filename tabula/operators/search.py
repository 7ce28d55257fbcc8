"""Model search (T1-T8): grids, sampled randomized search with stratified folds, hold-out search
with early stopping, cross-validated comparison.

Randomness is md5-derived (repeatable). Fits are Spark jobs submitted concurrently from a small
driver thread pool; each fit's score is one scalar returned to the driver. SMOTE, when enabled, is
applied to the fitting rows of each fold only (never to the rows being scored).
"""

from __future__ import annotations

import hashlib
import itertools
import json
import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.operators import boosting, metrics
from tabula.session import discard, materialize

STAGE = 25  # rounds of the first stage of an early-stopped fit
SIDE_BY_SIDE = 8_000_000  # rows that fits side by side hold together

# The reference's discrete search spaces (configuration input of the randomized search).
SEARCH_SPACES = {
    "DecisionTree": {
        "max_depth": [3, 5, 10, None],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
        "criterion": ["gini", "entropy"],
    },
    "KNN": {
        "n_neighbors": list(range(1, 20)),
        "weights": ["uniform", "distance"],
        "metric": ["euclidean", "manhattan"],
    },
    "LogisticRegression": {
        "C": [0.01, 0.1, 1, 10, 100],
    },
    "XGBoost": {
        "n_estimators": [100, 200, 500],
        "max_depth": [3, 5, 7],
        "learning_rate": [0.01, 0.1, 0.2],
        "subsample": [0.7, 0.8, 1.0],
        "colsample_bytree": [0.7, 0.8, 1.0],
    },
    "CatBoostClassifier": {
        "iterations": [100, 200, 500],
        "depth": [4, 6, 8],
        "learning_rate": [0.01, 0.1],
    },
    "LGBMClassifier": {
        "n_estimators": [100, 200, 500],
        "max_depth": [-1, 3, 5, 7],
        "learning_rate": [0.01, 0.1],
        "num_leaves": [31, 50, 100],
    },
}

# The reference's continuous hold-out spaces: (kind, low, high[, step]).
HOLDOUT_SPACES = {
    "A": {"n_estimators": ("quniform", 50, 500, 25), "learning_rate": ("uniform", 0.01, 0.3),
          "max_depth": ("quniform", 3, 15, 1), "min_child_weight": ("quniform", 1, 10, 1),
          "subsample": ("uniform", 0.5, 1.0), "colsample_bytree": ("uniform", 0.5, 1.0),
          "gamma": ("uniform", 0, 0.5), "reg_alpha": ("uniform", 0, 1), "reg_lambda": ("uniform", 0, 1)},
    "B": {"n_estimators": ("quniform", 50, 500, 25), "learning_rate": ("uniform", 0.01, 0.3),
          "max_depth": ("quniform", 3, 15, 1), "num_leaves": ("quniform", 20, 150, 1),
          "min_child_samples": ("quniform", 5, 50, 1), "subsample": ("uniform", 0.5, 1.0),
          "colsample_bytree": ("uniform", 0.5, 1.0), "reg_alpha": ("uniform", 0, 1), "reg_lambda": ("uniform", 0, 1)},
    "C": {"iterations": ("quniform", 50, 500, 25), "learning_rate": ("uniform", 0.01, 0.3),
          "depth": ("quniform", 3, 10, 1), "l2_leaf_reg": ("uniform", 1, 10),
          "bagging_temperature": ("uniform", 0, 1), "random_strength": ("uniform", 0, 1)},
}


def _u(*parts) -> float:
    h = hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()
    return int(h[:8], 16) / 4294967296.0


# ---------------------------------------------------------------- T1

def param_grid(space: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of a discrete space, in key order."""
    keys = list(space)
    return [dict(zip(keys, combo)) for combo in itertools.product(*[list(space[k]) for k in keys])]


def sample_configs(space: Mapping[str, Sequence], n_iter: int = 20, seed: int = 0) -> list[dict]:
    """Up to ``n_iter`` distinct configurations (md5 order of seed:config); the whole grid if smaller."""
    grid = param_grid(space)
    if len(grid) <= n_iter:
        return grid
    return sorted(grid, key=lambda c: _u(seed, json.dumps(c, sort_keys=True, default=str)))[:n_iter]


def sample_space(space: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """n seeded draws from a continuous space (uniform, quantized uniform)."""
    out = []
    for t in range(n):
        cfg = {}
        for name, spec in space.items():
            u = _u(seed, t, name)
            lo, hi = spec[1], spec[2]
            v = lo + u * (hi - lo)
            if spec[0] == "quniform":
                q = spec[3]
                v = round(v / q) * q
                v = int(v) if float(q).is_integer() else v
            cfg[name] = v
        out.append(cfg)
    return out


# ---------------------------------------------------------------- scoring helper

def weighted_f1(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    row = metrics.weighted_prf(scored, [], label, prediction).first()
    return float(row["f1"]) if row and row["f1"] is not None else 0.0


def held_f1(counts: Mapping[object, Sequence], spark) -> dict:
    """Weighted F1 by key from (label, prediction, n, ...) rows by key."""
    rows = [(i, r["label"], r["prediction"], r["n"]) for i, k in enumerate(counts) for r in counts[k] if r["n"]]
    table = spark.createDataFrame(rows, "key int, label int, prediction int, n long")
    found = {r["key"]: float(r["f1"]) for r in metrics.weighted_prf(table, ["key"], count_col="n").collect()}
    return {k: found.get(i, 0.0) for i, k in enumerate(counts)}


def _fit_and_f1(estimator_fn: Callable, params: dict, fit_df: DataFrame, eval_df: DataFrame, label: str) -> float:
    model = estimator_fn(params).fit(fit_df)
    out = model.transform(eval_df).select(F.col(label).alias("label"), F.col("prediction").cast("int").alias("prediction"))
    return weighted_f1(out)


# ---------------------------------------------------------------- T2

def random_search(train: DataFrame, estimator_fn: Callable[[dict], object], space: Mapping[str, Sequence],
                  n_iter: int = 20, fold_col: str = "fold", label: str = "label", seed: int = 0,
                  resample: Callable[[DataFrame], DataFrame] | None = None, parallelism: int = 4,
                  model_name: str = "model"):
    """Randomized search with k-fold CV, weighted-F1 scoring and refit of the best configuration.

    ``train`` carries a stratified ``fold`` column; ``resample`` (e.g. SMOTE) is applied to the fitting
    rows of each fold and to the refit rows. Returns (best_model, best_params, cv_results DataFrame).
    """
    spark = train.sparkSession
    configs = sample_configs(space, n_iter, seed)
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())
    results = []
    for f in folds:  # fold by fold, so that one oversampled table lies on disk
        fit_df = train.where(F.col(fold_col) != f)
        # written once: several configurations read it side by side
        fit_df = materialize(resample(fit_df), "resampled") if resample else fit_df

        def run(i):
            return i, f, _fit_and_f1(estimator_fn, configs[i], fit_df, train.where(F.col(fold_col) == f), label)

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            results += pool.map(run, range(len(configs)))
        if resample:
            discard(fit_df)
    rows = [(model_name, i, json.dumps(configs[i], sort_keys=True, default=str), int(f), float(s)) for i, f, s in results]
    cv = spark.createDataFrame(rows, "model string, config int, params string, fold int, f1 double")
    summary = cv_summary(cv, ["model", "config", "params"])
    best = summary.orderBy(F.col("mean_f1").desc(), F.col("config")).first()
    best_params = configs[best["config"]]
    refit_df = materialize(resample(train), "resampled") if resample else train
    best_model = estimator_fn(best_params).fit(refit_df)
    return best_model, best_params, summary


def cv_summary(cv: DataFrame, keys: Sequence[str] = ("model",), value: str = "f1") -> DataFrame:
    """Mean and population std of a per-fold score per key (T7's aggregation)."""
    return cv.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"), F.stddev_pop(value).alias(f"std_{value}"),
                                 F.count(F.lit(1)).alias("n_folds"))


# ---------------------------------------------------------------- T3-T6

def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The boosted model of the first ``n`` trees."""
    sc = SparkContext._active_spark_context
    java, gateway = model._java_obj, sc._gateway
    trees, weights = java.trees(), java.treeWeights()
    kept = gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    paces = gateway.new_array(sc._jvm.double, n)
    for i in range(n):
        kept[i], paces[i] = trees[i], weights[i]
    short = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), kept, paces, java.numFeatures())
    return model._copyValues(GBTClassificationModel(short))


def best_prefix(losses: Sequence[float], patience: int = 10) -> int:
    """Rounds up to the least loss, looked for until ``patience`` rounds bring no lower one."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def staged_fit(estimator, rows: DataFrame, valid: DataFrame, patience: int = 10, stage: int = STAGE):
    """Early-stopped boosting: (model, rounds up to the least loss on ``valid``). Boosting with one seed grows the same
    first trees whatever the number of rounds, so ``stage`` rounds are fitted, then twice as many, until ``patience``
    rounds without a lower loss lie inside them or the estimator's own number is reached."""
    most = estimator.getMaxIter()
    n = min(stage, most)
    while True:
        model = estimator.copy({estimator.maxIter: n}).fit(rows)
        best = best_prefix(model.evaluateEachIteration(valid), patience)
        if n == most or n >= best + patience:
            return model, best
        n = min(2 * n, most)


def in_few_partitions(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` in partitions of about ``rows`` rows, if it has more of them: boosting runs several short jobs a tree."""
    return df.coalesce(df.count() // rows + 1)


def in_even_partitions(df: DataFrame, key: str = "row_id", rows: int = 250_000, least: int = 50_000) -> DataFrame:
    """``df`` dealt by ``key`` to partitions of at most about ``rows`` rows, three a core where that leaves ``least`` rows
    each: what a learner keeps of a partition stays small however large the table, and no core waits. Tables of less
    than two such partitions stay as they are."""
    n = df.count()
    parts = max(-(-n // rows), min(3 * df.sparkSession.sparkContext.defaultParallelism, n // least))
    return df.repartition(parts, key) if parts > 1 else df


def _work(estimator) -> int:
    """Rounds times depth, where the estimator has them."""
    return estimator.getMaxIter() * estimator.getMaxDepth() if isinstance(estimator, boosting.BoostedTrees) else 0


def at_once(n_rows: int, parallelism: int) -> int:
    """Fits to run side by side: as many as hold ``SIDE_BY_SIDE`` rows together, since each keeps its rows in memory."""
    return max(1, min(parallelism, SIDE_BY_SIDE // max(1, n_rows)))


def holdout_search(train: DataFrame, valid: DataFrame, estimator_fn: Callable[[dict], object],
                   space: Mapping[str, tuple], max_evals: int = 20, seed: int = 42, label: str = "label",
                   parallelism: int = 4, model_name: str = "model",
                   resample: Callable[[DataFrame], DataFrame] | None = None, patience: int = 10):
    """Sampled hold-out search: each trial boosts on ``train`` (after ``resample``, e.g. SMOTE), keeps the rounds up to
    the least loss on ``valid`` (``patience`` rounds without a lower one end it) and is scored there by weighted F1; the
    best configuration is refit on the same rows without early stopping. Trials over cells are one task each and share
    the cells; other estimators fit in stages. Returns (best_model, best_params, trials DataFrame)."""
    spark = train.sparkSession
    trials = sample_space(space, max_evals, seed)
    rows_ = in_few_partitions(materialize(resample(train), "resampled") if resample else train)
    valid = in_few_partitions(valid)
    shared = boosting.Shared(rows_, valid)
    estimators = [estimator_fn(c) for c in trials]
    cells = [shared.cells(e) for e in estimators]

    def run(t):
        if cells[t] is not None:
            return estimators[t].held_counts(cells[t], patience)
        model, n = staged_fit(estimators[t], rows_, valid, patience)
        out = first_trees(model, n).transform(valid).select(F.col(label).alias("label"), F.col("prediction").cast("int").alias("prediction"))
        return t, weighted_f1(out), n

    if None not in cells:
        parallelism = max(parallelism, spark.sparkContext.defaultParallelism)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        # the trials of most work first, so that none of them is left alone at the end
        order = sorted(range(len(trials)), key=lambda t: -_work(estimators[t]))
        done = dict(zip(order, pool.map(run, order)))
    f1 = held_f1({t: r for t, r in done.items() if cells[t] is not None}, spark) if any(c is not None for c in cells) else {}
    res = [done[t] if cells[t] is None else (t, f1[t], done[t][0]["n_trees"]) for t in range(len(trials))]
    rows = [(model_name, t, json.dumps(trials[t], sort_keys=True), float(f1), n) for t, f1, n in res]
    table = spark.createDataFrame(rows, "model string, trial int, params string, f1 double, n_trees int")
    best_t = max(res, key=lambda r: (r[1], -r[0]))[0]
    return shared.fit(estimators[best_t]), trials[best_t], table


# ---------------------------------------------------------------- T7

def cv_compare(train: DataFrame, estimators: Mapping[str, Callable[[], object]], fold_col: str = "fold",
               label: str = "label", parallelism: int = 4) -> DataFrame:
    """Per-fold weighted F1 of several estimators: (model, fold, f1); summarise with ``cv_summary``."""
    spark = train.sparkSession
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())
    sets = {f: boosting.Shared(train.where(F.col(fold_col) != f), train.where(F.col(fold_col) == f)) for f in folds}
    jobs = [(name, f) for f in folds for name in estimators]
    held = {}
    fits = threading.Semaphore(at_once(train.count(), parallelism))  # over rows; those over cells hold bounded memory

    def run(job):
        name, f = job
        est, rows = estimators[name](), sets[f]
        cells = rows.cells(est)
        if cells is not None:
            held[job] = est.held_counts(cells)
            return None
        with fits:
            return name, f, _fit_and_f1(lambda _p: est, {}, in_even_partitions(rows.rows), rows.held, label)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        res = [r for r in pool.map(run, jobs) if r]
    res += [(*job, f1) for job, f1 in (held_f1(held, spark) if held else {}).items()]
    return spark.createDataFrame([(n, int(f), float(s)) for n, f, s in res], "model string, fold int, f1 double")
