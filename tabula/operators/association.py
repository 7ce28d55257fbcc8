"""Association and collinearity: Pearson matrices, VIF, crosstab and Cramér's V.

Pearson pairs are fused into one aggregate of ``corr`` expressions. Categorical association runs
on a long table of cells ``(pair, a, b, count)`` built by one grouped count (all pairs in one
shuffle, partial aggregation map-side), so hot categories are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabula.functions.expr import (
    CRAMERS_BANDS,
    PEARSON_BANDS,
    VIF_EDGES,
    VIF_LABELS,
    band,
    bin_label,
    long_from_structs,
    qcol,
)
from tabula.operators.profile import clean_numeric


# ---------------------------------------------------------------- A18 / A19 / A20

def _corr_long(df: DataFrame, cols: Sequence[str], include_diag: bool, mirror: bool) -> DataFrame:
    xs = [clean_numeric(df, c) for c in cols]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i if include_diag else i + 1, len(cols))]
    aggs = [F.corr(xs[i], xs[j]).alias(f"r{i}_{j}") for i, j in pairs]
    structs = []
    for i, j in pairs:
        structs.append(F.struct(F.lit(cols[i]).alias("feature_a"), F.lit(cols[j]).alias("feature_b"),
                                F.lit(i).alias("ia"), F.lit(j).alias("ib"), F.col(f"r{i}_{j}").alias("corr")))
        if mirror and i != j:
            structs.append(F.struct(F.lit(cols[j]).alias("feature_a"), F.lit(cols[i]).alias("feature_b"),
                                    F.lit(j).alias("ia"), F.lit(i).alias("ib"), F.col(f"r{i}_{j}").alias("corr")))
    return df.agg(*aggs).select(long_from_structs(structs))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix as (feature_a, feature_b, corr), both triangles + diagonal."""
    return _corr_long(df, cols, include_diag=True, mirror=True).select("feature_a", "feature_b", "corr")


def high_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Upper-triangle pairs with |r| >= threshold, ranked by |r| desc (NaN / null never pass)."""
    out = _corr_long(df, cols, include_diag=False, mirror=False).where(F.abs(F.col("corr")) >= threshold)
    w = Window.orderBy(F.abs(F.col("corr")).desc(), F.col("ia"), F.col("ib"))
    return out.select("feature_a", "feature_b", "corr", F.row_number().over(w).alias("rank"))


def target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Point-biserial (= Pearson with a 0/1 target) per feature, banded, ranked by |r| asc."""
    y = qcol(target).cast("double")
    aggs = [F.corr(y, clean_numeric(df, c)).alias(f"r{i}") for i, c in enumerate(features)]
    structs = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("ordinal"), F.col(f"r{i}").alias("corr"))
               for i, c in enumerate(features)]
    out = df.agg(*aggs).select(long_from_structs(structs))
    w = Window.orderBy(F.abs(F.col("corr")).asc_nulls_last(), F.col("ordinal"))
    return out.select("feature", "corr", band(F.col("corr"), PEARSON_BANDS, absolute=True).alias("band"),
                      F.row_number().over(w).alias("rank"))


# ---------------------------------------------------------------- A21

def gram_matrix(df: DataFrame, features: Sequence[str], centered: bool = False) -> tuple[np.ndarray, int]:
    """XᵀX over complete rows by one aggregate (k(k+1)/2 sums); returns (G, n). Centred: the covariance sums."""
    xs = [clean_numeric(df, c) for c in features]
    complete = df.where(reduce(lambda a, b: a & b, [x.isNotNull() for x in xs], F.lit(True)))
    k = len(features)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(xs[i] * xs[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    row = complete.agg(*aggs).first()
    n = int(row["n"])
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    if centered and n:
        s = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
        g = g - np.outer(s, s) / n
    return g, n


def inflation(g: np.ndarray, tol: float = 1e-12) -> list[float]:
    """(G⁻¹)_ii · G_ii; infinite for every feature that takes part in a linear dependence.

    The Gram matrix is scaled to a unit diagonal first, so the rank test does not depend on units."""
    d = np.sqrt(np.diag(g))
    d[d == 0] = 1.0
    scaled = g / np.outer(d, d)
    if not len(scaled):
        return []
    w, v = np.linalg.eigh(scaled)
    null = w <= tol * max(w.max(), 1.0)
    if not null.any():
        return [float(x) for x in np.diag(np.linalg.inv(scaled))]
    dependent = (v[:, null] ** 2).sum(axis=1) > 1e-8
    rest = (v[:, ~null] ** 2 / w[~null]).sum(axis=1)
    return [float("inf") if dep else float(x) for dep, x in zip(dependent, rest)]


def vif(df: DataFrame, features: Sequence[str], centered: bool = False) -> DataFrame:
    """Variance inflation factor per feature with severity bins, ranked desc.

    Default is the uncentred form (regression without intercept): VIF_i = (G⁻¹)_ii · G_ii with
    G = XᵀX on complete rows. Only the k×k Gram matrix reaches the driver.
    """
    g, _ = gram_matrix(df, features, centered)
    vals = inflation(g)
    spark = df.sparkSession
    out = spark.createDataFrame([(f, i, v) for i, (f, v) in enumerate(zip(features, vals))],
                                "feature string, ordinal int, vif double")
    w = Window.orderBy(F.col("vif").desc(), F.col("ordinal"))
    return out.select("feature", "vif", bin_label(F.col("vif"), VIF_EDGES, VIF_LABELS).alias("severity"),
                      F.row_number().over(w).alias("rank"))


# ---------------------------------------------------------------- A22-A25

def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """The full contingency table (x_value, y_value, count), zero cells included; rows with a null in either are left out.

    The grid is the table itself (it is the result), built from the distinct values of the counted cells."""
    counted = _cells(df, x, y)
    values = counted.agg(F.collect_set("y_value").alias("ys"))
    grid = (counted.select("x_value").distinct().withColumn("__k", F.lit(1))
            .join(values.withColumn("__k", F.lit(1)), "__k").select("x_value", F.explode("ys").alias("y_value")))
    return (grid.join(counted, ["x_value", "y_value"], "left")
            .select("x_value", "y_value", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def _cells(df: DataFrame, x: str, y: str) -> DataFrame:
    """Non-zero contingency cells (x_value, y_value, count)."""
    return (df.where(qcol(x).isNotNull() & qcol(y).isNotNull())
            .groupBy(qcol(x).alias("x_value"), qcol(y).alias("y_value")).count())


def cramers_from_cells(cells: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b",
                       count: str = "count") -> DataFrame:
    """Cramér's V per key from long non-zero cells; chi² as in ``chi2_contingency`` (Yates when dof = 1).

    chi² = Σ O²/E − n over the non-zero cells (zero cells contribute E, which cancels); for a 2×2
    table |O − E| is the same in every cell, so the Yates form is
    max(|O − E| − ½, 0)² · n · Σ1/r · Σ1/c. dof = 0 gives chi² = 0 and V = null (0/0).
    """
    keys = list(keys)
    # the cells (one row per non-zero contingency cell) feed five branches: compute them once
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    rows = cells.groupBy(*keys, a).agg(F.sum(count).alias("__ra"))
    cols = cells.groupBy(*keys, b).agg(F.sum(count).alias("__cb"))
    rstat = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nk"), F.sum(1.0 / F.col("__ra")).alias("__ir"),
                                    F.sum("__ra").alias("__n"))
    cstat = cols.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nr"), F.sum(1.0 / F.col("__cb")).alias("__ic"))
    e = F.col("__ra") * F.col("__cb") / F.col("__n")
    terms = (cells.join(rows, keys + [a]).join(cols, keys + [b]).join(rstat.select(*keys, "__n"), keys)
             .select(*keys, (F.col(count) * F.col(count) / e).alias("__t"), F.abs(F.col(count) - e).alias("__d")))
    per = terms.groupBy(*keys).agg(F.sum("__t").alias("__s"), F.max("__d").alias("__d"))
    j = per.join(rstat, keys).join(cstat, keys)
    dof = (F.col("__nk") - 1) * (F.col("__nr") - 1)
    chi2 = (F.when(dof == 0, F.lit(0.0))
            .when(dof == 1, F.pow(F.greatest(F.col("__d") - 0.5, F.lit(0.0)), 2) * F.col("__n") * F.col("__ir") * F.col("__ic"))
            .otherwise(F.col("__s") - F.col("__n")))
    den = F.col("__n") * (F.least(F.col("__nk"), F.col("__nr")) - 1)
    v = F.when(den > 0, F.sqrt(F.greatest(chi2, F.lit(0.0)) / den))
    return j.select(*keys, chi2.alias("chi2"), v.alias("cramers_v"), F.col("__n").cast("long").alias("n"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """Cramér's V of two categoricals: (feature_a, feature_b, chi2, cramers_v, n)."""
    cells = _cells(df, x, y).select(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"),
                                      F.col("x_value").cast("string").alias("a"),
                                      F.col("y_value").cast("string").alias("b"), "count")
    return cramers_from_cells(cells, ["feature_a", "feature_b"])


def cramers_v_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """V of each categorical vs the target in one shuffle; banded, ranked ascending."""
    parts = [F.struct(F.lit(c).alias("feature"), qcol(c).cast("string").alias("a")) for c in features]
    long = (df.select(F.explode(F.array(*parts)).alias("fa"), qcol(target).cast("string").alias("b"))
            .where(F.col("fa.a").isNotNull() & F.col("b").isNotNull())
            .select("fa.feature", "fa.a", "b"))
    cells = long.groupBy("feature", "a", "b").count()
    v = cramers_from_cells(cells, ["feature"])
    order = {c: i for i, c in enumerate(features)}
    ordinal = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    w = Window.orderBy(F.col("cramers_v").asc_nulls_last(), ordinal[F.col("feature")])
    return v.select("feature", "cramers_v", band(F.col("cramers_v"), CRAMERS_BANDS).alias("band"),
                    F.row_number().over(w).alias("rank"))


def cramers_v_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All-pairs V (i <= j computed once, mirrored; diagonal computed, not set to 1)."""
    k = len(features)
    parts = [F.struct(F.lit(features[i]).alias("feature_a"), F.lit(features[j]).alias("feature_b"),
                      qcol(features[i]).cast("string").alias("a"), qcol(features[j]).cast("string").alias("b"))
             for i in range(k) for j in range(i, k)]
    cells = (df.select(F.explode(F.array(*parts)).alias("p"))
             .where(F.col("p.a").isNotNull() & F.col("p.b").isNotNull())
             .groupBy("p.feature_a", "p.feature_b", "p.a", "p.b").count())
    v = cramers_from_cells(cells, ["feature_a", "feature_b"]).select("feature_a", "feature_b", "cramers_v")
    mirrored = v.where(F.col("feature_a") != F.col("feature_b")).select(
        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "cramers_v")
    return v.unionByName(mirrored)
