"""Feature preparation fitted on training rows and applied to any split (F1-F9).

Fitting is one aggregate per family (modes, medians, means / population stds); the fitted state is a
handful of scalars per column that are injected as literals on transform, so applying a fitted
preparation is a narrow projection (no join, no shuffle). One-hot encoding uses ``pyspark.ml``
(``StringIndexer`` alphabetical with ``handleInvalid='keep'`` + ``OneHotEncoder(dropLast=True)``):
unseen and null categories become all-zero rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.functions.expr import UNKNOWN, qcol


# ---------------------------------------------------------------- F1 / F2 / F5

def fit_modes(df: DataFrame, cols: Sequence[str], sentinel: str | None = UNKNOWN) -> dict:
    """Most frequent value per column (ties -> smallest); the sentinel counts as missing.

    All columns are counted in one grouped pass over (column, value) cells (partial aggregation
    collapses hot values map-side), then ``min_by(value, (-count, value))`` per column: no per-column
    value map is ever merged in one task. k values reach the driver."""
    if not cols:
        return {}

    def val(c):
        v = qcol(c).cast("string")
        return F.nullif(v, F.lit(sentinel)) if sentinel is not None else v
    cells = (df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), val(c).alias("v"))
                                            for i, c in enumerate(cols)])).alias("e"))
             .where(F.col("e.v").isNotNull()).groupBy("e.ci", "e.v").count())
    best = cells.groupBy("ci").agg(F.min_by("v", F.struct((-F.col("count")).alias("n"), F.col("v"))).alias("mode"))
    got = {r["ci"]: r["mode"] for r in best.collect()}
    return {c: got.get(i) for i, c in enumerate(cols)}


def apply_modes(df: DataFrame, modes: Mapping, sentinel: str | None = UNKNOWN) -> DataFrame:
    """Replace sentinel and null by the fitted mode."""
    def val(c):
        return F.nullif(qcol(c), F.lit(sentinel)) if sentinel is not None else qcol(c)
    return df.withColumns({c: F.coalesce(val(c), F.lit(m)) for c, m in modes.items()})


def unknown_values_replace(df: DataFrame, keep: Sequence[str] = (), modes: Mapping | None = None,
                           sentinel: str = UNKNOWN) -> tuple[DataFrame, dict]:
    """Fit (when ``modes`` is None) and apply the sentinel imputer on all string columns except ``keep``."""
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in keep]
    if modes is None:
        modes = fit_modes(df, cols, sentinel)
    return apply_modes(df, modes, sentinel), dict(modes)


# ---------------------------------------------------------------- F3 / F4

def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict:
    """Exact medians (``percentile`` 0.5 with interpolation)."""
    from tabula.operators.profile import exact_quantiles

    if not cols:
        return {}
    q = exact_quantiles(df, list(cols), (0.5,))
    return {c: q[c][0] for c in cols}


def apply_medians(df: DataFrame, medians: Mapping) -> DataFrame:
    return df.withColumns({c: F.coalesce(qcol(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict:
    """(mean, population std) per column in one aggregate."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(qcol(c)).alias(f"m{i}"), F.stddev_pop(qcol(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def apply_scaler(df: DataFrame, params: Mapping) -> DataFrame:
    """(x - mean) / std with std 0 (constant column) -> divide by 1."""
    out = {}
    for c, (m, s) in params.items():
        scale = s if s not in (None, 0.0) else 1.0
        out[c] = (qcol(c).cast("double") - F.lit(m)) / F.lit(scale)
    return df.withColumns(out)


# ---------------------------------------------------------------- F6 / F7 / F9

def one_hot_pipeline(cols: Sequence[str]) -> Pipeline:
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc", handleInvalid="keep")
           for c in cols]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}__ohe" for c in cols], dropLast=True)
    return Pipeline(stages=[*idx, ohe])


def one_hot_labels(model: PipelineModel) -> dict[str, list[str]]:
    """{column: labels in index order} from the fitted indexers."""
    out = {}
    for st in model.stages:
        if hasattr(st, "labels") and hasattr(st, "getInputCol"):
            out[st.getInputCol()] = list(st.labels)
    return out


def one_hot_long(df: DataFrame, model: PipelineModel, cols: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Non-zero one-hot cells in long form (row_id, feature_value, value); unseen / null -> no rows."""
    from pyspark.ml.functions import vector_to_array

    labels = one_hot_labels(model)
    enc = model.transform(df)
    parts = []
    for c in cols:
        names = F.array(*[F.lit(f"{c}_{v}") for v in labels[c]])
        arr = vector_to_array(F.col(f"{c}__ohe"))
        parts.append(F.filter(F.arrays_zip(names.alias("n"), arr.alias("v")), lambda s: s["v"] != 0))
    cells = enc.select(qcol(row_id).alias("row_id"), F.explode(F.flatten(F.array(*parts))).alias("cell"))
    return cells.select("row_id", F.col("cell.n").alias("feature_value"), F.col("cell.v").alias("value"))


@dataclass
class PrepModel:
    """Fitted preparation: medians, scaler, modes for real nulls, one-hot pipeline and assembler."""
    numeric: list[str]
    categorical: list[str]
    medians: dict
    scaler: dict
    modes: dict
    encoder: PipelineModel | None
    features_col: str = "features"
    names: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = apply_medians(df, self.medians)
        out = apply_scaler(out, self.scaler)
        out = apply_modes(out, self.modes, sentinel=None)
        inputs = list(self.numeric)
        if self.encoder is not None:
            out = self.encoder.transform(out)
            inputs += [f"{c}__ohe" for c in self.categorical]
        out = VectorAssembler(inputCols=inputs, outputCol=self.features_col, handleInvalid="keep").transform(out)
        drop = [f"{c}__idx" for c in self.categorical] + [f"{c}__ohe" for c in self.categorical]
        return out.drop(*drop)


def fit_prep(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> PrepModel:
    """Fit on training rows: numeric median impute + population scaling; categorical mode impute + one-hot."""
    numeric, categorical = list(numeric), list(categorical)
    medians = fit_medians(df, numeric)
    imputed = apply_medians(df, medians)
    scaler = fit_scaler(imputed, numeric)
    modes = fit_modes(df, categorical, sentinel=None)
    encoder = None
    names = list(numeric)
    if categorical:
        encoder = one_hot_pipeline(categorical).fit(apply_modes(df, modes, sentinel=None))
        labels = one_hot_labels(encoder)
        names += [f"{c}_{v}" for c in categorical for v in labels[c]]
    return PrepModel(numeric, categorical, medians, scaler, modes, encoder, names=names)
