"""Projections, predicates and target encoding (P1-P14) as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabula.functions.expr import (
    UNKNOWN,
    VIF_EDGES,
    VIF_LABELS,
    bin_label,
    binarize,
    qcol,
    sentinel_to_null,
)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns, ignoring names that are absent (names are taken literally, dots included)."""
    return df.drop(*columns)


def extract_target(df: DataFrame, target: str, row_id: str = "row_id", label: str = "label") -> DataFrame:
    """Keep the label attached: (row_id, features..., label)."""
    feats = [c for c in df.columns if c not in (target, row_id)]
    return df.select(qcol(row_id).alias(row_id), *[qcol(c) for c in feats], qcol(target).alias(label))


def encode_target(df: DataFrame, target: str, out: str | None = None) -> DataFrame:
    """Sorted distinct target values -> 0..n-1, in the order of the column's own type; null stays null.

    The classes (one row per distinct value) are ranked and joined back; the source column is not touched unless it
    is also the output."""
    out = out or target
    classes = df.select(qcol(target).alias("__class")).where("__class IS NOT NULL").distinct()
    ranked = classes.withColumn("__code", (F.dense_rank().over(Window.orderBy("__class")) - 1).cast("int"))
    coded = df.join(ranked, qcol(target) == F.col("__class"), "left").drop("__class")
    return coded.withColumn(out, F.col("__code")).drop("__code")


def map_target(df: DataFrame, target: str, mapping: Mapping, out: str = "label_map") -> DataFrame:
    """Dictionary map of the target; values outside the mapping become null."""
    e = None
    for k, v in mapping.items():
        cond = qcol(target) == F.lit(k)
        e = F.when(cond, F.lit(v)) if e is None else e.when(cond, F.lit(v))
    return df.withColumn(out, e)


def equals_flag(df: DataFrame, target: str, positive, out: str = "label_flag") -> DataFrame:
    """``(target == positive)`` as 0/1; null -> 0."""
    return df.withColumn(out, F.coalesce((qcol(target) == F.lit(positive)).cast("int"), F.lit(0)))


def filter_sentinel(df: DataFrame, column: str, sentinel) -> DataFrame:
    """Rows whose value is not the sentinel (missing values are kept, as in pandas ``!=``)."""
    return df.where(F.coalesce(qcol(column) != F.lit(sentinel), F.lit(True)))


def binarize_columns(df: DataFrame, columns: Sequence[str], threshold: float = 1) -> DataFrame:
    """Replace each column by ``(x >= threshold)`` as 0/1 with null -> 0."""
    return df.withColumns({c: binarize(qcol(c), threshold) for c in columns})


def sentinel_to_null_columns(df: DataFrame, columns: Sequence[str], sentinel=UNKNOWN) -> DataFrame:
    return df.withColumns({c: sentinel_to_null(qcol(c), sentinel) for c in columns})


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(qcol(column).alias("value")).distinct()


def bin_labels(df: DataFrame, column: str, edges=VIF_EDGES, labels=VIF_LABELS, out: str = "bin_label") -> DataFrame:
    return df.withColumn(out, bin_label(qcol(column), edges, labels))


def misclassified(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows where the prediction differs from the true label."""
    return df.where(qcol(label) != qcol(prediction))


def rename_dots(df: DataFrame, sep: str = "_") -> DataFrame:
    """Rename ``a.b`` to ``a_b`` so downstream expressions need no backticks."""
    return df.select(*[qcol(c).alias(c.replace(".", sep)) for c in df.columns])
