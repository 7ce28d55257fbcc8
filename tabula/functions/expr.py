"""Scalar column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The reference's default sentinel and its collinearity / association bands.
UNKNOWN = "unknown"
VIF_EDGES = (0.0, 5.0, 10.0, float("inf"))
VIF_LABELS = ("Acceptable", "High", "Severe")
CRAMERS_BANDS = ((0.5, "strong"), (0.1, "moderate"))  # else "weak"
PEARSON_BANDS = ((0.7, "strong"), (0.3, "moderate"))  # on |r|, else "weak"
SKEW_FLAG_LIMIT = 1.0
SKEW_FLAG_TEXT = "High skew"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qname(name: str) -> str:
    """Backtick-quote a column name so dotted names are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    return F.col(qname(name))


def hash_key(key: str | Column, seed: int | str) -> Column:
    """md5 hex of ``key:seed``; the deterministic random order shared with the SQL oracle."""
    return F.md5(F.concat(col_of(key).cast("string"), F.lit(f":{seed}")))


def uniform01(key: str | Column, seed: int | str) -> Column:
    """Uniform [0, 1) draw from the first 8 hex digits of ``hash_key`` (32 bits)."""
    h = hash_key(key, seed)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_int(key: str | Column, seed: int | str) -> Column:
    """Non-negative 32-bit integer draw from ``hash_key``."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("bigint")


def is_missing(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Null, or NaN for floating columns (pandas ``isna``)."""
    c = col_of(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def sentinel_mask(c: str | Column, sentinel=UNKNOWN) -> Column:
    """1 where the value equals the sentinel, else 0; nulls count as known (0)."""
    return F.coalesce(col_of(c) == F.lit(sentinel), F.lit(False)).cast("int")


def sentinel_to_null(c: str | Column, sentinel=UNKNOWN) -> Column:
    return F.nullif(col_of(c), F.lit(sentinel))


def binarize(c: str | Column, threshold: float = 1) -> Column:
    """``(x >= threshold)`` as 0/1 with null -> 0, the pandas ``astype(int)`` outcome."""
    return F.coalesce((col_of(c) >= F.lit(threshold)).cast("int"), F.lit(0))


def bin_label(c: str | Column, edges: Sequence[float] = VIF_EDGES, labels: Sequence[str] = VIF_LABELS) -> Column:
    """Right-closed labelled bins ``(e0, e1], (e1, e2], ...``; outside -> null."""
    c = col_of(c)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def band(c: str | Column, bands=CRAMERS_BANDS, absolute: bool = False, default: str = "weak") -> Column:
    """Strength band by descending thresholds (``>=``)."""
    v = F.abs(col_of(c)) if absolute else col_of(c)
    out = None
    for thr, lab in bands:
        out = F.when(v >= F.lit(thr), F.lit(lab)) if out is None else out.when(v >= F.lit(thr), F.lit(lab))
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(F.lit(default)))


def adjusted_skew(g1: Column, n: Column) -> Column:
    """Bias-adjusted sample skewness G1 from the population g1 (pandas / DuckDB ``skewness``)."""
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-adjusted excess kurtosis G2 from the population excess g2."""
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def feature_roles(df: DataFrame, target: str | None = "y") -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names by Spark type, excluding the target; other types are neither."""
    ex = [target] if target else []
    return numeric_columns(df, ex), string_columns(df, ex)


def categorical_indices(df: DataFrame, numeric: Sequence[str]) -> list[int]:
    """Ordinals of the columns that are not in ``numeric``."""
    return [i for i, c in enumerate(df.columns) if c not in set(numeric)]


def long_from_structs(structs: list[Column]) -> Column:
    """Explode an array of same-shaped structs: the wide-to-long step after a one-row aggregate."""
    return F.inline(F.array(*structs))


def np_round(c: str | Column, digits: int = 0) -> Column:
    """Round like NumPy / pandas: ``rint(x * 10^d) / 10^d`` (half-to-even on the binary value).

    ``F.round`` rounds the shortest decimal string half-up, which differs on values such as
    -1.2479625 whose binary value lies just below the half.
    """
    m = float(10 ** digits)
    return F.rint(col_of(c) * F.lit(m)) / F.lit(m)
