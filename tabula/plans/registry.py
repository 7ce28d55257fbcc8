"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame`` plus optional oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.functions.expr import np_round
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is the DuckDB oracle (None -> rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column so both engines hash the same values."""
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = np_round(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)
