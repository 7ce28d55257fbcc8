"""Shared pieces: the documents table, the word definition, the query registry."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009..U+000D (what ``bytes.split()`` splits on).
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows of an Arrow batch that carries whole texts, at most: what a task holds at once in the JVM and in its worker.
BATCH_ROWS = 2000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB equivalent, None where SQL cannot express it."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    """The session's shuffle width: wide plans scale with it, not with a constant of ours."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` hinted for broadcast once it is counted to have at most ``rows`` rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def arrow_pass(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` for tables that carry texts or packed arrays. The session's Arrow batches become at most
    ``BATCH_ROWS`` rows (a session setting; a smaller one stays), and a worker hands freed memory back when its task
    ends, because idle workers wait beside the running ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return df.mapInArrow(tidy, schema)


def hand_back() -> None:
    """Return what Arrow and the allocator have freed to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
