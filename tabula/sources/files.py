"""Sources and sinks: CSV with delimiter detection, JSON, Parquet; preview; report tables (S1-S4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tabula.operators.columns import rename_dots

DELIMITERS = (",", ";", "\t", "|")


def detect_delimiter(spark: SparkSession, path: str, n_lines: int = 20, candidates: Sequence[str] = DELIMITERS) -> str:
    """Pick the delimiter with the highest constant, non-zero count over the first lines (header included).

    Only ``n_lines`` lines reach the driver. Falls back to the most frequent candidate, then ','.
    """
    lines = [r[0] for r in spark.read.text(path).limit(n_lines).collect() if r[0]]
    times = {d: [ln.count(d) for ln in lines] for d in candidates}
    steady = {d: c[0] for d, c in times.items() if c and c[0] > 0 and len(set(c)) == 1}
    pool = steady or {d: sum(c) for d, c in times.items() if sum(c)}
    return max(pool, key=pool.get) if pool else ","


def load_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True,
             infer_schema: bool = True, schema=None, fix_names: bool = True) -> DataFrame:
    """CSV scan; ``sep=None`` detects the delimiter. Dotted column names become underscores."""
    sep = sep or detect_delimiter(spark, path)
    reader = spark.read.option("header", header).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer_schema)
    df = reader.csv(path)
    return rename_dots(df) if fix_names else df


def load_json(spark: SparkSession, path: str, multi_line: bool | None = None, fix_names: bool = True) -> DataFrame:
    """JSON scan of newline-delimited records or of one array-of-records document (detected from the first line
    with text unless ``multi_line`` says which)."""
    if multi_line is None:
        first = spark.read.text(path).where("trim(value) != ''").limit(1).collect()
        multi_line = bool(first) and first[0][0].lstrip().startswith("[")
    df = spark.read.option("multiLine", multi_line).json(path)
    return rename_dots(df) if fix_names else df


def load_data(spark: SparkSession, path: str, file_type: str = "csv", sep: str | None = None, **kw) -> DataFrame:
    """Dispatch on file type: csv, json or parquet (lazy scans)."""
    if file_type == "csv":
        return load_csv(spark, path, sep=sep, **kw)
    if file_type == "json":
        return load_json(spark, path, **kw)
    if file_type == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {file_type!r}: expected csv, json or parquet")


def preview(df: DataFrame, order_by: str | Sequence[str], n: int = 5) -> DataFrame:
    """First n rows by a key (files have no stable order, so the key defines 'first')."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write one report table (parquet or csv with header)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_report(tables: Mapping[str, DataFrame], base_path: str, fmt: str = "parquet") -> dict[str, str]:
    """The report sink: one table per sheet (summary, roc, reports, test_report) under ``base_path``."""
    return {name: write_table(df, f"{base_path.rstrip('/')}/{name}", fmt) for name, df in tables.items()}
