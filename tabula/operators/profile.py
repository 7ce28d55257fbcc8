"""Table profile: shape, describe, missing and sentinel values, moments, percentiles, histograms, box stats.

Every operator is one (or two) fused DataFrame aggregations over the whole table whose result is a
small long table. Wide one-row aggregates are turned long with ``inline(array(struct...))`` inside
Spark, so nothing but k-row results ever reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.functions.expr import (
    SKEW_FLAG_LIMIT,
    SKEW_FLAG_TEXT,
    UNKNOWN,
    adjusted_kurtosis,
    adjusted_skew,
    is_missing,
    long_from_structs,
    np_round,
    numeric_columns,
    qcol,
    sentinel_mask,
    string_columns,
)

PERCENTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)


def clean_numeric(df: DataFrame, c: str) -> Column:
    """The column as double with NaN turned into null (pandas treats NaN as missing)."""
    x = qcol(c).cast("double")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(x, F.lit(None).cast("double"))
    return x


def quantiles(x: Column, probs: Sequence[float], approx: bool = False, accuracy: int = 10000) -> Column:
    """Array of quantiles with linear interpolation (``percentile``), or the sketch (``percentile_approx``).

    ``percentile`` is exact; its buffer is a value -> count map, so it suits low/moderate-cardinality
    columns. For continuous columns on very large tables pass ``approx=True``.
    """
    if approx:
        return F.percentile_approx(x, list(probs), accuracy)
    return F.percentile(x, F.array(*[F.lit(float(p)) for p in probs]))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = 10_000,
                    map_limit: int = 100_000, extra_aggs: Sequence[Column] = (), extra_out: dict | None = None) -> dict:
    """Exact linear-interpolation quantiles {column: [value per prob]}, safe for any column cardinality.

    Columns of at most ``map_limit`` distinct values (HLL estimate) are read off by ``percentile``, whose value map
    then has no more entries than that. The others go through ``select_ranks``: no map, sort or window over a column.
    """
    xs = {c: clean_numeric(df, c) for c in cols}
    result = {c: [None] * len(probs) for c in cols}
    st = df.agg(*[F.struct(F.count(xs[c]).alias("n"), F.min(xs[c]).alias("lo"), F.max(xs[c]).alias("hi"),
                           F.approx_count_distinct(xs[c], 0.05).alias("ndv")).alias(f"s{i}")
                  for i, c in enumerate(cols)], *extra_aggs).first()
    if extra_out is not None:  # callers fuse their own one-row statistics into the first pass
        extra_out.update(st.asDict())
    filled = [(i, c) for i, c in enumerate(cols) if st[f"s{i}"]["n"]]
    small = [(i, c) for i, c in filled if st[f"s{i}"]["ndv"] <= map_limit]
    if small:
        row = df.agg(*[F.percentile(xs[c], F.array(*[F.lit(float(p)) for p in probs])).alias(f"p{i}") for i, c in small]).first()
        for i, c in small:
            result[c] = list(row[f"p{i}"])
    large = [c for i, c in filled if st[f"s{i}"]["ndv"] > map_limit]
    if large:
        ranks = {c: [(math.floor(p * (n - 1)), p * (n - 1)) for p in probs]
                 for c, n in ((c, int(st[f"s{i}"]["n"])) for i, c in filled if c in large)}
        bounds = {c: (float(st[f"s{i}"]["lo"]), float(st[f"s{i}"]["hi"]), int(st[f"s{i}"]["n"])) for i, c in filled if c in large}
        values = select_ranks(df, xs, bounds, {c: sorted({k for k, _ in ranks[c]}) for c in large}, accuracy, map_limit)
        for c in large:
            for j, (k, pos) in enumerate(ranks[c]):
                v0, v1 = values[c, k]
                result[c][j] = v0 + (v1 - v0) * (pos - k)
    return result


def select_ranks(df: DataFrame, xs: dict, bounds: dict, ranks: dict, accuracy: int, map_limit: int) -> dict:
    """{(column, k): (value of rank k, value of rank k + 1)}, ranks from 0, the last value again after the last rank.

    Distributed selection by narrowing, all targets together in one aggregate a step. ``bounds`` is
    {column: (least, greatest, count)}; a target's bracket of values starts there. Each round counts the rows below,
    inside, and at both ends of the bracket. Ranks that lie at an end are found, however many rows share that value;
    otherwise both end values are left out, so that every round makes progress. A bracket of at most ``map_limit``
    distinct values is read off by ``percentile``; any other shrinks to its quantile sketch's values around the ranks,
    about 6 / ``accuracy`` of its rows. Should the sketch miss, the counts of the next round show it, and the bracket
    grows back to the last one known to hold the ranks."""
    open_ = {(c, k): bounds[c][:2] for c in ranks for k in ranks[c]}
    sure = dict(open_)  # the last bracket known to hold the ranks
    found: dict = {}
    while open_:
        aggs = []
        for t, ((c, _k), (lo, hi)) in enumerate(open_.items()):
            x = xs[c]
            aggs += [F.count_if(x < lo).alias(f"below{t}"), F.count_if((x >= lo) & (x <= hi)).alias(f"width{t}"),
                     F.count_if(x == lo).alias(f"low{t}"), F.count_if(x == hi).alias(f"high{t}"),
                     F.min(F.when(x > lo, x)).alias(f"next{t}"), F.max(F.when(x < hi, x)).alias(f"prev{t}"),
                     F.approx_count_distinct(F.when((x > lo) & (x < hi), x), 0.05).alias(f"ndv{t}")]
        row = df.agg(*aggs).first()
        wider, inner = {}, []
        for t, ((c, k), (lo, hi)) in enumerate(open_.items()):
            below, low, high = row[f"below{t}"], row[f"low{t}"], row[f"high{t}"]
            end, last = below + row[f"width{t}"], min(k + 1, bounds[c][2] - 1)
            if k < below or last >= end:
                wider[c, k] = sure[c, k]
            elif last < below + low:
                found[c, k] = (lo, lo)
            elif k >= end - high:
                found[c, k] = (hi, hi)
            elif k < below + low:
                found[c, k] = (lo, float(row[f"next{t}"]))
            elif last >= end - high:
                found[c, k] = (float(row[f"prev{t}"]), hi)
            else:  # both ranks strictly inside; positions among the rows inside
                sure[c, k] = (float(row[f"next{t}"]), float(row[f"prev{t}"]))
                inner.append(((c, k), k - below - low, max(1, end - high - below - low - 1), row[f"ndv{t}"] <= map_limit))
        open_ = wider
        if not inner:
            continue
        aggs = []
        for t, ((c, k), at, top, exact) in enumerate(inner):
            lo, hi = sure[c, k]
            inside = F.when((xs[c] >= lo) & (xs[c] <= hi), xs[c])
            if exact:
                aggs.append(F.percentile(inside, F.array(F.lit(at / top), F.lit((at + 1) / top))).alias(f"v{t}"))
            else:
                share = [max(0.0, at / top - 3.0 / accuracy), min(1.0, (at + 1) / top + 3.0 / accuracy)]
                aggs.append(F.percentile_approx(inside, share, accuracy).alias(f"v{t}"))
        row = df.agg(*aggs).first()
        for t, (target, _at, _top, exact) in enumerate(inner):
            v = tuple(float(q) for q in row[f"v{t}"])
            if exact:
                found[target] = v
            else:
                open_[target] = v
    return found


# ---------------------------------------------------------------- A1 / A2

def shape_types(df: DataFrame) -> DataFrame:
    """(column, dtype, ordinal, n_rows, n_cols): shape and Spark types, one count job."""
    n_cols = len(df.columns)
    structs = [
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.lit(i).alias("ordinal"), F.col("n_rows"), F.lit(n_cols).alias("n_cols"))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(long_from_structs(structs))


def describe(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 %, max per numeric column, long form.

    Exact mode: the moments ride along in the first pass of ``exact_quantiles``; the k result rows are
    built from those scalars. ``approx``: one aggregate with the quantile sketch."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = clean_numeric(df, c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if approx:
            aggs.append(quantiles(x, (0.25, 0.5, 0.75), True).alias(f"q{i}"))
    if approx:
        structs = [
            F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                     F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"q{i}")[0].alias("p25"),
                     F.col(f"q{i}")[1].alias("p50"), F.col(f"q{i}")[2].alias("p75"), F.col(f"hi{i}").alias("max"))
            for i, c in enumerate(cols)]
        return df.agg(*aggs).select(long_from_structs(structs))
    mom: dict = {}
    qv = exact_quantiles(df, cols, (0.25, 0.5, 0.75), extra_aggs=aggs, extra_out=mom)

    def f(v):
        return None if v is None else float(v)
    rows = [(c, int(mom[f"n{i}"]), f(mom[f"m{i}"]), f(mom[f"s{i}"]), f(mom[f"lo{i}"]),
             *[f(v) for v in qv[c]], f(mom[f"hi{i}"])) for i, c in enumerate(cols)]
    schema = ("column_name string, count long, mean double, std double, min double, p25 double, p50 double, "
              "p75 double, max double")
    return df.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------- A3 / A4 / A5 / A6

def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, null_count) for every column (NaN counts as missing for floats)."""
    cols = list(cols) if cols is not None else df.columns
    aggs = [F.sum(is_missing(qcol(c), df.schema[c].dataType).cast("long")).alias(f"c{i}") for i, c in enumerate(cols)]
    structs = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias("null_count"))
               for i, c in enumerate(cols)]
    return df.agg(*aggs).select(long_from_structs(structs))


def missing_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with missing values: (column, missing_count, missing_pct 2 dp, rank by pct desc)."""
    cols = list(cols) if cols is not None else df.columns
    aggs = [F.count(F.lit(1)).alias("n")] + [
        F.sum(is_missing(qcol(c), df.schema[c].dataType).cast("long")).alias(f"c{i}") for i, c in enumerate(cols)]
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"),
                        F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias("missing_count"), F.col("n"))
               for i, c in enumerate(cols)]
    out = (df.agg(*aggs).select(long_from_structs(structs))
           .where(F.col("missing_count") > 0)
           .withColumn("missing_pct", np_round(F.col("missing_count") / F.col("n") * 100, 2)))
    w = Window.orderBy(F.col("missing_pct").desc(), F.col("ordinal"))  # k rows, single partition is fine
    return out.withColumn("rank", F.row_number().over(w)).select("column_name", "missing_count", "missing_pct", "rank")


def sentinel_share(df: DataFrame, cols: Sequence[str] | None = None, sentinel=UNKNOWN) -> DataFrame:
    """Share of rows equal to the sentinel per string column, only columns where it occurs."""
    cols = list(cols) if cols is not None else string_columns(df)
    aggs = [F.avg(sentinel_mask(qcol(c), sentinel)).alias(f"s{i}") for i, c in enumerate(cols)]
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("share")) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(long_from_structs(structs)).where(F.col("share") > 0)


def numeric_sentinel_share(df: DataFrame, column: str, sentinel=999) -> DataFrame:
    """Share of rows where a numeric column equals its sentinel value."""
    return df.agg(F.avg(F.coalesce(qcol(column) == F.lit(sentinel), F.lit(False)).cast("int")).alias("share")) \
        .select(F.lit(column).alias("column_name"), "share")


# ---------------------------------------------------------------- A7 / A8

def value_counts_topk(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """Top-k most frequent non-null values: (value, count, rank); ties by value."""
    top = (df.where(qcol(column).isNotNull()).groupBy(qcol(column).alias("value")).count()
           .orderBy(F.col("count").desc(), F.col("value")).limit(k))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("value"))))


def class_distribution(df: DataFrame, target: str = "y") -> DataFrame:
    """(class, count, proportion) of the target's non-null classes."""
    counts = df.where(qcol(target).isNotNull()).groupBy(qcol(target).alias("class")).count()
    return counts.withColumn("proportion", F.col("count") / F.sum("count").over(Window.partitionBy()))


# ---------------------------------------------------------------- A9 / A10 / A11

def sentinel_cooccurrence(df: DataFrame, cols: Sequence[str] | None = None, sentinel=UNKNOWN) -> DataFrame:
    """Mask^T Mask as a long table (feature_a, feature_b, count, pct), mirrored; one aggregate.

    k(k+1)/2 sum expressions: fine up to a few dozen columns (codegen limits beyond that).
    """
    cols = list(cols) if cols is not None else string_columns(df)
    masks = [sentinel_mask(qcol(c), sentinel) for c in cols]
    aggs = [F.count(F.lit(1)).alias("n")]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs += [F.sum(masks[i] * masks[j]).cast("long").alias(f"c{i}_{j}") for i, j in pairs]
    structs = []
    for i, j in pairs:
        structs.append(F.struct(F.lit(cols[i]).alias("feature_a"), F.lit(cols[j]).alias("feature_b"),
                                F.col(f"c{i}_{j}").alias("count"), F.col("n")))
        if i != j:
            structs.append(F.struct(F.lit(cols[j]).alias("feature_a"), F.lit(cols[i]).alias("feature_b"),
                                    F.col(f"c{i}_{j}").alias("count"), F.col("n")))
    return (df.agg(*aggs).select(long_from_structs(structs))
            .withColumn("pct", F.col("count") / F.col("n") * 100).drop("n"))


def target_rate_sentinel(df: DataFrame, target: str, cols: Sequence[str], sentinel=UNKNOWN) -> DataFrame:
    """Target rate (%) on sentinel rows vs known rows, plus the overall rate, per column."""
    y = qcol(target).cast("double")
    aggs = [(F.avg(y) * 100).alias("overall")]
    for i, c in enumerate(cols):
        m = sentinel_mask(qcol(c), sentinel)
        aggs += [(F.avg(F.when(m == 1, y)) * 100).alias(f"u{i}"), (F.avg(F.when(m == 0, y)) * 100).alias(f"k{i}")]
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"u{i}").alias("rate_unknown"),
                        F.col(f"k{i}").alias("rate_known"), F.col("overall").alias("rate_overall"))
               for i, c in enumerate(cols)]
    return df.agg(*aggs).select(long_from_structs(structs))


def target_rate_by_value(df: DataFrame, feature: str, target: str) -> DataFrame:
    """(value, target_rate, n) per non-null value of a feature."""
    return df.where(qcol(feature).isNotNull()).groupBy(qcol(feature).alias("value")).agg(
        F.avg(qcol(target).cast("double")).alias("target_rate"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- A12 / A13 / A14

def skew_kurtosis(df: DataFrame, features: Sequence[str], digits: int = 3) -> DataFrame:
    """Bias-adjusted skewness and excess kurtosis (pandas semantics), flag, rank by |skew| desc."""
    aggs = []
    for i, c in enumerate(features):
        x = clean_numeric(df, c)
        aggs += [F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"g1_{i}"), F.kurtosis(x).alias(f"g2_{i}")]
    structs = [F.struct(F.lit(c).alias("feature"),
                        adjusted_skew(F.col(f"g1_{i}"), F.col(f"n{i}")).alias("skew_raw"),
                        adjusted_kurtosis(F.col(f"g2_{i}"), F.col(f"n{i}")).alias("kurt_raw"))
               for i, c in enumerate(features)]
    out = df.agg(*aggs).select(long_from_structs(structs))
    w = Window.orderBy(F.abs(F.col("skew_raw")).desc_nulls_last(), F.col("feature"))
    return out.select(
        "feature",
        np_round("skew_raw", digits).alias("skewness"),
        np_round("kurt_raw", digits).alias("kurtosis"),
        F.when(F.abs(F.col("skew_raw")) > SKEW_FLAG_LIMIT, F.lit(SKEW_FLAG_TEXT)).otherwise(F.lit("")).alias("skew_flag"),
        F.row_number().over(w).alias("rank"),
    )


def percentiles(df: DataFrame, features: Sequence[str], probs: Sequence[float] = PERCENTILES,
                approx: bool = False) -> DataFrame:
    """(feature, p1, p5, ..., p99) with linear interpolation (exact unless ``approx``)."""
    names = [f"p{round(p * 100)}" for p in probs]
    if approx:
        aggs = [quantiles(clean_numeric(df, c), probs, True).alias(f"q{i}") for i, c in enumerate(features)]
        structs = [F.struct(F.lit(c).alias("feature"), *[F.col(f"q{i}")[j].alias(n) for j, n in enumerate(names)])
                   for i, c in enumerate(features)]
        return df.agg(*aggs).select(long_from_structs(structs))
    qv = exact_quantiles(df, features, probs)
    schema = "feature string, " + ", ".join(f"{n} double" for n in names)
    return df.sparkSession.createDataFrame([(c, *[None if v is None else float(v) for v in qv[c]]) for c in features], schema)


def iqr(df: DataFrame, features: Sequence[str], approx: bool = False) -> DataFrame:
    """(feature, q1, q3, iqr, quartile_deviation)."""
    q = percentiles(df, features, (0.25, 0.75), approx)
    return q.select("feature", F.col("p25").alias("q1"), F.col("p75").alias("q3"),
                    (F.col("p75") - F.col("p25")).alias("iqr"),
                    ((F.col("p75") - F.col("p25")) / 2).alias("quartile_deviation"))


# ---------------------------------------------------------------- A15 / A16 / A17

def histogram(df: DataFrame, features: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max] per feature (last bin right-closed, nulls dropped).

    (feature, bin, bin_lo, bin_hi, count) including empty bins. Two passes: a min/max aggregate
    (2 scalars per feature reach the driver) and one grouped count over the unpivoted values.
    """
    spark = df.sparkSession
    mm = df.agg(*[F.struct(F.min(clean_numeric(df, c)).alias("lo"), F.max(clean_numeric(df, c)).alias("hi")).alias(f"r{i}")
                  for i, c in enumerate(features)]).first()
    ranges = {c: (mm[f"r{i}"]["lo"], mm[f"r{i}"]["hi"]) for i, c in enumerate(features)}
    parts = []
    for c in features:
        lo, hi = ranges[c]
        if lo is None:
            continue
        x = clean_numeric(df, c)
        if hi == lo:
            b = F.lit(0)
        else:
            b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("int")
        parts.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("feature"), b.alias("bin"))))
    if not parts:
        return spark.createDataFrame([], "feature string, bin int, bin_lo double, bin_hi double, count long")
    counts = (df.select(F.explode(F.array(*parts)).alias("fb")).where(F.col("fb").isNotNull())
              .groupBy("fb.feature", "fb.bin").count())
    grid_rows = []
    for c in features:
        lo, hi = ranges[c]
        if lo is None:
            continue
        w = (hi - lo) / bins if hi != lo else 0.0
        for k in range(bins):
            grid_rows.append((c, k, lo + k * w, lo + (k + 1) * w if k < bins - 1 else float(hi)))
    grid = spark.createDataFrame(grid_rows, "feature string, bin int, bin_lo double, bin_hi double")
    # grid has features x bins rows (fixed by parameters, not data): a safe broadcast side
    return (F.broadcast(grid).join(counts, ["feature", "bin"], "left")
            .select("feature", "bin", "bin_lo", "bin_hi", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def box_stats(df: DataFrame, value: str, by: str, whisker: float = 1.5, chunk: int = 50) -> DataFrame:
    """Box-plot numbers per class: quartiles, whiskers at the extreme datum within 1.5 IQR, outliers.

    Quartiles per group come from ``exact_quantiles`` on masked columns, ``chunk`` groups a pass, so a hot class is
    never one value map in one task; the fences (a row per group) are joined back for the whiskers and outlier
    counts. A null group is left out, as a null value is."""
    x = clean_numeric(df, value)
    base = df.select(qcol(by).alias("group"), x.alias("v")).where(F.col("v").isNotNull() & F.col("group").isNotNull())
    groups = [r[0] for r in base.select("group").distinct().collect()]  # a class column: its values are the result's rows
    fences = []
    for at in range(0, len(groups), chunk):
        part = groups[at: at + chunk]
        masked = base.where(F.col("group").isin(part)).select(
            *[F.when(F.col("group") == F.lit(g), F.col("v")).alias(f"g{i}") for i, g in enumerate(part)])
        qv = exact_quantiles(masked, [f"g{i}" for i in range(len(part))], (0.25, 0.5, 0.75))
        for i, g in enumerate(part):
            q1, med, q3 = (float(q) for q in qv[f"g{i}"])
            fences.append((g, q1, med, q3, q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1)))
    kind = base.schema["group"].dataType
    schema = T.StructType([T.StructField("group", kind)] + [T.StructField(n, T.DoubleType()) for n in ("q1", "median", "q3", "lo_fence", "hi_fence")])
    j = base.join(df.sparkSession.createDataFrame(fences, schema), "group")
    inside = (F.col("v") >= F.col("lo_fence")) & (F.col("v") <= F.col("hi_fence"))
    return j.groupBy("group", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("iqr", F.col("q3") - F.col("q1"))


def scatter_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct (x, y) points with their multiplicity."""
    return df.groupBy(qcol(x).alias("x"), qcol(y).alias("y")).count()
