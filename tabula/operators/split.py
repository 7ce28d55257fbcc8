"""Exact stratified splits, stratified folds and class weights (R1-R3, R5) without a per-class sort.

Randomness is an md5 hash of ``key:seed``; inside each class rows are ranked by that hash, and the
first ranks go to test (then validation), or contiguous rank ranges form the folds. The obvious
``row_number() over (partition by class order by hash)`` puts a whole class (two thirds of the table
for a binary target) in one task. Instead we find, per class, the hash value *at* each boundary
rank (an exact order statistic) and assign rows by comparing their hash with those few cutoffs:

1. one aggregate: class counts (k rows to the driver) -> allocation (largest-remainder rule);
2. the hash is uniform, so the r-th smallest of n_c lies near r / n_c; one aggregate counts the
   rows below and inside a band of +-8 sd around it; where the rows were chosen by the same hash before,
   the band misses and histograms of the hash narrow it instead;
3. only the band rows (O(sqrt n) per boundary, or one bin) are ranked by a window to pick the cutoff hash;
4. the assignment is a plain projection: ``hash <= cutoff`` comparisons, no shuffle.

The result is identical to the row_number formulation used by the SQL oracle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabula.functions.expr import hash_key, qcol

_U_DIGITS = 13  # 52 bits of the hash -> an exact double in [0, 1)
BAND_ROWS = 200_000  # rows of a band that one task ranks, at most (more only if their first 13 digits are equal)
BINS = 1024  # a power of two
HASH = "__hash"


def _u_of(h: Column) -> Column:
    return F.conv(F.substring(h, 1, _U_DIGITS), 16, 10).cast("bigint") / F.lit(float(16 ** _U_DIGITS))


def class_counts(df: DataFrame, label: str) -> dict:
    """{class: count}; one grouped count, k rows reach the driver."""
    return {r[0]: int(r[1]) for r in df.groupBy(qcol(label)).count().collect()}


def approximate_mode(counts: Mapping, n_draws: int) -> dict:
    """Per-class draws proportional to counts, floors plus largest remainders (ties: class order)."""
    total = sum(counts.values())
    keys = sorted(counts, key=lambda x: (x is None, x))
    cont = {k: n_draws * counts[k] / total for k in keys}
    floor = {k: math.floor(cont[k]) for k in keys}
    need = n_draws - sum(floor.values())
    for k in sorted(keys, key=lambda x: -(cont[x] - floor[x]))[:max(need, 0)]:
        floor[k] += 1
    return floor


def split_allocation(counts: Mapping, test_size: float) -> dict:
    """Test rows per class: n_test = ceil(test_size * n); train gets the proportional share of the rest."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    train = approximate_mode(counts, n - n_test)
    return {k: counts[k] - train[k] for k in counts}


def hashed(df: DataFrame, label: str, h: Column) -> DataFrame:
    """(class, hash, u) kept for the counting rounds and the band pass: the table is hashed once."""
    return (df.select(qcol(label).alias("__cls"), h.alias("__h")).withColumn("__u", _u_of(F.col("__h")))
            .persist(StorageLevel.MEMORY_AND_DISK))


def hashed_counts(base: DataFrame) -> dict:
    """{class: count} from a ``hashed`` table (materialises it: one scan of the source)."""
    return {r[0]: int(r[1]) for r in base.groupBy("__cls").count().collect()}


def _bin_of(brackets: Sequence[tuple], bins: int) -> tuple[Column, Column]:
    """(bracket number, bin inside it) of a hashed row; brackets of one class do not overlap. Bounds are binary fractions
    and bins a power of two, so the bin is exact."""
    inside = [(F.col("__cls") == F.lit(c)) & (F.col("__u") >= lo) & (F.col("__u") < hi) for c, lo, hi in brackets]
    return (F.coalesce(*[F.when(cond, F.lit(i)) for i, cond in enumerate(inside)]),
            F.coalesce(*[F.when(cond, F.floor((F.col("__u") - F.lit(lo)) * F.lit(bins / (hi - lo))))
                         for cond, (_c, lo, hi) in zip(inside, brackets)]))


def rank_cutoffs(df: DataFrame, label: str, h: Column, targets: Mapping, counts: Mapping,
                 max_rounds: int = 6, base: DataFrame | None = None, band_rows: int = BAND_ROWS) -> dict:
    """Exact order statistics of the hash per class: {(class, rank): hash at that rank (1-based)}.

    Rows that an earlier cut by the same hash has chosen (folds of a train part, minority rows of it) are not uniform:
    a target whose band misses is narrowed by histograms of its class instead, ``BINS`` bins a round, to a bin of at
    most ``band_rows`` rows."""
    todo = [(c, r) for c, ranks in targets.items() for r in sorted(set(ranks)) if 0 < r <= counts[c]]
    if not todo:
        return {}
    own = base is None
    if own:
        base = hashed(df, label, h)
    bands, aggs = {}, []  # target -> (lo, hi, rows below lo), lo <= u < hi
    for i, (c, r) in enumerate(todo):
        n = counts[c]
        q = r / (n + 1)
        half = 8 * math.sqrt(q * (1 - q) / max(n, 1)) + 2.0 / n
        lo, hi = max(q - half, 0.0), min(q + half, 1.0)
        inc = F.col("__cls") == F.lit(c)
        aggs += [F.sum((inc & (F.col("__u") < lo)).cast("long")).alias(f"b{i}"),
                 F.sum((inc & (F.col("__u") >= lo) & (F.col("__u") < hi)).cast("long")).alias(f"w{i}")]
        bands[(c, r)] = (lo, hi)
    row = base.agg(*aggs).first()
    open_ = {}
    for i, t in enumerate(todo):
        below, inside = int(row[f"b{i}"] or 0), int(row[f"w{i}"] or 0)
        if below < t[1] <= below + inside and inside <= band_rows:
            bands[t] = (*bands[t], below)
        else:
            open_[t] = (0.0, 1.0, 0)
    for _ in range(max_rounds - 1):
        if not open_:
            break
        brackets = list(dict.fromkeys((c, lo, hi) for (c, _r), (lo, hi, _b) in open_.items()))
        which, bin_ = _bin_of(brackets, BINS)
        hist: dict = {}
        for t, b, n in (base.select(which.alias("__t"), bin_.alias("__bin")).where(F.col("__t").isNotNull())
                        .groupBy("__t", "__bin").count().collect()):
            hist.setdefault(brackets[t], {})[int(b)] = int(n)
        left = {}
        for (c, r), (lo, hi, below) in open_.items():
            width = (hi - lo) / BINS
            for b, n in sorted(hist.get((c, lo, hi), {}).items()):
                if r <= below + n:
                    band = (lo + b * width, lo + (b + 1) * width, below)
                    if n <= band_rows or width * 16 ** _U_DIGITS < BINS:
                        bands[(c, r)] = band
                    else:
                        left[(c, r)] = band
                    break
                below += n
            else:
                raise RuntimeError(f"rank cutoffs not found for {(c, r)}")
        open_ = left
    bands.update(open_)
    conds = [F.when((F.col("__cls") == F.lit(c)) & (F.col("__u") >= bands[(c, r)][0]) & (F.col("__u") < bands[(c, r)][1]),
                    F.lit(i)) for i, (c, r) in enumerate(todo)]
    w = Window.partitionBy("__t").orderBy("__h")
    need = F.create_map(*[x for i, t in enumerate(todo) for x in (F.lit(i), F.lit(t[1] - bands[t][2]))])
    picked = (base.select("__h", F.explode(F.array_compact(F.array(*conds))).alias("__t"))
              .withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == need[F.col("__t")]).select("__t", "__h").collect())
    if own:
        base.unpersist()
    found = {todo[i]: hv for i, hv in picked}
    if len(found) < len(todo):
        raise RuntimeError(f"rank cutoffs not found for {[t for t in todo if t not in found]}")
    return found


def _bucket_expr(label: str, h: Column, cutoffs: Mapping) -> Column:
    """Number of a class's cutoffs strictly below the row's hash (0 = first rank range)."""
    expr = F.lit(0)
    by_class: dict = {}
    for (c, r), hv in cutoffs.items():
        by_class.setdefault(c, []).append(hv)
    out = None
    for c, hs in by_class.items():
        s = sum(((h > F.lit(v)).cast("int") for v in hs), F.lit(0))
        out = F.when(qcol(label) == F.lit(c), s) if out is None else out.when(qcol(label) == F.lit(c), s)
    return out.otherwise(expr) if out is not None else expr


def _assigned(df: DataFrame, h: Column, out: str, expr: Column) -> DataFrame:
    """``df`` with ``out`` = ``expr`` over the hash column, which is computed once a row however many cutoffs it meets."""
    return df.withColumn(HASH, h).withColumn(out, expr).drop(HASH)


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Exact stratified train/test split: per class the ``alloc`` first rows in hash order are 'test'."""
    h = hash_key(qcol(key), seed)
    base = hashed(df, label, h)
    counts = hashed_counts(base)
    alloc = split_allocation(counts, test_size)
    cut = rank_cutoffs(df, label, h, {c: [alloc[c]] for c in counts}, counts, base=base)
    base.unpersist()
    bucket = _bucket_expr(label, F.col(HASH), cut)
    # classes whose whole count goes to test have no boundary inside the class
    all_test = [c for c in counts if alloc[c] >= counts[c]]
    is_test = bucket == 0
    zero = [c for c in counts if alloc[c] == 0]
    if zero:
        is_test = is_test & ~qcol(label).isin(zero)
    if all_test:
        is_test = is_test | qcol(label).isin(all_test)
    return _assigned(df, h, out, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def three_way_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, val_size: float = 0.2,
                    seed: int = 42, out: str = "split") -> DataFrame:
    """Test = first ranks, validation = next ranks (the second split of the remaining rows), rest train."""
    h = hash_key(qcol(key), seed)
    base = hashed(df, label, h)
    counts = hashed_counts(base)
    test = split_allocation(counts, test_size)
    rest = {c: counts[c] - test[c] for c in counts}
    val = split_allocation(rest, val_size) if sum(rest.values()) else {c: 0 for c in counts}
    targets = {c: [r for r in (test[c], test[c] + val[c]) if 0 < r < counts[c]] for c in counts}
    cut = rank_cutoffs(df, label, h, targets, counts, base=base)
    base.unpersist()
    rank_bound = {}
    for c in counts:
        bounds = sorted(r for r in (test[c], test[c] + val[c]) if 0 < r < counts[c])
        rank_bound[c] = bounds
    # translate bucket numbers to names per class (boundaries that coincide or sit at the ends drop out)
    out_expr = None
    for c in counts:
        hs = [cut[(c, r)] for r in rank_bound[c]]
        rank_of = F.lit(0)
        for hv in hs:
            rank_of = rank_of + (F.col(HASH) > F.lit(hv)).cast("int")
        names = []
        edges = [0] + rank_bound[c] + [counts[c]]
        for lo_r, hi_r in zip(edges[:-1], edges[1:]):
            mid = hi_r  # the last rank of this range decides its name
            names.append("test" if mid <= test[c] else ("validation" if mid <= test[c] + val[c] else "train"))
        e = None
        for b, name in enumerate(names):
            e = F.when(rank_of == b, F.lit(name)) if e is None else e.when(rank_of == b, F.lit(name))
        cond = qcol(label) == F.lit(c)
        out_expr = F.when(cond, e) if out_expr is None else out_expr.when(cond, e)
    return _assigned(df, h, out, out_expr)


def stratified_kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, out: str = "fold",
                     counts: Mapping | None = None) -> DataFrame:
    """Fold id = floor((rank - 1) * k / n_class) for the hash rank inside each class: every fold holds
    each class's count split as evenly as possible (sizes differ by at most one).
    ``counts``: class counts when the caller already has them (saves a pass)."""
    counts = dict(counts) if counts is not None else class_counts(df, label)
    h = hash_key(qcol(key), seed)
    targets = {c: [_ceil_div((j + 1) * counts[c], k) for j in range(k - 1)] for c in counts}
    cut = rank_cutoffs(df, label, h, targets, counts)
    e = None
    for c in counts:
        fold = F.lit(0)
        for j in range(k - 1):
            r = _ceil_div((j + 1) * counts[c], k)
            if r < counts[c]:
                fold = fold + (F.col(HASH) > F.lit(cut[(c, r)])).cast("int")
        cond = qcol(label) == F.lit(c)
        e = F.when(cond, fold) if e is None else e.when(cond, fold)
    return _assigned(df, h, out, e.cast("int"))


def _ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """'balanced' weights n / (k * n_c) as a small (class, count, weight) table."""
    counts = df.groupBy(qcol(label).alias("class")).count()
    w = Window.partitionBy()
    return counts.withColumn("weight", F.sum("count").over(w) / (F.count(F.lit(1)).over(w) * F.col("count")))


def with_class_weights(df: DataFrame, label: str, out: str = "weight", counts: Mapping | None = None) -> DataFrame:
    """Attach balanced weights as a literal map (k classes; no join)."""
    counts = dict(counts) if counts is not None else class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    m = F.create_map(*[x for c, v in counts.items() for x in (F.lit(c), F.lit(n / (k * v)))])
    return df.withColumn(out, m[qcol(label)])
