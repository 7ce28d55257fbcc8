"""Exact k-nearest neighbours without a cross join (M3 kernel, also used by SMOTE).

Reference rows are dealt to *cells* of about equal counts by axis-parallel splits fitted on a bounded hash-drawn sample
(``CellTree``, at most ``max_cells`` of them); every cell knows the box of all its rows.

* round 1: each query searches the cell it falls in; the k-th smallest distance found there, D, bounds its true k-th
  neighbour distance;
* round 2: it searches exactly the other cells whose box comes within D, which the tree of boxes finds without looking
  at every cell; the k nearest of both rounds are exact.

Pairs are never materialised as rows: query and reference rows meet per block through ``cogroup(...).applyInPandas``,
where a numpy kernel estimates the block of distances by a matrix product (manhattan: in single precision), computes the
exact ones of the candidates within D and emits only each query's k best. Cells of many equal rows are split into blocks
by a hash of the id. Distances accumulate dimension by dimension (the same order as a sequential SQL sum); ties are
broken by reference id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabula.session import materialize

SAMPLE_PER_CELL = 16  # rows of the sample from which a cell's bounds are taken


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two array<double> columns as a Spark expression (used for the pivot distances)."""
    if metric == "euclidean":
        s = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
        return F.sqrt(s)
    if metric == "manhattan":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)
    raise ValueError(f"unknown metric {metric}")


def as_double_array(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def _best(k: int, metric: str, qv, rv, rank_r, limit, same=None):
    """(query, reference, distance) of every query's k best within ``limit`` (per query), by (distance, reference rank).

    A fast estimate with a known error names the candidates: a matrix product (euclidean), single precision (manhattan).
    Only those get the exact distance, dimension by dimension. ``same``: pairs (rows, columns) to leave out."""
    d = rv.shape[1]
    center = np.nan_to_num(rv.mean(axis=0), nan=0.0, posinf=0.0, neginf=0.0)
    if metric == "euclidean":
        qc, rc = qv - center, rv - center
        qn, rn = (qc * qc).sum(axis=1), (rc * rc).sum(axis=1)
        est = qc @ rc.T
        est *= -2.0
        est += qn[:, None]
        est += rn
        top, slack = limit * limit, 2e-15 * (d + 8)
    else:
        qc, rc = (qv - center).astype(np.float32), np.ascontiguousarray((rv - center).astype(np.float32).T)
        qn, rn = np.abs(qc).sum(axis=1, dtype=float), np.abs(rc).sum(axis=0, dtype=float)
        est, work = np.empty((len(qc), len(rv)), dtype=np.float32), np.empty((64, 2048), dtype=np.float32)
        for i in range(0, len(qc), 64):
            for j in range(0, len(rv), 2048):  # a tile stays in the processor's cache over all dimensions
                tile = est[i:i + 64, j:j + 2048]
                w = work[:tile.shape[0], :tile.shape[1]]
                tile[:] = 0
                for x in range(d):
                    np.subtract(qc[i:i + 64, x, None], rc[x, j:j + 2048], out=w)
                    np.abs(w, out=w)
                    tile += w
        top, slack = limit, 2e-7 * (d + 8)
    far = rn[np.isfinite(rn)]
    err = slack * (qn + (far.max() if len(far) else 0.0)) + 1e-300
    top = top * (1 + 1e-9) + err
    if same is not None:
        est[same] = np.inf
    rows, cols = np.nonzero(est <= top[:, None])
    if len(rows) > 16 * k * len(qv) and k < len(rv):  # a wide limit: the k-th best of this block is a closer one
        kth = np.partition(est, k - 1, axis=1)[:, k - 1].astype(float)
        top = np.fmin(top, np.where(np.isnan(kth), np.inf, kth + 2 * err))
        rows, cols = np.nonzero(est <= top[:, None])
    if same is not None:
        ok = np.isfinite(est[rows, cols])
        rows, cols = rows[ok], cols[ok]
    dist = np.zeros(len(rows))
    for x in range(d):
        diff = qv[rows, x] - rv[cols, x]
        dist += diff * diff if metric == "euclidean" else np.abs(diff)
    if metric == "euclidean":
        dist = np.sqrt(dist)
    ok = np.isfinite(dist)
    rows, cols, dist = rows[ok], cols[ok], dist[ok]
    order = np.lexsort((rank_r[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep], dist[keep]


def _block_kernel(k: int, metric: str, exclude_self: bool, with_label: bool, cells: int = 1 << 22):
    """cogroup kernel: (queries that visit a block, references of that block) -> each query's k best. Queries go in
    slices of at most ``cells`` pairs, so memory does not grow with them."""
    def fn(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        cols = ["q_id", "r_id", "distance"] + (["r_label"] if with_label else [])
        if len(q) == 0 or len(r) == 0:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in cols})  # typed by the schema, whatever the ids are
        rv = np.vstack(r["rv"].to_numpy()).astype(float)
        qid, rid = q["q_id"].to_numpy(), r["r_id"].to_numpy()
        limit = q["D"].to_numpy().astype(float)
        rank_r = np.argsort(np.argsort(rid, kind="stable"), kind="stable").astype(float)  # id order for ties
        if exclude_self:
            codes = pd.factorize(np.concatenate([qid, rid]), use_na_sentinel=False)[0]
            qcode, rcode = codes[:len(qid)], codes[len(qid):]
        out = []
        step = max(1, cells // len(rv))
        for s in range(0, len(q), step):
            qv = np.vstack(q["qv"].iloc[s:s + step].to_numpy()).astype(float)
            same = np.nonzero(qcode[s:s + step, None] == rcode[None, :]) if exclude_self else None
            i, j, dist = _best(k, metric, qv, rv, rank_r, limit[s:s + step], same)
            out.append((i + s, j, dist))
        i, j, dist = (np.concatenate([o[x] for o in out]) for x in range(3))
        res = {"q_id": qid[i], "r_id": rid[j], "distance": dist}
        if with_label:
            res["r_label"] = r["r_label"].to_numpy()[j]
        return pd.DataFrame(res, columns=cols)

    return fn


class CellTree:
    """Axis-parallel splits of a sample into cells of equal counts; after ``fit_boxes`` every node knows the box of the
    reference rows below it."""

    def __init__(self, sample, n_cells: int):
        self.dim, self.at, self.left, self.right, self.cell = [], [], [], [], []
        self.n_cells = 0
        least = max(1, len(sample) // max(1, n_cells))

        def add(node):
            for col, v in zip((self.dim, self.at, self.left, self.right, self.cell), node):
                col.append(v)
            return len(self.dim) - 1

        stack = [(sample, None, False)]
        while stack:
            x, parent, is_right = stack.pop()
            node = add((0, 0.0, -1, -1, -1))
            if parent is not None:
                (self.right if is_right else self.left)[parent] = node
            spread = np.ptp(x, axis=0) if len(x) else np.zeros(1)
            spread = np.where(np.isfinite(spread), spread, 0.0)
            if len(x) < 2 * least or not spread.max() > 0:
                self.cell[node], self.n_cells = self.n_cells, self.n_cells + 1
                continue
            j = int(spread.argmax())
            v = x[:, j]
            t = float(np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2])
            if t == v.max():
                t = float(v[v < t].max())
            self.dim[node], self.at[node] = j, t
            stack += [(x[v > t], node, True), (x[v <= t], node, False)]
        for name in ("dim", "left", "right", "cell"):
            setattr(self, name, np.array(getattr(self, name)))
        self.at = np.array(self.at)
        self.lo = self.hi = None

    def cells_of(self, x):
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(rows := rows[self.left[node[rows]] >= 0]):
            n = node[rows]
            node[rows] = np.where(x[rows, self.dim[n]] > self.at[n], self.right[n], self.left[n])
        return self.cell[node]

    def fit_boxes(self, lo, hi) -> None:
        """``lo`` and ``hi`` by cell; a cell without rows is an empty box (+inf, -inf)."""
        self.lo, self.hi = np.empty((len(self.dim), lo.shape[1])), np.empty((len(self.dim), lo.shape[1]))
        for n in range(len(self.dim) - 1, -1, -1):  # children are numbered after their parents
            if self.left[n] < 0:
                self.lo[n], self.hi[n] = lo[self.cell[n]], hi[self.cell[n]]
            else:
                self.lo[n] = np.minimum(self.lo[self.left[n]], self.lo[self.right[n]])
                self.hi[n] = np.maximum(self.hi[self.left[n]], self.hi[self.right[n]])

    def within(self, x, limit, metric: str):
        """(row, cell) of every cell whose box has a point within ``limit`` of the row."""
        rows, cells = [], []
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, idx = stack.pop()
            part = x[idx]
            with np.errstate(invalid="ignore"):
                gap = np.maximum(np.maximum(self.lo[node] - part, part - self.hi[node]), 0.0)
                dist = np.sqrt((gap * gap).sum(axis=1)) if metric == "euclidean" else gap.sum(axis=1)
            idx = idx[~(dist > limit[idx] * (1 + 1e-9))]
            if not len(idx):
                continue
            if self.left[node] < 0:
                rows.append(idx)
                cells.append(np.full(len(idx), self.cell[node]))
            else:
                stack += [(int(self.left[node]), idx), (int(self.right[node]), idx)]
        if not rows:
            return np.empty(0, dtype=int), np.empty(0, dtype=int)
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(rows, kind="stable")
        return rows[order], cells[order]


def _boxes(ref: DataFrame, n_cells: int, width: int):
    """(lo, hi) of every cell's rows, cells x dimensions; tasks reduce their own rows first."""
    def run(batches):
        lo, hi = np.full((n_cells, width), np.inf), np.full((n_cells, width), -np.inf)
        seen = np.zeros(n_cells, dtype=bool)
        for pdf in batches:
            if not len(pdf):
                continue
            cell, x = pdf["cell"].to_numpy(), np.vstack(pdf["rv"].to_numpy()).astype(float)
            order = np.argsort(cell, kind="stable")
            cell, x = cell[order], x[order]
            first = np.nonzero(np.r_[True, cell[1:] != cell[:-1]])[0]
            at = cell[first]
            lo[at] = np.fmin(lo[at], np.fmin.reduceat(x, first, axis=0))
            hi[at] = np.fmax(hi[at], np.fmax.reduceat(x, first, axis=0))
            seen[at] = True
        for at in np.array_split(np.nonzero(seen)[0], max(1, int(seen.sum()) * width // 100_000)):
            yield pd.DataFrame({"cell": np.repeat(at, width), "dim": np.tile(np.arange(width), len(at)),
                                "lo": lo[at].reshape(-1), "hi": hi[at].reshape(-1)})

    found = (ref.select("cell", "rv").mapInPandas(run, "cell int, dim int, lo double, hi double")
             .groupBy("cell", "dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas())
    lo, hi = np.full((n_cells, width), np.inf), np.full((n_cells, width), -np.inf)
    lo[found["cell"], found["dim"]], hi[found["cell"], found["dim"]] = found["lo"], found["hi"]
    return lo, hi


def knn(queries: DataFrame, reference: DataFrame, k: int, metric: str = "euclidean",
        q_id: str = "q_id", r_id: str = "r_id", vec: str = "v", label: str | None = "label",
        exclude_self: bool = False, cell_rows: int | None = None, block_rows: int | None = None, max_cells: int = 16384,
        seed: int = 17) -> DataFrame:
    """k nearest reference rows of every query: (q_id, rank, r_id, distance[, r_label]).

    ``queries``: (q_id, v); ``reference``: (r_id, v[, label]); ``v`` is array<double>.
    ``exclude_self`` drops pairs with q_id == r_id (neighbours within one set). ``cell_rows``: reference rows of a cell,
    about (1024, or 128 a dimension); cells of more than ``block_rows`` (four times as many) are split into blocks.
    """
    spark = queries.sparkSession
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric}")
    ref_cols = [F.col(r_id).alias("r_id"), F.col(vec).alias("rv")]
    if label is not None:
        ref_cols.append(F.col(label).alias("r_label"))
    ref = reference.select(*ref_cols)
    qs = queries.select(F.col(q_id).alias("q_id"), F.col(vec).alias("qv"))
    q_type = qs.schema["q_id"].dataType.simpleString()
    r_type = ref.schema["r_id"].dataType.simpleString()
    lab_type = ref.schema["r_label"].dataType.simpleString() if label is not None else None
    out_schema = f"q_id {q_type}, r_id {r_type}, distance double" + (f", r_label {lab_type}" if label else "")

    n_ref = ref.count()
    if not n_ref:
        return spark.createDataFrame([], out_schema.replace("distance double", "rank int, distance double"))
    width = ref.select(F.size("rv")).first()[0]
    cell_rows = cell_rows or max(1024, 128 * width)
    block_rows = block_rows or 4 * cell_rows
    n_cells = int(min(max_cells, max(1, n_ref // max(cell_rows, k)), max(1, 4_000_000 // (SAMPLE_PER_CELL * width))))
    share = min(1.0, n_cells * SAMPLE_PER_CELL / n_ref) if n_cells > 1 else 0.0
    drawn = ref.where(F.pmod(F.xxhash64("r_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("rv").toPandas()
    sample = np.vstack(drawn["rv"].to_numpy()).astype(float) if len(drawn) else np.empty((0, width))
    # repeated ids are drawn together, so the sample is cut to its size
    tree = CellTree(sample[:2 * n_cells * SAMPLE_PER_CELL], n_cells)
    shipped = spark.sparkContext.broadcast(tree)

    @pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.cells_of(np.vstack(v.to_numpy()).astype(float)) if len(v) else [], dtype="int32")

    # cells are found again in every pass: a kept copy of both tables would lie on disk beside their shuffles
    ref = ref.withColumn("cell", cell_of("rv"))
    tree.fit_boxes(*_boxes(ref, tree.n_cells, width))
    # hot cells (many equal rows) are split into blocks by a hash of the id
    blocks = np.ones(tree.n_cells, dtype=np.int64)
    for c, n in ref.groupBy("cell").count().where(F.col("count") > block_rows).collect():
        blocks[c] = math.ceil(n / block_rows)
    first = np.concatenate([[0], np.cumsum(blocks)])
    layout = spark.sparkContext.broadcast((tree, first, blocks))

    @pandas_udf("int")
    def block_of(cell: pd.Series, h: pd.Series) -> pd.Series:
        _tree, first, blocks = layout.value
        c = cell.to_numpy()
        return pd.Series(first[c] + h.to_numpy() % blocks[c], dtype="int32")

    def listed(rows, cells, n, first, blocks):
        """The blocks of (row, cell) pairs, as one list a row."""
        sizes = blocks[cells]
        ids = np.repeat(first[cells], sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        ends = np.cumsum(np.bincount(np.repeat(rows, sizes), minlength=n))
        return pd.Series(np.split(ids.astype("int32"), ends[:-1]) if n else [], dtype=object)

    @pandas_udf("array<int>")
    def own_blocks(cell: pd.Series) -> pd.Series:
        _tree, first, blocks = layout.value
        return listed(np.arange(len(cell)), cell.to_numpy(), len(cell), first, blocks)

    @pandas_udf("array<int>")
    def other_blocks(v: pd.Series, limit: pd.Series, own: pd.Series) -> pd.Series:
        tree, first, blocks = layout.value
        if not len(v):
            return pd.Series([], dtype=object)
        rows, cells = tree.within(np.vstack(v.to_numpy()).astype(float), limit.to_numpy(), metric)
        more = cells != own.to_numpy()[rows]
        return listed(rows[more], cells[more], len(v), first, blocks)

    ref = ref.withColumn("block", block_of("cell", F.xxhash64("r_id"))).select("block", "r_id", "rv", *(["r_label"] if label else []))
    qs = qs.withColumn("cell", cell_of("qv"))
    kernel = _block_kernel(k, metric, exclude_self, label is not None)
    w = Window.partitionBy("q_id").orderBy("distance", "r_id")

    def run(visits: DataFrame) -> DataFrame:
        """visits: (q_id, qv, D, block) -> each query's k best within D in that block."""
        return visits.groupBy("block").cogroup(ref.groupBy("block")).applyInPandas(kernel, out_schema)

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    # round 1: the query's own cell -> an upper bound D on the k-th neighbour distance
    r1 = best(run(qs.select("q_id", "qv", F.lit(float("inf")).alias("D"), F.explode(own_blocks("cell")).alias("block"))))
    cols = ["q_id", "rank", "r_id", "distance"] + (["r_label"] if label is not None else [])
    if tree.n_cells == 1:
        return r1.select(*cols)
    r1 = materialize(r1.drop("rank"), "near")
    bound = r1.groupBy("q_id").agg(F.max("distance").alias("D"), F.count(F.lit(1)).alias("n"))
    qb = qs.join(bound, "q_id", "left").withColumn(
        "D", F.when(F.col("n") >= k, F.col("D")).otherwise(F.lit(float("inf"))))
    # round 2: every other cell whose box comes within D
    r2 = run(qb.select("q_id", "qv", "D", F.explode(other_blocks("qv", "D", "cell")).alias("block")))
    return best(r1.unionByName(r2)).select(*cols)


def knn_vote(neigh: DataFrame, weights: str = "uniform") -> DataFrame:
    """Class per query from its neighbours: majority (uniform) or 1/d weights; ties -> lowest label.

    With distance weights, neighbours at distance 0 are the only voters when present.
    """
    if weights == "uniform":
        w = F.lit(1.0)
        src = neigh
    else:
        has_zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("q_id"))
        src = neigh.withColumn("__z", has_zero)
        w = F.when(F.col("__z") == 1, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
    votes = src.groupBy("q_id", "r_label").agg(F.sum(w).alias("votes"))
    return votes.groupBy("q_id").agg(
        F.max_by(F.col("r_label"), F.struct(F.col("votes"), -F.col("r_label"))).alias("prediction"))
