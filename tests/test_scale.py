"""Steps whose cost per task must not grow with the table; each test builds its own rows."""

import numpy as np
from pyspark.sql import functions as F

from tabula.functions.expr import hash_key
from tabula.operators import explain, neighbors, split


def _train_part(spark, n=20_000):
    rows = spark.range(n).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    return split.three_way_split(rows, "label", "row_id", seed=42).where("split = 'train'")


def test_cutoffs_of_rows_chosen_by_the_same_hash(spark):
    """The folds of a train part: its hashes lie above the split's cutoffs, so the band of a uniform hash misses."""
    train = _train_part(spark).persist()
    counts = split.class_counts(train, "label")
    h = hash_key("row_id", 42)
    ranked = {c: sorted(r[0] for r in train.where(F.col("label") == c).select(h).collect()) for c in counts}
    targets = {c: [1, counts[c] // 3, counts[c] // 2, counts[c]] for c in counts}
    found = split.rank_cutoffs(train, "label", h, targets, counts, band_rows=50)
    assert found == {(c, r): ranked[c][r - 1] for c in counts for r in targets[c]}


def test_band_of_folds_is_small(spark, monkeypatch):
    """No more rows than ``band_rows`` a boundary reach the window that ranks them."""
    train = _train_part(spark).persist()
    counts = split.class_counts(train, "label")
    seen = []
    number = F.row_number

    def counted():
        seen.append(1)
        return number()

    ranked = []
    collect = type(train).collect
    monkeypatch.setattr(split.F, "row_number", counted)
    monkeypatch.setattr(type(train), "collect", lambda self: ranked.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    out = split.stratified_kfold(train, "label", "row_id", 3, 42, counts=counts)
    assert seen and out.groupBy("label", "fold").count().count() == 6
    plans = [p for p in ranked if "row_number" in p]
    assert len(plans) == 1
    # every band of the plan is a fraction of the class, never 0..1
    import re
    bounds = [float(x) for x in re.findall(r"__u#\d+ >= ([0-9.E-]+)", plans[0])]
    assert bounds and min(bounds) > 0.3


def test_equal_hashes_are_ranked_together(spark):
    """Repeated keys share a hash: no bin gets smaller than they are, and the cut still is the rank's hash."""
    rows = spark.range(3000).select((F.col("id") % 4).cast("string").alias("row_id"), F.lit(1).alias("label"))
    h = hash_key("row_id", 42)
    ranked = sorted(r[0] for r in rows.select(h).collect())
    found = split.rank_cutoffs(rows, "label", h, {1: [700, 1500, 2999]}, {1: 3000}, band_rows=10)
    assert found == {(1, r): ranked[r - 1] for r in (700, 1500, 2999)}


def test_knn_of_string_ids_with_ties_and_repeats(spark):
    """Two dense values, hot cells cut into blocks and queries far from everything: equal to brute force."""
    rng = np.random.default_rng(5)
    v = np.round(np.c_[rng.integers(0, 4, 1500), rng.normal(size=(1500, 2))], 1)
    v[:400] = v[0]
    ids = [f"r{i}" for i in range(len(v))]
    df = spark.createDataFrame([(i, x.tolist(), int(x[0])) for i, x in zip(ids, v)], "id string, v array<double>, label int")
    far = spark.createDataFrame([("far", [90.0, -3.0, 2.0])], "id string, v array<double>")
    for metric in ("euclidean", "manhattan"):
        for own in (True, False):
            qs = df.select("id", "v") if own else df.where("pmod(xxhash64(id), 7) = 0").select("id", "v").unionByName(far)
            got: dict = {}
            for r in neighbors.knn(qs, df, 4, metric, "id", "id", exclude_self=own, cell_rows=32, block_rows=40).collect():
                got.setdefault(r.q_id, []).append((r["rank"], r.r_id, r.distance))
            assert len(got) == qs.count()
            for q in qs.collect():
                diff = v - np.array(q.v)
                dist = np.zeros(len(v))
                for x in range(3):
                    dist += diff[:, x] ** 2 if metric == "euclidean" else np.abs(diff[:, x])
                dist = np.sqrt(dist) if metric == "euclidean" else dist
                want = [j for j in sorted(range(len(v)), key=lambda j: (dist[j], ids[j])) if not own or ids[j] != q.id][:4]
                assert sorted(got[q.id]) == [(n + 1, ids[j], dist[j]) for n, j in enumerate(want)]


def test_cells_visited_do_not_grow_with_the_reference():
    """A neighbour's distance shrinks as rows get denser: ten times the cells, about the same number visited."""
    rng = np.random.default_rng(6)
    mean = []
    for n in (40_000, 400_000):
        x = np.c_[rng.integers(0, 11, n) / 3.0, rng.integers(0, 9, n) / 2.5, rng.normal(size=(n, 2))]
        tree = neighbors.CellTree(x[::32], n // 1000)
        cell = tree.cells_of(x)
        lo, hi = np.full((tree.n_cells, 4), np.inf), np.full((tree.n_cells, 4), -np.inf)
        np.minimum.at(lo, cell, x)
        np.maximum.at(hi, cell, x)
        tree.fit_boxes(lo, hi)
        q = x[:300]
        limit = np.array([np.sort(np.sqrt(((x - y) ** 2).sum(axis=1)))[3] for y in q])
        mean.append(len(tree.within(q, limit, "euclidean")[0]) / len(q))
    assert mean[1] < 6 and mean[1] < 2 * mean[0]


def test_permutation_repeats_run_one_after_the_other(spark):
    """Each repeat is a query of its own whose shuffle files are deleted at its end; pairs are those of both hash orders."""
    import hashlib

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    rows = [(f"k{i}", i % 2, float(i % 2), float(i * 7 % 11)) for i in range(101)]
    df = spark.createDataFrame(rows, "row_id string, label int, a double, b double")
    on = []
    run = explain._each_repeat
    try:
        explain._each_repeat = lambda s, reps, f: run(s, reps, lambda r: (on.append((r, s.conf.get(name))), f(r))[1])
        got = {r.feature: r for r in explain.permutation_importance(df, lambda c: (c["a"] > 0.5).cast("int"), ["a", "b"], n_repeats=3).collect()}
    finally:
        explain._each_repeat = run
    assert on == [(0, "true"), (1, "true"), (2, "true")] and spark.conf.get(name, None) == was

    def order(end):
        return sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}:42:{end}".encode()).hexdigest())
    drops = [1 - np.mean([s[2] == t[1] for t, s in zip(order("base"), order(r))]) for r in range(3)]
    assert abs(got["a"].importance - np.mean(drops)) < 1e-12 and abs(got["a"].importance_std - np.std(drops)) < 1e-12
    assert got["b"].importance == 0.0 and (got["a"]["rank"], got["b"]["rank"]) == (1, 2)


def test_roc_series_read_the_scored_rows_once(spark, monkeypatch):
    from tabula.operators import metrics, report

    i = F.col("id")
    scored = spark.range(977).select(F.lit("m").alias("model"), F.lit("x").alias("method"), (i % 3 == 0).cast("int").alias("label"),
                                     ((i * 37 % 100) / 100 + (i % 3 == 0).cast("int") * 0.2).alias("score"))
    write, reads = metrics.materialize, []

    def written(df, name):
        reads.append("Range (0, 977" in df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)
    for module in (metrics, report):
        monkeypatch.setattr(module, "materialize", written, raising=False)
    out = report.roc_curves_all(scored)
    got = sorted((r.threshold, r.fpr, r.tpr) for r in out.where("model = 'm' AND threshold IS NOT NULL").collect())
    assert sum(reads) == 1
    want = metrics.roc_curve(scored, ["model", "method"]).where("threshold IS NOT NULL").collect()
    assert got == sorted((r.threshold, r.fpr, r.tpr) for r in want)


def test_learner_rows_are_dealt_evenly(spark):
    """A learner's partitions stay small however few files hold the table; small tables are left alone."""
    from tabula.operators.search import at_once, in_even_partitions

    rows = spark.range(0, 4000, 1, 2).select(F.col("id").cast("string").alias("row_id"))
    dealt = in_even_partitions(rows, rows=500, least=100)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 750 and sum(sizes) == 4000
    assert in_even_partitions(rows) is rows
    assert at_once(1_000, 4) == 4 and at_once(3_000_000, 4) == 2 and at_once(10 ** 9, 4) == 1


def test_assignments_hash_a_row_once(spark):
    """The hash is computed in a step of its own, not once for every cutoff of every class."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 3).alias("label"))
    for out in (split.three_way_split(rows, "label", "row_id"), split.stratified_kfold(rows, "label", "row_id", 5),
                split.stratified_split(rows, "label", "row_id")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") == 1 and split.HASH not in out.columns


def test_sets_of_a_search_are_resampled_once(spark):
    """Each fold's set and the refit set are written once, whatever the number of configurations."""
    from tabula.operators import search

    rows = spark.range(300).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"),
                                   (F.col("id") % 3).cast("int").alias("fold"), F.lit(1.0).alias("weight"))
    ran = spark.sparkContext.accumulator(0)

    def resample(df):
        def seen(batches):
            for b in batches:
                ran.add(b.num_rows)
                yield b
        return df.mapInArrow(seen, df.schema)

    class Guess:
        def __init__(self, c):
            self.c = c

        def fit(self, df):
            df.count(), df.agg(F.sum("weight")).first()
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.lit(self.c))

    search.random_search(rows, lambda p: Guess(p["C"]), {"C": [0, 1]}, resample=resample)
    assert ran.value == 3 * 200 + 300
