"""Exact quantiles by narrowing: hot values, outliers, coarse sketches that need many rounds or miss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabula.operators import profile

PROBS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 3001
    cols = {"even": rng.uniform(size=n), "hot": np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n) * 10),
            "ends": np.where(np.arange(n) % 5 < 2, -1.0, np.where(np.arange(n) % 5 < 4, 1.0, rng.uniform(-1, 1, n))),
            "outliers": np.exp(rng.normal(size=n) * 150), "same": np.full(n, 3.5), "two": np.where(np.arange(n) < 1500, 0.0, 1.0)}
    rows = [tuple(float(cols[c][i]) for c in cols) + (None if i % 3 else float(i), None) for i in range(n)]
    schema = ", ".join(f"{c} double" for c in cols) + ", gaps double, nothing double"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


@pytest.mark.parametrize("accuracy,map_limit", [(10, 1), (40, 30), (10_000, 100)])
def test_narrowing_equals_numpy(table, accuracy, map_limit):
    got = profile.exact_quantiles(table, table.columns, PROBS, accuracy=accuracy, map_limit=map_limit)
    pdf = table.toPandas().astype(float)
    assert got["nothing"] == [None] * len(PROBS)
    for c in table.columns[:-1]:
        assert got[c] == pytest.approx(list(np.quantile(pdf[c].dropna(), PROBS)), rel=1e-9, abs=1e-12), c


def test_a_missed_bracket_grows_back(table, monkeypatch):
    """A sketch that always answers with the two least values of the bracket."""
    def wrong(x, share, accuracy):
        return F.slice(F.array_sort(F.collect_set(x)), 1, 2)

    monkeypatch.setattr(profile.F, "percentile_approx", wrong)
    small = table.limit(40).cache()
    got = profile.exact_quantiles(small, ["even"], (0.9,), map_limit=5)
    assert got["even"] == pytest.approx([float(np.quantile(small.toPandas()["even"], 0.9))])
