"""Ranks and percentiles by counted ranges against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from critiq.operators import ranking, stats


def frame(spark, n=3000):
    rng = np.random.default_rng(3)
    app = rng.choice(["big", "big", "big", "big", "small", None], n)
    data = pd.DataFrame({"app": app, "a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": np.full(n, 0.25)})
    data.loc[rng.random(n) < 0.2, "a"] = np.nan
    data.loc[data.app == "small", "b"] = np.nan
    rows = [(None if a is None else str(a), *[None if v != v else float(v) for v in r]) for a, *r in data.itertuples(index=False)]
    return data, spark.createDataFrame(rows, "app string, a double, b double, c double").repartition(5)


@pytest.mark.parametrize("size", [40, 1_000_000])
def test_percentiles_equal_numpy(spark, size):
    data, rows = frame(spark)
    places = {"low": 0.1, "mid": 0.5, "high": 0.93, "least": 0.0, "most": 1.0}
    found = {r.app: r for r in ranking.percentiles(rows, ["app"], ["a", "b", "c"], places, size).collect()}
    assert set(found) == {"big", "small", None}
    for app, r in found.items():
        own = data[data.app.isna() if app is None else data.app == app]
        for c in "abc":
            values = own[c].dropna()
            for name, q in places.items():
                assert r[f"{c}_{name}"] is None if values.empty else abs(r[f"{c}_{name}"] - np.quantile(values, q)) < 1e-12, (app, c, name)
    whole = ranking.percentiles(rows, [], ["a"], {"mid": 0.5}, size).first()
    assert abs(whole.a_mid - data.a.median()) < 1e-12
    assert ranking.percentiles(rows.limit(0), [], ["a"], {"mid": 0.5}, size).first().a_mid is None
    assert ranking.percentiles(rows.limit(0), ["app"], ["a"], {"mid": 0.5}, size).count() == 0


@pytest.mark.parametrize("size", [40, 1_000_000])
def test_ranks_equal_pandas(spark, size):
    data, rows = frame(spark)
    rows = rows.filter("app IS NOT NULL AND a IS NOT NULL")
    for column in "ab":
        found = pd.DataFrame([tuple(r) for r in ranking.average_rank(rows.filter(f"{column} IS NOT NULL"), column, "r", ("app",), size).select("app", column, "r").collect()], columns=["app", column, "r"])
        assert np.allclose(found.groupby("app")[column].rank(), found.r)


def plain_mann_whitney(values, high):
    ranks = pd.Series(values).rank().to_numpy()
    n1, n2 = high.sum(), (~high).sum()
    u, n = ranks[high].sum() - n1 * (n1 + 1) / 2, len(values)
    ties = sum(t**3 - t for t in pd.Series(values).value_counts())
    return n1, n2, u, (u - n1 * n2 / 2) / np.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))


@pytest.mark.parametrize("size", [40, 1_000_000])
def test_mann_whitney_by_ranges(spark, size):
    rng = np.random.default_rng(4)
    values, high = np.round(rng.normal(size=2000), 2), rng.random(2000) < 0.3
    rows = spark.createDataFrame([(float(v), bool(h)) for v, h in zip(values, high, strict=True)] + [(None, True), (1.0, None)], "v double, h boolean")
    found = stats.mann_whitney(rows, "v", "h", size).first()
    assert np.allclose([found.n1, found.n2, found.u, found.z], plain_mann_whitney(values, high))


def test_no_window_holds_all_values(spark):
    """A million different doubles in ranges of 50,000: no task sorts more than a few ranges."""
    rows = spark.range(1_000_000).select(F.rand(1).alias("v"), (F.col("id") % 3 == 0).alias("h"))
    counts = rows.groupBy("v").agg(F.count("*").alias("__n"))
    placed, cells = ranking._cut(counts.cache(), "v", [], 50_000)
    held = [r["__held"] for r in cells.collect()]
    assert len(held) == 20 and max(held) < 60_000
    found = stats.mann_whitney(rows, "v", "h", 50_000).first()
    assert found.n1 + found.n2 == 1_000_000 and abs(found.z) < 5
