"""Differences of tables by checksums, folding without Python, samples summarised in one pass."""

import collections
import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from critiq.functions import text as X
from critiq.operators import describe, differences, sampling
from critiq.plans import QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def test_only_buckets_that_differ_are_compared(spark):
    rng = random.Random(1)
    left = [(i, rng.choice(["x", "y", None])) for i in range(3000)] + [(None, "x"), (None, "x"), (7, None)]
    right = left[10:] + [(9999, "x"), (None, "x"), (5000, None)]
    schema = "a int, b string"
    a, b = (spark.createDataFrame(rows, schema).repartition(3) for rows in (left, right))
    ours, theirs = differences.differing_parts(a, b, ["a", "b"])
    only_left, only_right = collections.Counter(left) - collections.Counter(right), collections.Counter(right) - collections.Counter(left)
    assert rows_of(ours.exceptAll(theirs)) == only_left and rows_of(theirs.exceptAll(ours)) == only_right
    assert ours.count() + theirs.count() < 60  # of 6,000: some 13 buckets of 4,096
    for same in (b, b.repartition(7), b.orderBy(F.desc("a"))):
        ours, theirs = differences.differing_parts(b, same, ["a", "b"])
        assert ours.count() == theirs.count() == 0
    ours, theirs = differences.differing_parts(a.limit(0), b, ["a", "b"], 8)
    assert ours.count() == 0 and rows_of(theirs) == collections.Counter(right)


def test_null_is_told_from_its_neighbour(spark):
    a, b = (spark.createDataFrame(rows, "a string, b string") for rows in ([("x", None)], [(None, "x")]))
    assert [p.count() for p in differences.differing_parts(a, b, ["a", "b"])] == [1, 1]


def test_equal_tables_shuffle_checksums_alone(spark):
    rows = spark.range(50_000).select(F.col("id").cast("string").alias("appid"))
    ours, theirs = differences.differing_parts(rows, rows.repartition(5), ["appid"])
    plan = ours.exceptAll(theirs)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan and "parquet" not in plan.lower()


def test_unmatched_keys(spark):
    a, b = (spark.createDataFrame(rows, "k string") for rows in ([("1",), ("1",), ("2",), (None,)], [("1",), ("3",), ("3",)]))
    assert rows_of(describe.unmatched(a, b, ["k"])) == collections.Counter([("2", "left"), (None, "left"), ("3", "right")])


def test_every_code_point_folds_as_decomposed(spark):
    points = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    texts = ["a" + "".join(points[i : i + 50]) + "z" for i in range(0, len(points), 50)] + ["plain", "", None, "½½ﬁ½", "Ünï — x"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.ascii_fold(F.col("t")).alias("x")).collect()
    for r in found:
        t = texts[r.i]
        assert r.x == (None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if c < "\x80")), t


@pytest.mark.parametrize("name", ["ascii_fold", "first_genre", "select_pairs", "qc_pairs"])
def test_folding_needs_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_samples_are_summarised_in_one_pass(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), str(i), rng.choice([1, 0, 0, None]), rng.randint(1, 900), rng.choice([None, i * 50_000])) for i in range(300)] + [(None, "n", 1, 5, 5), ("one", "o", None, 9, 9)]
    reviews = spark.createDataFrame(rows, "appid string, reviewId string, isPositive int, charLen int, timestamp_created long")
    sample = sampling.stratified_sample(reviews.filter("isPositive IS NOT NULL"), 40)
    plans, write = [], sampling.saved
    monkeypatch.setattr(sampling, "saved", lambda df, name, *by: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name, *by))[1])
    found = sampling.sampling_summary(reviews, sample.filter("appid = 'a'"), 40).collect()
    assert sum(p.count("Expand") for p in plans) == 1
    apps = {r.appid: r for r in found if r.grain == "app"}
    assert set(apps) == {"a", "b", "one"} and len(found) == 3 + 12
    for app, r in apps.items():
        own = [x for x in rows if x[0] == app]
        times = [x[4] for x in own if x[4] is not None]
        assert (r.totalReviews, r.totalPositive, r.totalSpanDays) == (len(own), sum(x[2] or 0 for x in own) if app != "one" else None, (max(times) - min(times)) // 86_400)
        assert (r.sampleReviews, r.target) == (40 if app == "a" else None, None)
    strata = [r for r in found if r.grain == "stratum"]
    assert sum(r.total for r in strata) == sum(x[2] is not None for x in rows) - 1 and {r.selected == r.target for r in strata if r.appid == "a"} == {True}
    assert all(r.selected == 0 and r.stratumSpanDays is None for r in strata if r.appid == "b")
