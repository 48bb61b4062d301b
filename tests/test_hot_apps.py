"""Few apps with many reviews: no row of text is moved to the task of its app."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from critiq.operators import lexicon as L
from critiq.plans import QUERIES, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["tokens_per_app", "tokens_overall", "token_totals", "lexicon_scores", "lexicon_coverage"])
def test_counts_are_dealt_by_token(spark, query):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Exchange hashpartitioning\((?:appid|source)#\d+, \d+\)[^\n]*\n[^\n]*Project \[[^\n]*(?:text|review)#", plan)
    assert re.search(r"hashpartitioning\((appid#\d+, )?token#\d+, \d+\)", plan)


def test_totals_and_missing_apps(spark):
    rows = spark.createDataFrame([("a", "one two two"), ("b", "two"), (None, "one one"), ("c", None)], "appid string, review string")
    counts = L.token_counts(rows)
    assert sorted(counts.collect()) == [("a", "one", 1, 1000 / 3), ("a", "two", 2, 2000 / 3), ("b", "two", 1, 1000.0)]
    assert sorted(L.overall_counts(counts).collect()) == [("one", 1), ("two", 3)]
    got = views.reviews(spark, SF).groupBy("appid").agg(F.count("*").alias("n"), F.max("totalEnglishReviews").alias("t")).collect()
    assert got and all(r.t == r.n + 1 for r in got)


def test_page_files_lie_in_app_folders(spark, monkeypatch, tmp_path):
    """A file per page, and a folder per app, not per page."""
    from critiq.plans import files

    monkeypatch.setattr(files, "folder", lambda *_: f"{tmp_path}/pages")
    got = QUERIES["review_page_files"](spark, SF).collect()
    pages = {(r.appid, r.page) for r in got}
    assert len(glob.glob(f"{tmp_path}/pages/*/*.txt")) == len(pages)
    assert {f.split("=")[1] for f in glob.glob(f"{tmp_path}/pages/appid=*")} == {a for a, _ in pages}
