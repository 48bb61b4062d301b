"""Tables that change in place: ingest with a watermark, upsert of touched folders only, lexicon files of any shape."""

import json
import os

import pytest

from critiq.operators.lexicon import read_lexicon
from critiq.sources import files
from critiq.streaming.ingest import ingest

DAY = 86_400


def drop(folder, name, app, *reviews):
    os.makedirs(folder, exist_ok=True)
    made = [{"recommendationid": i, "review": "r", "timestamp_created": day * DAY} for i, day in reviews]
    with open(f"{folder}/{name}.json", "w") as f:
        f.write(json.dumps({"appid": app, "page": 0, "json": json.dumps({"success": 1, "reviews": made})}) + "\n")


def test_late_rows_and_repeats_are_left_out_after_a_restart(spark, tmp_path):
    at = [f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint")]
    drop(at[0], "1", "a", ("x", 100), ("y", 95), ("x", 100), ("old", 10))  # one call may hold rows of any age
    ingest(spark, *at, delay="7 days")
    drop(at[0], "2", "a", ("x", 100), ("late", 93), ("edge", 94), ("new", 120), ("old", 10))
    ingest(spark, *at, delay="7 days")
    drop(at[0], "3", "a", ("y", 95), ("new", 120), ("newer", 121))
    drop(at[0], "4", "b", ("new", 120))  # another app's id
    ingest(spark, *at, delay="7 days")
    ingest(spark, *at, delay="7 days")  # nothing arrived
    assert sorted((r.appid, r.reviewId) for r in spark.read.parquet(at[1]).collect()) == [("a", "edge"), ("a", "new"), ("a", "newer"), ("a", "old"), ("a", "x"), ("a", "y"), ("b", "new")]


def table(spark, rows):
    return spark.createDataFrame(rows, "appid string, reviewId string, run string")


def files_of(path):
    return {os.path.basename(d): sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if "=" in d}


def test_upsert_leaves_other_folders_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.write_per_app(table(spark, [("a", "1", "old"), ("a", None, "old"), ("b", "1", "old"), (None, "1", "old"), ("c", "9", "old")]), path)
    before = files_of(path)
    new = table(spark, [("a", None, "new"), ("a", "2", "new"), ("d", "1", "new"), (None, "1", "new")])
    for _ in range(2):  # the second time changes nothing, as after a call that was broken off
        files.upsert_per_app(spark, path, new, ["appid", "reviewId"])
        rows = sorted(map(str, spark.read.schema(new.schema).parquet(path).select(*new.columns).collect()))
        assert rows == sorted(map(str, table(spark, [("a", "1", "old"), ("a", None, "new"), ("a", "2", "new"), ("b", "1", "old"), ("c", "9", "old"), ("d", "1", "new"), (None, "1", "new")]).collect()))
    after = files_of(path)
    assert all(after[f"appid={x}"] == before[f"appid={x}"] for x in "bc") and after["appid=a"] != before["appid=a"]
    files.upsert_per_app(spark, path, new.limit(0), ["appid", "reviewId"])
    assert files_of(path) == after


def test_upsert_reads_touched_folders_only(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    files.write_per_app(table(spark, [(f"app{i}", "1", "old") for i in range(9)]), path)
    plans, write = [], files.saved
    monkeypatch.setattr(files, "saved", lambda df, name, *by: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name, *by))[1])
    files.upsert_per_app(spark, path, table(spark, [("app3", "1", "new")]), ["appid", "reviewId"])
    assert "dynamicpruning" in plans[-1]


@pytest.fixture
def lexicons(tmp_path):
    texts = {
        "a.csv": "﻿category,token\nFlow, The \nFlow,the\nUtility,\n,of\n", "b.CSV": 'note,weight,token\n"x, ""y""\nz",1.5,The\n,bad,of\n,2,of\n', "c.csv": "token,score,category,weight\nof,3,Flow,9\nthe,,Nostalgia,9\nshort\n",
        "d.csv": "token,kind\nno,schema\n", "e.csv": "category,score\nno,1\n", "f.txt": "token,score\nno,1\n", "g.csv": "", "sub/h.csv": " Token,score\nnot named exactly,4\n",
    }
    for name, text in texts.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/lex/{name}"), exist_ok=True)
        with open(f"{tmp_path}/lex/{name}", "w", newline="") as f:
            f.write(text)
    return f"{tmp_path}/lex"


def test_lexicon_files_of_any_shape(spark, lexicons):
    categories, scores = read_lexicon(files.lexicon_rows(spark, lexicons))
    assert sorted(map(tuple, categories.collect())) == [("of", "Flow"), ("the", "Flow"), ("the", "Nostalgia")]
    assert sorted(map(tuple, scores.collect())) == [("of", 3.0), ("the", 1.5)]
