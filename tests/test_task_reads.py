"""What the largest task reads: no app's texts or counts go to one task."""

import re

import pytest
from pyspark.sql import functions as F

from critiq.operators import lexicon as L
from critiq.plans import QUERIES, views

SF = "/root/testdata/sf0.001"


@pytest.fixture
def dealt(spark):
    """Nothing is broadcast unless the code asks for it, and partitions are left as they are dealt."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def exchanges(df) -> list[str]:
    """The columns of each exchange by hash, in the plan's order."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]


@pytest.mark.parametrize("query", ["tokens_overall", "stemmed_tokens"])
def test_overall_counts_are_dealt_by_token_alone(dealt, query):
    found = exchanges(QUERIES[query](dealt, SF))
    assert "token" in found and not [k for k in found if k not in ("token", "doc_id")]


@pytest.mark.parametrize("options", [{}, {"digits": False, "stem": True}])
def test_corpus_counts_are_the_apps_counts_summed(spark, options):
    rows = spark.createDataFrame([("a", "One two, TWO 77 x"), ("b", "two runs 77"), (None, "one one"), ("c", None), ("d", "")], "appid string, review string")
    got, want = L.corpus_counts(rows, **options), L.overall_counts(L.token_counts(rows, **options))
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert dict(got.collect())["two"] == 3 and dict(got.collect())["one"] == 1


@pytest.mark.parametrize("query", ["lexicon_coverage", "token_totals", "tokens_overall", "tokens_per_app", "stemmed_tokens", "category_rates", "lexicon_scores"])
def test_no_text_is_moved_to_its_label(dealt, query):
    plan = QUERIES[query](dealt, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and not re.search(r"Exchange hashpartitioning\([^\n]*\n[^\n]*Project \[[^\n]*text#", plan)
    assert not re.search(r"SortMergeJoin \[doc_id", plan)


@pytest.mark.parametrize("most", [1_000_000, 1, 0])
def test_repeated_labels_repeat_their_document(spark, tmp_path, monkeypatch, most):
    docs = [(1, "Ab cd", "en", "s"), (2, "cd", "de", "s"), (3, "ef", "en", None), (4, None, None, "t"), (5, "cd gh", "en", "t"), (None, "zz", "en", "t")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1), (1, 0), (1, None), (2, 1), (3, 0), (3, 1), (5, 1), (5, 1), (9, 0), (9, 0), (None, 1), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(views, "REPEATS_BROADCAST", most)
    columns = ["appid", "review", "lang"]
    got, want = views.review_texts(spark, str(tmp_path)), views.reviews(spark, str(tmp_path)).select(columns)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.token: r["count"] for r in QUERIES["tokens_overall"](spark, str(tmp_path)).collect()} == {"ab": 3, "cd": 6, "gh": 2, "zz": 1}


def test_counts_of_one_app_are_spread(dealt, tmp_path):
    dealt.range(400).selectExpr("id AS doc_id", "concat('w', id, ' v', id % 7) AS text", "'en' AS lang", "'one' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    dealt.range(400).selectExpr("id AS doc_id", "1 AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    counts = L.token_counts(views.review_texts(dealt, str(tmp_path)))
    rows = [r["count"] for r in counts.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 407 and max(rows) < 204
    assert QUERIES["token_totals"](dealt, str(tmp_path)).collect() == [("one", 800, 407)]


def test_coverage_is_dealt_by_token_alone(dealt, tmp_path):
    dealt.range(50).selectExpr("id AS doc_id", "concat('the la w', id) AS text", "'en' AS lang", "'one' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    dealt.range(50).selectExpr("id AS doc_id", "1 AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    coverage = QUERIES["lexicon_coverage"](dealt, str(tmp_path))
    assert "token" in exchanges(coverage) and not {"appid", "source", "doc_id"} & set(", ".join(exchanges(coverage)).split(", "))
    assert {r.category: r.seen for r in coverage.collect()} == {"Flow": 2, "Utility": 1, "Nostalgia": 0}


def moved(df) -> int:
    """Rows that its exchanges have written; without adaptive plans, the plan that has run is the one asked for."""
    rows, nodes = df.collect(), [df._jdf.queryExecution().executedPlan()]
    assert rows
    total = 0
    while nodes:
        node = nodes.pop()
        children, written = node.children(), node.metrics().get("shuffleRecordsWritten")
        nodes += [children.apply(i) for i in range(children.size())]
        total += written.get().value() if written.isDefined() else 0
    return total


def test_coverage_moves_no_word_beyond_the_lexicon(dealt, tmp_path):
    dealt.range(0, 2000, 1, 3).selectExpr("id AS doc_id", "concat('The la w', id, ' x', id, ' for the') AS text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    dealt.range(2000).selectExpr("id AS doc_id", "1 AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    coverage = QUERIES["lexicon_coverage"](dealt, str(tmp_path))
    assert moved(coverage) < 200
    assert {r.category: (r.tokens, r.seen, r.unreachable) for r in coverage.collect()} == {"Flow": (5, 2, 0), "Utility": (4, 1, 0), "Nostalgia": (4, 0, 1)}


@pytest.mark.parametrize("terms", [[], [("the", "a"), ("THE ", "b"), ("for the", "b"), ("x", "b"), (None, "b"), ("w1", None), ("w1", "c")]])
def test_coverage_of_odd_lexicons(spark, terms):
    texts = spark.createDataFrame([("a", "the x w1"), ("b", None), (None, "for")], "appid string, review string")
    rows = spark.createDataFrame([("f", i, *t) for i, t in enumerate(terms)], "file string, row int, token string, category string")
    got = L.lexicon_coverage(L.token_counts(texts), L.read_lexicon(rows)[0]).collect()
    assert sorted(map(tuple, got)) == ([("a", 1, 1, 0), ("b", 3, 1, 1), ("c", 1, 1, 0)] if terms else [])
