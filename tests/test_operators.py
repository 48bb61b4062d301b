"""Rules with values worked out by hand, and properties."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from critiq.functions import text as X
from critiq.functions.numeric import renormalised, to_long
from critiq.functions.objects import first_json
from critiq.operators import bibliometrics as B
from critiq.operators import catalog as C
from critiq.operators import clusters as K
from critiq.operators import lexicon as L
from critiq.operators import pairing as P
from critiq.operators import quality_control as Q
from critiq.operators import ranking
from critiq.operators import responses as R
from critiq.operators import reviews as V
from critiq.operators import sampling as S
from critiq.operators import stats
from critiq.sources import files


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_metrics(spark):
    rows = C.acceptance(spark.createDataFrame([("1", "a", 0, 0), ("2", "b", 1, 0), ("3", "c", 75, 25)], "appid string, name string, positive long, negative long"))
    assert {r.appid: (r.posRate, r.popularity, r.acceptanceScore) for r in rows.collect()} == {"1": (0, 0, 0), "2": (1, 0, 0), "3": (0.75, 4.60517, 3.453878)}


@pytest.mark.parametrize("mode, kept", [("keep_mid", {2, 3, 4, 5, 6}), ("keep_extremes", {0, 1, 7, 8, 9}), ("keep_all", set(range(10)))])
def test_quartile_slice(spark, mode, kept):
    rows = spark.createDataFrame([(str(i), f"n{i}", 60, float(10 - i)) for i in range(10)], "appid string, name string, totReview long, acceptanceScore double")
    out = C.quartile_slice(rows, mode).collect()
    assert {r.rankAcceptance - 1 for r in out} == kept and sorted(r.rankFiltered for r in out) == list(range(1, len(kept) + 1))
    assert C.quartile_slice(rows.limit(3), mode).count() == 3


def test_global_rank_does_not_depend_on_ranges(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "id long, s double")
    whole, cut = (ranking.global_rank(rows, "s", "id", rows_per_range=n).select("id", "rank").collect() for n in (1000, 40))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) and sorted(r.rank for r in cut) == list(range(1, 501))


def test_tertiles(spark):
    rows = spark.createDataFrame([("a", v) for v in range(1, 11)] + [("b", 5)], "appid string, charLen int")
    assert {r.appid: (r.p33, r.p66) for r in S.tertile_bounds(rows, ["appid"]).collect()} == {"a": (3, 6), "b": (5, 5)}


def test_allocation(spark):
    totals = [170, 170, 166, 44, 43, 44]
    rows = [("a", 1 - i // 3, S.BUCKETS[i % 3], i) for i, n in enumerate(totals) for _ in range(n)]
    out = S.allocation(spark.createDataFrame(rows, "appid string, isPositive int, lengthBucket string, i int"), 150).orderBy("stratum").collect()
    assert [r.target for r in out] == [40, 40, 39, 10, 10, 11]


@pytest.mark.parametrize("n, k, want", [(10, 3, [1, 5, 8]), (3, 5, [0, 1, 2]), (5, 0, []), (26, 23, None)])
def test_even_picks(spark, n, k, want):
    want = [math.floor((i + 0.5) * (n / k)) for i in range(k)] if want is None else want
    rows = spark.range(n).filter(S.is_even_pick(F.col("id"), F.lit(n).cast("long"), F.lit(k).cast("long")))
    assert sorted(r.id for r in rows.collect()) == want


def test_sample_size_and_strata(spark):
    rng = random.Random(1)
    rows = [(f"a{i % 3}", str(i), rng.randint(0, 1), rng.randint(1, 900), rng.randint(0, 10**8)) for i in range(700)]
    reviews = spark.createDataFrame(rows, "appid string, reviewId string, isPositive int, charLen int, timestamp_created long")
    out = S.stratified_sample(reviews, 150).groupBy("appid").agg(F.count("*").alias("n"), F.max("sampleIndexWithinApp").alias("m")).collect()
    assert [(r.n, r.m) for r in out] == [(150, 150)] * 3
    assert S.stratified_sample(reviews.limit(40), 150).count() == 40


def walk(genres, eligible, k):
    """A plain two-pointer walk, for comparison."""
    i, j, used, out = 0, len(genres) - 1, set(), []
    while len(out) < k:
        while i < j and (not eligible[i] or genres[i] in used):
            i += 1
        b = j
        while b > i and (not eligible[b] or genres[b] in used or genres[b] == genres[i]):
            b -= 1
        if not i < b or not eligible[i] or genres[i] in used:
            break
        out.append((i, b))
        used |= {genres[i], genres[b]}
        i, j = i + 1, b - 1
    return out


def test_pairs_equal_a_plain_walk(spark):
    rng = random.Random(3)
    for _ in range(12):
        n = rng.randint(2, 14)
        genres, ok = [rng.choice("abcde") for _ in range(n)], [rng.random() < 0.8 for _ in range(n)]
        rows = [(str(i), i, genres[i]) for i in range(n) if ok[i]]
        frame = spark.createDataFrame(rows, "appid string, rankFiltered long, genreKey string")
        got = {(r.pairIndex, r.type): r.rankFiltered for r in P.select_pairs(frame, pairs=3).collect()}
        want = {(p + 1, side): at for p, pair in enumerate(walk(genres, ok, 3)) for side, at in zip(("top", "bottom"), pair, strict=True)}
        assert got == want


def test_first_genre(spark):
    rows = spark.createDataFrame([("1", ["Free To Play", "Early Access", "Action"]), ("2", ["Free To Play", "Early Access", "Utilities", "Action"]), ("3", [])], "appid string, genres array<string>")
    assert {r.appid: r.firstGenre for r in P.with_first_genre(rows).collect()} == {"1": "Action", "2": None, "3": None}


def test_pair_deltas_need_both_sides(spark):
    app = spark.createDataFrame([("1", 2.0), ("2", None), ("3", 1.0)], "appid string, m double")
    pairs = spark.createDataFrame([(1, "top", "1"), (1, "bottom", "2"), (2, "top", "3")], "pairIndex int, type string, appid string")
    assert [tuple(r) for r in P.pair_deltas(app, pairs, ["m"]).collect()] == [(1, 2.0, None, None)]


def test_texts(spark):
    assert one(spark, "Café-8-bit GAME!! a 42", X.tokens) == ["caf", "bit", "game", "42"]
    assert one(spark, None, X.tokens) == []
    assert one(spark, "Rôle_Playing & Design/2D", X.genre_label) == "role playing and design 2d"
    assert one(spark, "Design & Illustration;x", X.check_label) == "design illustration x"
    assert one(spark, "Ünï — x", X.ascii_fold) == "Uni  x"
    assert one(spark, "mail a.b@c.de id 12345678901234567 end", X.mask_personal) == "mail [EMAIL] id [STEAMID] end"
    assert one(spark, " a\r\nb\tc \n", X.normalise) == "a\nb c"
    assert one(spark, "ok", lambda c: X.long_enough(c)) is False
    assert one(spark, "Three proper words make it readable, surely.", X.is_readable) is True
    assert one(spark, "#### $$$$ %%%% ^^^^ ab", X.is_readable) is False
    assert [one(spark, t, X.light_stem) for t in ("running", "wanted", "used", "likes", "flies", "ss", "as")] == ["runn", "want", "used", "like", "flie", "ss", "as"]
    assert one(spark, 'so {"a": "}", "b": {"c": 1}} x', first_json) == '{"a": "}", "b": {"c": 1}}'
    assert one(spark, "no object {", first_json) is None
    assert one(spark, "3.9", to_long) == 3 and one(spark, "x", to_long) == 0 and one(spark, "9007199254740993", to_long) == 9007199254740993


def test_renormalised(spark):
    got = spark.createDataFrame([(0.5, 2.0, -1.0, 0.5), (0.0, 0.0, 0.0, 0.0)], "Flow double, Utility double, Nostalgia double, None double").select(*[v.alias(k) for k, v in renormalised({k: F.col(k) for k in ("Flow", "Utility", "Nostalgia", "None")}).items()]).collect()
    assert [tuple(r) for r in got] == [(0.25, 0.5, 0.0, 0.25), (0.0, 0.0, 0.0, 1.0)]


def test_review_scores(spark):
    rows = spark.createDataFrame([("a", "1", "nothing here", 12, 1), ("a", "2", "", 0, 0), ("a", "3", "both", 4, 1), ("a", "4", None, 0, 0)], "appid string, reviewId string, review string, charLen int, isPositive int")
    out = {r.reviewId: r for r in L.review_scores(rows, {"Flow": ["both"], "Utility": ["both", "two words"], "Nostalgia": []}).collect()}
    for key in ("1", "2", "4"):
        assert out[key].zero_hit and out[key].None_share == 1 and out[key].Flow_prop is None
    assert (out["3"].Flow_share, out["3"].Utility_share, out["3"].Nostalgia_share, out["3"].None_share) == (0.5, 0.5, 0, 0)


def line(**changes):
    base = {"appid": "a", "reviewId": 1, "Flow": 0.4, "Utility": 0.3, "Nostalgia": 0.2, "None": 0.1, "confidence": 0.5, "dominant": "Flow", "rationale_brief": "fine"}
    return json.dumps({k: v for k, v in (base | changes).items() if v != "absent"})


def test_response_reasons(spark):
    cases = [("{oops", "invalid_json"), ("[1]", "not_object"), (line(Flow="absent"), "missing_keys"), (line(reviewId="x"), "reviewId_not_int_or_null"), (line(Flow=1.2), "out_of_range:Flow"), (line(dominant="Fun"), "invalid_dominant"),
             (line(rationale_brief="w " * 31), "rationale_too_long"), (line(rationale_brief='a "b"'), "rationale_has_quote"), (line(Flow=0.3), "sum"), (line(Flow=0.395), None), (line(Flow="0.4"), None), (line(reviewId=None), None), ("  ", "skipped")]
    got = {r.line_no: r for r in R.parsed(spark.createDataFrame(list(enumerate(c for c, _ in cases)), "line_no int, line string")).collect()}
    for i, (_, reason) in enumerate(cases):
        assert (i not in got) if reason == "skipped" else got[i].reason == reason
    assert got[9].renormalised and abs(got[9].Flow + got[9].Utility + got[9].Nostalgia + got[9]["None"] - 1) < 1e-12
    tie = R.parsed(spark.createDataFrame([(0, line(Flow=0.45, Utility=0.40, Nostalgia=0.05))], "line_no int, line string")).first()
    assert tie.dominant == "tie" and tie.dominance_fixed


@pytest.mark.parametrize("changes, reason, review_id", [
    ({"rationale_brief": 5}, "rationale_not_string", "1"), ({"rationale_brief": True}, "rationale_not_string", "1"), ({"rationale_brief": "[ok] nice"}, None, "1"), ({"dominant": " Flow "}, None, "1"),
    ({"reviewId": 9007199254740993}, None, "9007199254740993"), ({"reviewId": "3.5"}, "reviewId_not_int_or_null", None), ({"reviewId": 10**25}, None, str(10**25)), ({"reviewId": -3.7}, None, "-3"),
    ({"reviewId": " 12 "}, None, "12"), ({"confidence": 1.5}, "out_of_range:confidence", "1"), ({"confidence": "0.5"}, None, "1"), ({"confidence": None}, "out_of_range:confidence", "1"), ({"dominant": 3}, "invalid_dominant", "1"),
])
def test_response_kinds(spark, changes, reason, review_id):
    """Fields are read by their JSON kind."""
    row = R.parsed(spark.createDataFrame([(0, line(**changes, other={"a": [1]}))], "line_no int, line string")).first()
    assert (row.reason, row.reviewId, row.extras) == (reason, review_id, {"other": '{"a":[1]}'})


def test_reply_lines(spark):
    replies = [('sure: {"Flow": 1} !', "a", "7"), ('{"appid": "b", "x": 1}', "a", None), ("{}", "a", "7"), ("none", "a\"q", "7"), (None, "a", None)]
    rows = spark.createDataFrame(replies, "reply string, appid string, id string").select(R.reply_line(F.col("reply"), F.col("appid"), F.col("id")).alias("x")).collect()
    assert [json.loads(r.x) for r in rows] == [
        {"Flow": 1, "appid": "a", "reviewId": "7"}, {"appid": "b", "x": 1, "reviewId": None}, {"appid": "a", "reviewId": "7"}, {"appid": 'a"q', "reviewId": "7", "_error": "non-JSON output"},
        {"appid": "a", "reviewId": None, "_error": "non-JSON output"},
    ]


def test_null_ids_match(spark):
    rows = spark.createDataFrame([("a", None), ("a", "1")], "appid string, reviewId string")
    assert [tuple(r) for r in V.not_in(rows, rows.filter("reviewId IS NULL"), ["appid", "reviewId"]).collect()] == [("a", "1")]


def test_large_lexicons_score_as_small_ones(spark, monkeypatch):
    """Terms matched by a join: null and repeated ids keep their own hits."""
    rows = [("a", None, "both two", 8, 1), (None, "1", "both both", 9, 0), ("a", "2", "two", 3, 1), ("a", "2", "none here", 9, 1), ("a", "3", None, 0, 0)]
    rows = spark.createDataFrame(rows, "appid string, reviewId string, review string, charLen int, isPositive int")
    lexicon = {"Flow": ["both"], "Utility": ["both", "two"], "Nostalgia": []}
    small = sorted(map(str, L.review_scores(rows, lexicon).collect()))
    monkeypatch.setattr(L, "TERMS_IN_ROW", 0)
    assert sorted(map(str, L.review_scores(rows, lexicon).collect())) == small and len(small) == 5


def test_places_by_time(spark):
    rows = [(i % 2, str(i), None if i % 11 == 0 else (i * 7919) % 400_000) for i in range(200)]
    frame = spark.createDataFrame(rows, "g int, reviewId string, timestamp_created long")
    got = {r.reviewId: r.place for r in S.placed_by_time(frame, ["g"]).collect()}
    for g in (0, 1):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        assert [got[r[1]] for r in want] == list(range(100))


def test_bad_labels_go_by_the_full_tertiles(spark):
    full = spark.createDataFrame([("a", str(i), i + 1, 1, i) for i in range(9)], "appid string, reviewId string, charLen int, isPositive int, timestamp_created long")
    sample = full.withColumn("lengthBucket", F.when(F.col("charLen") == 9, "?").when(F.col("charLen") == 1, None).otherwise(" medium "))
    row = Q.sample_against_full(full, sample).first()
    assert [round(row[f"{b}_sample"] * 9 / 100) for b in S.BUCKETS] == [1, 7, 1]


@pytest.mark.parametrize("n, k", [(1, 1), (55, 8), (101, 10), (150, 12), (1000, 24)])
def test_cluster_count(spark, n, k):
    assert K.cluster_count(spark.range(n).select(F.lit("a").alias("appid"))).first().k == k


def plain_lloyd(x, centres, rounds):
    """labels after so many rounds, by loops."""
    for turn in range(rounds + 1):
        labels = [min(range(len(centres)), key=lambda c: (round(sum((a - b) ** 2 for a, b in zip(v, centres[c], strict=True)), 9), c)) for v in x]
        if turn < rounds:
            for c in range(len(centres)):
                own = [v for v, label in zip(x, labels, strict=True) if label == c]
                if own:
                    centres = [*centres[:c], [sum(col) / len(own) for col in zip(*own, strict=True)], *centres[c + 1 :]]
    return labels


def cluster_rows(spark, n=90):
    rng = random.Random(2)
    rows = [(a, f"{a}{i}", [round(rng.gauss(10 * (i % 8), 3), 3), round(rng.gauss(i % 3, 1), 3)]) for a in "ab" for i in range(n)]
    odd = [("a", None, [0.0, 0.0]), (None, "x", [0.0, 0.0]), ("a", "y", None), ("b", "z", [float("nan"), 1.0]), ("b", "u", [None, 1.0])]
    same = [("c", f"c{i}", [1.0, 2.0]) for i in range(20)] + [("one", "o", [5.0, 5.0])]
    return rows, same, spark.createDataFrame(rows + odd + same, "appid string, reviewId string, emb array<double>").repartition(5)


@pytest.mark.parametrize("rounds", [0, 1, 20])
def test_clusters_equal_plain_lloyd(spark, rounds):
    rows, same, frame = cluster_rows(spark)
    starts = {a: [v for b, _, v in rows if b == a][:9] for a in "ab"} | {"c": [[1.0, 2.0]], "one": [[0.0, 0.0]]}
    found = {r.reviewId: r.cluster_id for r in K.assign_clusters(frame, rounds, starts).collect()}
    assert len(found) == len(rows) + len(same)
    for a in "ab":
        ids, x = zip(*[(i, v) for b, i, v in rows if b == a], strict=True)
        assert [found[i] for i in ids] == plain_lloyd(x, starts[a], rounds)


def test_clusters_do_not_depend_on_blocks_batches_or_who_sums(spark, monkeypatch):
    rows, same, frame = cluster_rows(spark)
    whole = {tuple(r) for r in K.assign_clusters(frame).collect()}
    sizes = {}
    for app, cluster, _, size in whole:
        sizes.setdefault(app, {})[cluster] = size
    assert len(sizes["a"]) == len(sizes["b"]) == 9 and sizes["c"] == {0: 20} and sizes["one"] == {0: 1}
    monkeypatch.setattr(K, "BLOCK_ROWS", 25)
    monkeypatch.setattr(K, "CENTRE_BYTES", 200)
    assert {tuple(r) for r in K.assign_clusters(frame.repartition(3)).collect()} == whole
    assert K.assign_clusters(frame.limit(0)).count() == 0


def test_embedding_keeps_rows_when_a_batch_fails(spark):
    def broken():
        def encode(texts):
            raise ValueError

        return encode

    rows = spark.createDataFrame([("x",), (None,)], "text string")
    assert [r.emb for r in K.embed(rows, broken).collect()] == [[0.0], [0.0]]
    assert all(abs(sum(v * v for v in r.emb) - 1) < 1e-5 for r in K.embed(rows.filter("text IS NOT NULL")).collect())


def test_divergence_and_ranks(spark):
    both = spark.createDataFrame([("a", *[50.0, 25.0] * 4), ("b", *[50.0, 75.0] * 4)], "appid string, " + ", ".join(f"{k}_dict double, {k}_llm double" for k in ("Flow", "Utility", "Nostalgia", "None")))
    assert {round(r.kl, 6) for r in stats.kl_divergence(both, 100).collect()} == {0.143841}
    ranks = ranking.average_rank(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double"), "v", "r").orderBy("v").collect()
    assert [r.r for r in ranks] == [1, 2.5, 2.5, 4]


def test_density_and_growth(spark):
    yearly = {1999: 2, 2003: 1, 2004: 1}
    rows = B.density(B.per_year(spark.createDataFrame([(y,) for y, n in yearly.items() for _ in range(n)], "Year int"))).orderBy("year").collect()
    assert [(r.year, r.n, r.density) for r in rows] == [(1999, 2, 3), (2000, 0, 2), (2001, 0, 2), (2002, 0, 2), (2003, 1, 2), (2004, 1, 1)]


def test_page_issues(spark):
    pages = spark.createDataFrame([("a", 1, 5), ("a", 2, 0), ("b", 1, 5), ("b", 2, 3)], "appid string, page int, n_reviews int")
    issues = Q.page_issues(pages, spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "appid string, pages int")).collect()
    assert {r.appid: r.detail for r in issues} == {"b": "2/1", "c": "0/1"}


def test_catalog_pages(spark):
    page = json.dumps({"10": {"appid": 10, "name": " A ", "positive": "7", "negative": "x"}, "bad": {"name": "B", "positive": 1, "negative": 1}})
    assert [tuple(r) for r in files.catalog_rows(spark.createDataFrame([(page,), (None,), ("",)], "json string")).collect()] == [(10, "A", 7, 0)]


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 'x "y",\nz', 1.23456789), ("b", "2", None, 2.0)], "appid string, reviewId string, review string, s double")
    files.write_csv(rows, f"{tmp_path}/c", ["reviewId", "appid", "review", "s"])
    back = files.read_csv(spark, f"{tmp_path}/none", "reviewId string, appid string, review string, s double", f"{tmp_path}/c").orderBy("appid").collect()
    assert (back[0].review, back[0].s) == ('x "y",\nz', 1.234568)
    files.write_per_app(rows, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    files.write_json_lines(rows, f"{tmp_path}/j")
    lines = spark.read.text(f"{tmp_path}/j").withColumnRenamed("value", "line").union(spark.createDataFrame([("{bad",), (" ",)], "line string"))
    assert sorted((r.reviewId or "", r.bad or "") for r in files.json_lines(lines, "appid string, reviewId string").collect()) == [("", "{bad"), ("1", ""), ("2", "")]
    names = files.resolved(spark.createDataFrame([(5, "t")], "app_id int, body string")).first()
    assert (names.appid, names.text) == ("5", "t") and names.reviewId.isdigit()


def test_review_page_files(spark, tmp_path):
    (tmp_path / "app7").mkdir()
    for n in (1, 2):
        (tmp_path / "app7" / f"page_{n}.json").write_text(json.dumps({"success": 1, "reviews": [{"recommendationid": str(n), "review": "r\n r"}]}, indent=1))
    rows = V.flatten_pages(files.read_review_pages(spark, str(tmp_path))).collect()
    assert sorted((r.appid, r.page, r.reviewId, r.charLen) for r in rows) == [("app7", 1, "1", 4), ("app7", 2, "2", 4)]


def test_ingest_resumes(spark, tmp_path):
    from critiq.streaming.ingest import ingest

    def page(app, n, ids):
        return {"appid": app, "page": n, "json": json.dumps({"success": 1, "reviews": [{"recommendationid": i, "review": "r", "voted_up": True, "timestamp_created": 5} for i in ids]})}

    for n, ids in enumerate((["1", "2"], ["2", "3"])):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{n}.json").write_text(json.dumps(page("a", n, ids)) + "\n")
        ingest(spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert sorted(r.reviewId for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "2", "3"]
