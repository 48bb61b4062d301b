"""Queries over reviews: pages, samples, descriptions, checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from critiq.operators import describe as D
from critiq.operators import quality_control as Q
from critiq.operators import reviews as R
from critiq.operators import sampling as S
from critiq.plans.views import REVIEWS_SQL, SAMPLE_CAP, reviews, table
from critiq.sources.scratch import saved
from critiq.streaming.ingest import new_reviews


def review_pages(spark, sf_dir):
    """Documents as review pages: one JSON text per source and hundred ids."""
    rows = reviews(spark, sf_dir)
    review = F.struct(
        F.col("reviewId").alias("recommendationid"), F.col("lang").alias("language"), F.col("review"), F.col("timestamp_created"), (F.col("isPositive") == 1).alias("voted_up"),
        (F.col("doc_id") % 7).alias("votes_up"), F.struct(F.concat(F.lit("u"), F.col("doc_id") % 100).alias("steamid"), (F.col("doc_id") % 50).alias("playtime_forever")).alias("author"),
    )
    grouped = rows.groupBy("appid", F.floor(F.col("doc_id") / 100).cast("int").alias("page")).agg(F.array_sort(F.collect_list(review)).alias("reviews"))  # a hundred at most
    return grouped.select("appid", "page", F.size("reviews").alias("n_reviews"), F.to_json(F.struct(F.lit(1).alias("success"), "reviews")).alias("json"))


def flatten_review_pages(spark, sf_dir):
    return R.flatten_pages(review_pages(spark, sf_dir)).select("appid", "page", "reviewId", "language", "isPositive", "timestamp_created", "votes_up", "authorSteamId", "playtime_forever", "charLen", F.md5("review").alias("review_md5"))


def dedupe_reviews(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("appid", (F.col("doc_id") % 300).cast("string").alias("reviewId"), "doc_id", "charLen")
    return R.deduplicated(rows, "doc_id")


def cap_reviews_per_app(spark, sf_dir):
    return R.capped(reviews(spark, sf_dir).select("appid", "reviewId", "timestamp_created"), 20, "timestamp_created", "reviewId")


def new_reviews_only(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("appid", "reviewId", "doc_id")
    return new_reviews(rows, rows.filter("doc_id % 3 = 0"))


def length_tertiles(spark, sf_dir):
    return S.tertile_bounds(reviews(spark, sf_dir), ["appid", "isPositive"])


def length_buckets(spark, sf_dir):
    return S.with_length_bucket(reviews(spark, sf_dir), ["appid", "isPositive"]).groupBy("appid", "isPositive", "lengthBucket").agg(F.count("*").alias("n"), F.max("charLen").alias("longest"))


def stratum_allocation(spark, sf_dir):
    return S.allocation(S.with_length_bucket(reviews(spark, sf_dir), ["appid", "isPositive"]), SAMPLE_CAP)


def _sample(spark, sf_dir):
    return S.stratified_sample(reviews(spark, sf_dir), SAMPLE_CAP)


def stratified_sample(spark, sf_dir):
    return _sample(spark, sf_dir).select("appid", "reviewId", "isPositive", "lengthBucket", "sampleIndexWithinApp")


def sampling_summary(spark, sf_dir):
    return S.sampling_summary(reviews(spark, sf_dir), _sample(spark, sf_dir), SAMPLE_CAP)


def per_app_stats(spark, sf_dir):
    rows = D.per_app_stats(reviews(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_len", "positivity_ratio", "days_span", "fetched_vs_total")})


def sample_length_shares(spark, sf_dir):
    rows = D.length_shares(_sample(spark, sf_dir))
    return rows.select("appid", *[F.round(c, 9).alias(c) for c in rows.columns[1:]])


def full_length_shares(spark, sf_dir):
    rows = D.full_length_shares(reviews(spark, sf_dir))
    return rows.select("appid", *[F.round(c, 9).alias(c) for c in rows.columns[1:]])


def unmatched_apps(spark, sf_dir):
    rows = reviews(spark, sf_dir)
    return D.unmatched(rows.filter("doc_id % 5 = 0"), rows.filter("doc_id % 7 = 0"), ["appid", "lang"])


def app_pairs_joined(spark, sf_dir):
    stats = D.per_app_stats(reviews(spark, sf_dir)).select("appid", "fetched", "positive")
    pairs = reviews(spark, sf_dir).select("appid").distinct().filter("appid < 'src15'").select("appid", F.substring("appid", 4, 1).cast("int").alias("pairIndex"))
    return D.with_pairs(stats, pairs)


def corpus_summary(spark, sf_dir):
    rows = D.corpus_summary(D.per_app_stats(reviews(spark, sf_dir)))
    return rows.select("apps", "reviews", *[F.round(c, 6).alias(c) for c in ("min_ratio", "median_ratio", "max_ratio")], "incomplete")


def length_histogram(spark, sf_dir):
    return D.histogram(reviews(spark, sf_dir), "charLen", 60, 3000)


def event_value_histogram(spark, sf_dir):
    return D.histogram(table(spark, sf_dir, "events"), "value", 40)


def sentiment_length_table(spark, sf_dir):
    return D.cross_table(S.with_length_bucket(reviews(spark, sf_dir), ["appid"]))


def _spoilt(spark, sf_dir):
    """Reviews with wrong totals in one app and repeated ids in another."""
    rows = reviews(spark, sf_dir).select("appid", "reviewId", "doc_id", "totalEnglishReviews")
    rows = rows.withColumn("totalEnglishReviews", F.when((F.col("appid") == "src3") & (F.col("doc_id") % 2 == 0), 10).otherwise(F.col("totalEnglishReviews")))
    return rows.unionByName(rows.filter("appid = 'src4' AND doc_id % 3 = 0"))


def qc_reviews(spark, sf_dir):
    return Q.review_issues(_spoilt(spark, sf_dir), 45)


def qc_master_rows(spark, sf_dir):
    return Q.master_issue(reviews(spark, sf_dir), _spoilt(spark, sf_dir))


def qc_pages_vs_checkpoint(spark, sf_dir):
    pages = review_pages(spark, sf_dir).select("appid", "page", "n_reviews")
    checkpoints = pages.groupBy("appid").agg((F.count("*") + (F.substring("appid", 4, 3).cast("int") % 3 == 0).cast("int")).cast("int").alias("pages"))
    return Q.page_issues(pages, checkpoints)


def _compared(spark, sf_dir):
    """Sample against full, one row per app. Reviews without their texts, the sample and the result are kept: each is read several times."""
    rows = saved(reviews(spark, sf_dir).drop("review"), "reviews")
    return saved(Q.sample_against_full(rows, saved(S.stratified_sample(rows, SAMPLE_CAP), "sample")), "compared")


def _sample_issues(compared):
    return Q.sample_issues(compared, positivity=1.0, span=0.97, points=5.0)


def qc_sample(spark, sf_dir):
    return _sample_issues(_compared(spark, sf_dir))


def qc_sample_labels(spark, sf_dir):
    """Bucket shares of samples of which every fourth label is no bucket's."""
    sample = _sample(spark, sf_dir).withColumn("lengthBucket", F.when(F.col("doc_id") % 4 == 0, "?").otherwise(F.concat(F.lit(" "), "lengthBucket")))
    rows = Q.sample_against_full(reviews(spark, sf_dir), sample)
    return rows.select("appid", *[F.round(f"{b}_sample", 6).alias(f"{b}_sample") for b in S.BUCKETS])


def qc_summary(spark, sf_dir):
    compared = _compared(spark, sf_dir)
    rows = Q.app_summary(compared, _sample_issues(compared).unionByName(qc_reviews(spark, sf_dir)))
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def qc_issue_levels(spark, sf_dir):
    return Q.issues_by_level(qc_sample(spark, sf_dir).unionByName(qc_reviews(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    flatten_review_pages, dedupe_reviews, cap_reviews_per_app, new_reviews_only, length_tertiles, length_buckets, stratum_allocation, stratified_sample, sampling_summary,
    per_app_stats, sample_length_shares, full_length_shares, unmatched_apps, app_pairs_joined, corpus_summary, length_histogram, event_value_histogram, sentiment_length_table,
    qc_reviews, qc_master_rows, qc_pages_vs_checkpoint, qc_sample, qc_sample_labels, qc_summary, qc_issue_levels,
)}

_BUCKETS = REVIEWS_SQL + """,
bounds AS (SELECT appid, "isPositive", list_sort(list("charLen")) AS v FROM reviews GROUP BY ALL),
tertiles AS (SELECT appid, "isPositive", v[CAST(floor(0.333::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] AS p33, v[CAST(floor(0.666::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] AS p66 FROM bounds),
bucketed AS (SELECT r.*, CASE WHEN "charLen" <= p33 THEN 'short' WHEN "charLen" <= p66 THEN 'medium' ELSE 'long' END AS "lengthBucket" FROM reviews r JOIN tertiles USING (appid, "isPositive")),
app_bounds AS (SELECT appid, list_sort(list("charLen")) AS v FROM reviews GROUP BY ALL),
app_bucketed AS (SELECT r.*, CASE WHEN "charLen" <= v[CAST(floor(0.333::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] THEN 'short' WHEN "charLen" <= v[CAST(floor(0.666::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] THEN 'medium' ELSE 'long' END AS "lengthBucket"
  FROM reviews r JOIN app_bounds USING (appid))"""
_PLAN = _BUCKETS + """,
six AS (SELECT DISTINCT appid, s AS "isPositive", b AS "lengthBucket", i + CASE WHEN s = 1 THEN 0 ELSE 3 END AS stratum FROM reviews, (VALUES (1), (0)) x(s), (VALUES ('short', 0), ('medium', 1), ('long', 2)) y(b, i)),
held AS (SELECT six.*, count(r."reviewId") AS total FROM six LEFT JOIN bucketed r USING (appid, "isPositive", "lengthBucket") GROUP BY ALL),
exact AS (SELECT *, sum(total) OVER (PARTITION BY appid) AS whole, CAST(30 * total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY appid) AS DOUBLE) AS e FROM held),
dealt AS (SELECT *, 30 - sum(floor(e)) OVER (PARTITION BY appid) AS need, row_number() OVER (PARTITION BY appid ORDER BY e - floor(e) DESC, stratum DESC) AS place FROM exact),
plan AS (SELECT appid, "isPositive", "lengthBucket", CAST(stratum AS INTEGER) AS stratum, total, CAST(CASE WHEN whole <= 30 THEN total ELSE floor(e) + CASE WHEN place <= need THEN 1 ELSE 0 END END AS BIGINT) AS target FROM dealt)"""
_SAMPLE = _PLAN + """,
picks AS (SELECT appid, "isPositive", "lengthBucket", CAST(CASE WHEN target >= total THEN i ELSE floor((CAST(i AS DOUBLE) + 0.5::DOUBLE) * (CAST(total AS DOUBLE) / target)) END AS BIGINT) AS place
  FROM (SELECT *, unnest(range(CASE WHEN target >= total THEN total ELSE target END)) AS i FROM plan)),
placed AS (SELECT *, row_number() OVER (PARTITION BY appid, "isPositive", "lengthBucket" ORDER BY timestamp_created, "reviewId") - 1 AS place FROM bucketed),
sample AS (SELECT p.*, row_number() OVER (PARTITION BY appid ORDER BY timestamp_created, "reviewId") AS "sampleIndexWithinApp" FROM placed p JOIN picks USING (appid, "isPositive", "lengthBucket", place))"""
_STATS = REVIEWS_SQL + """,
stats AS (SELECT appid, count("reviewId") AS fetched, CAST(sum("isPositive") AS BIGINT) AS positive, median("charLen") AS median_len, avg("charLen") AS mean_len, min(timestamp_created) AS first_ts, max(timestamp_created) AS last_ts, max("totalEnglishReviews") AS total_english FROM reviews GROUP BY appid)"""
_SPOILT = """spoilt0 AS (SELECT appid, "reviewId", doc_id, CASE WHEN appid = 'src3' AND doc_id % 2 = 0 THEN 10 ELSE "totalEnglishReviews" END AS total FROM reviews),
spoilt AS (SELECT * FROM spoilt0 UNION ALL SELECT * FROM spoilt0 WHERE appid = 'src4' AND doc_id % 3 = 0),
spoilt_apps AS (SELECT appid, count(DISTINCT total) AS totals, max(total) AS total, count("reviewId") - count(DISTINCT "reviewId") AS repeated FROM spoilt GROUP BY appid),
review_issues AS (
  SELECT 'ERROR' AS level, 'reviews_total_varies' AS "where", appid, CAST(totals AS VARCHAR) AS detail FROM spoilt_apps WHERE totals > 1
  UNION ALL SELECT 'ERROR', 'reviews_too_few', appid, CAST(total AS VARCHAR) FROM spoilt_apps WHERE total < 45
  UNION ALL SELECT 'ERROR', 'reviews_repeated', appid, CAST(repeated AS VARCHAR) FROM spoilt_apps WHERE repeated > 0)"""
_SHARES = """(SELECT appid, count(*) FILTER ("lengthBucket" = 'short') / count(*) AS short_share, count(*) FILTER ("lengthBucket" = 'medium') / count(*) AS medium_share, count(*) FILTER ("lengthBucket" = 'long') / count(*) AS long_share FROM {} GROUP BY appid)"""
_COMPARED = _SAMPLE + f""",
compared AS (SELECT f.*, s.* EXCLUDE (appid), short_full, medium_full, long_full, short_sample, medium_sample, long_sample FROM
  (SELECT appid, count(*) AS n_full, avg("isPositive") * 100 AS positive_full, (max(timestamp_created) - min(timestamp_created)) / 86400.0::DOUBLE AS span_full FROM reviews GROUP BY appid) f
  JOIN (SELECT appid, count(*) AS n_sample, avg("isPositive") * 100 AS positive_sample, (max(timestamp_created) - min(timestamp_created)) / 86400.0::DOUBLE AS span_sample FROM sample GROUP BY appid) s USING (appid)
  JOIN (SELECT appid, short_share * 100 AS short_full, medium_share * 100 AS medium_full, long_share * 100 AS long_full FROM {_SHARES.format('app_bucketed')}) a USING (appid)
  JOIN (SELECT appid, short_share * 100 AS short_sample, medium_share * 100 AS medium_sample, long_share * 100 AS long_sample FROM {_SHARES.format('sample')}) b USING (appid)),
off AS (SELECT appid, unnest(['short', 'medium', 'long']) AS bucket, unnest([short_sample - short_full, medium_sample - medium_full, long_sample - long_full]) AS off FROM compared),
sample_issues AS (
  SELECT 'WARN' AS level, 'sample_positivity' AS "where", appid, CAST(round(positive_sample - positive_full, 4) AS VARCHAR) AS detail FROM compared WHERE abs(positive_sample - positive_full) > 1.0
  UNION ALL SELECT 'WARN', 'sample_span', appid, CAST(round(span_sample / span_full, 4) AS VARCHAR) FROM compared WHERE span_sample < 0.97::DOUBLE * span_full
  UNION ALL SELECT 'WARN', 'sample_length_share', appid, bucket || ':' || CAST(round(off, 4) AS VARCHAR) FROM off WHERE abs(off) > 5.0)"""

ORACLES = {
    "flatten_review_pages": f"""WITH {REVIEWS_SQL} SELECT appid, CAST(floor(doc_id / 100) AS INTEGER) AS page, "reviewId", coalesce(lang, 'english') AS language, "isPositive", timestamp_created, doc_id % 7 AS votes_up, 'u' || CAST(doc_id % 100 AS VARCHAR) AS "authorSteamId", doc_id % 50 AS playtime_forever, "charLen", md5(coalesce(review, '')) AS review_md5 FROM reviews""",
    "dedupe_reviews": f"""WITH {REVIEWS_SQL}, r AS (SELECT appid, CAST(doc_id % 300 AS VARCHAR) AS "reviewId", doc_id, "charLen", row_number() OVER (PARTITION BY appid, doc_id % 300 ORDER BY doc_id) AS k FROM reviews) SELECT appid, "reviewId", doc_id, "charLen" FROM r WHERE k = 1""",
    "cap_reviews_per_app": f"""WITH {REVIEWS_SQL}, r AS (SELECT appid, "reviewId", timestamp_created, row_number() OVER (PARTITION BY appid ORDER BY timestamp_created, "reviewId") AS k FROM reviews) SELECT appid, "reviewId", timestamp_created FROM r WHERE k <= 20""",
    "new_reviews_only": f'WITH {REVIEWS_SQL} SELECT appid, "reviewId", doc_id FROM reviews WHERE doc_id % 3 <> 0',
    "length_tertiles": f'WITH {_BUCKETS} SELECT appid, "isPositive", p33, p66 FROM tertiles',
    "length_buckets": f'WITH {_BUCKETS} SELECT appid, "isPositive", "lengthBucket", count(*) AS n, max("charLen") AS longest FROM bucketed GROUP BY ALL',
    "stratum_allocation": f"WITH {_PLAN} SELECT * FROM plan",
    "stratified_sample": f'WITH {_SAMPLE} SELECT appid, "reviewId", "isPositive", "lengthBucket", "sampleIndexWithinApp" FROM sample',
    "sampling_summary": f"""WITH {_SAMPLE},
full_ AS (SELECT appid, count(*) AS "totalReviews", CAST(sum("isPositive") AS BIGINT) AS "totalPositive", CAST(floor((max(timestamp_created) - min(timestamp_created)) / 86400) AS BIGINT) AS "totalSpanDays" FROM reviews GROUP BY appid),
part_ AS (SELECT appid, count(*) AS "sampleReviews", CAST(sum("isPositive") AS BIGINT) AS "samplePositive", CAST(floor((max(timestamp_created) - min(timestamp_created)) / 86400) AS BIGINT) AS "sampleSpanDays" FROM sample GROUP BY appid),
strata AS (SELECT appid, "isPositive", "lengthBucket", count(*) AS selected, CAST(floor((max(timestamp_created) - min(timestamp_created)) / 86400) AS BIGINT) AS "stratumSpanDays" FROM sample GROUP BY ALL)
SELECT appid, "totalReviews", "totalPositive", "totalSpanDays", "sampleReviews", "samplePositive", "sampleSpanDays", 'app' AS grain, NULL::INTEGER AS "isPositive", NULL::VARCHAR AS "lengthBucket", NULL::BIGINT AS total, NULL::BIGINT AS target, NULL::BIGINT AS selected, NULL::BIGINT AS "stratumSpanDays" FROM full_ LEFT JOIN part_ USING (appid)
UNION ALL SELECT appid, NULL, NULL, NULL, NULL, NULL, NULL, 'stratum', "isPositive", "lengthBucket", total, target, coalesce(selected, 0), "stratumSpanDays" FROM plan LEFT JOIN strata USING (appid, "isPositive", "lengthBucket")""",
    "per_app_stats": f"WITH {_STATS} SELECT * REPLACE (round(mean_len, 6) AS mean_len), round(positive / fetched, 6) AS positivity_ratio, round((last_ts - first_ts) / 86400.0::DOUBLE, 6) AS days_span, round(fetched / total_english, 6) AS fetched_vs_total FROM stats",
    "sample_length_shares": f"WITH {_SAMPLE} SELECT appid, round(short_share, 9) AS short_share, round(medium_share, 9) AS medium_share, round(long_share, 9) AS long_share FROM {_SHARES.format('sample')}",
    "full_length_shares": f"WITH {_BUCKETS} SELECT appid, round(short_share, 9) AS short_share, round(medium_share, 9) AS medium_share, round(long_share, 9) AS long_share FROM {_SHARES.format('app_bucketed')}",
    "unmatched_apps": f"""WITH {REVIEWS_SQL}, a AS (SELECT DISTINCT appid, lang FROM reviews WHERE doc_id % 5 = 0), b AS (SELECT DISTINCT appid, lang FROM reviews WHERE doc_id % 7 = 0)
(SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))""",
    "app_pairs_joined": f"WITH {_STATS} SELECT appid, fetched, positive, CASE WHEN appid < 'src15' THEN CAST(substr(appid, 4, 1) AS INTEGER) END AS \"pairIndex\" FROM stats",
    "corpus_summary": f"WITH {_STATS}, r AS (SELECT *, fetched / total_english AS ratio FROM stats) SELECT count(DISTINCT appid) AS apps, CAST(sum(fetched) AS BIGINT) AS reviews, round(min(ratio), 6) AS min_ratio, round(median(ratio), 6) AS median_ratio, round(max(ratio), 6) AS max_ratio, count(*) FILTER (ratio < 0.99) AS incomplete FROM r",
    "length_histogram": f"""WITH {REVIEWS_SQL}, v AS (SELECT CAST(least("charLen", 3000) AS DOUBLE) AS v FROM reviews), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
SELECT CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 60)), 59) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM v, e GROUP BY 1""",
    "event_value_histogram": """WITH v AS (SELECT value AS v FROM events WHERE value IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
SELECT CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 40)), 39) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM v, e GROUP BY 1""",
    "sentiment_length_table": f"""WITH {_BUCKETS} SELECT appid, "isPositive", count(*) FILTER ("lengthBucket" = 'short') AS short, count(*) FILTER ("lengthBucket" = 'medium') AS medium, count(*) FILTER ("lengthBucket" = 'long') AS long FROM app_bucketed GROUP BY ALL""",
    "qc_reviews": f"WITH {REVIEWS_SQL}, {_SPOILT} SELECT * FROM review_issues",
    "qc_master_rows": f"""WITH {REVIEWS_SQL}, {_SPOILT}, m AS (SELECT (SELECT count(*) FROM reviews) AS m, (SELECT count(*) FROM spoilt) AS r)
SELECT 'ERROR' AS level, 'master_rows' AS "where", NULL::VARCHAR AS appid, CAST(m AS VARCHAR) || '/' || CAST(r AS VARCHAR) AS detail FROM m WHERE m <> r""",
    "qc_pages_vs_checkpoint": f"""WITH {REVIEWS_SQL}, p AS (SELECT appid, count(DISTINCT floor(doc_id / 100)) AS held FROM reviews GROUP BY appid)
SELECT 'WARN' AS level, 'pages_vs_checkpoint' AS "where", appid, CAST(held AS VARCHAR) || '/' || CAST(held + 1 AS VARCHAR) AS detail FROM p WHERE CAST(substr(appid, 4, 3) AS INTEGER) % 3 = 0""",
    "qc_sample": f"WITH {_COMPARED} SELECT * FROM sample_issues",
    "qc_sample_labels": f"""WITH {_SAMPLE}, b AS (SELECT s.appid, CASE WHEN s.doc_id % 4 <> 0 THEN s."lengthBucket" WHEN "charLen" <= v[CAST(floor(0.333::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] THEN 'short'
  WHEN "charLen" <= v[CAST(floor(0.666::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] THEN 'medium' ELSE 'long' END AS "lengthBucket" FROM sample s JOIN app_bounds USING (appid))
SELECT appid, round(short_share * 100, 6) AS short_sample, round(medium_share * 100, 6) AS medium_sample, round(long_share * 100, 6) AS long_sample FROM {_SHARES.format('b')}""",
    "qc_summary": f"""WITH {_COMPARED}, {_SPOILT}, levels AS (SELECT appid, count(*) FILTER (level = 'ERROR') AS "ERROR", count(*) FILTER (level = 'WARN') AS "WARN", count(*) FILTER (level = 'INFO') AS "INFO" FROM (SELECT * FROM sample_issues UNION ALL SELECT * FROM review_issues) GROUP BY appid)
SELECT appid, n_full, n_sample, round(positive_full, 6) AS positive_full, round(span_full, 6) AS span_full, round(positive_sample, 6) AS positive_sample, round(span_sample, 6) AS span_sample,
  round(short_full, 6) AS short_full, round(medium_full, 6) AS medium_full, round(long_full, 6) AS long_full, round(short_sample, 6) AS short_sample, round(medium_sample, 6) AS medium_sample, round(long_sample, 6) AS long_sample,
  coalesce("ERROR", 0) AS "ERROR", coalesce("WARN", 0) AS "WARN", coalesce("INFO", 0) AS "INFO" FROM compared LEFT JOIN levels USING (appid)""",
    "qc_issue_levels": f"WITH {_COMPARED}, {_SPOILT} SELECT level, count(*) AS n FROM (SELECT * FROM sample_issues UNION ALL SELECT * FROM review_issues) GROUP BY level",
}
