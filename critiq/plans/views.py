"""The model's tables, derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reviews an app needs here: apps (parts) have 14 to 49.
MIN_REVIEWS = 25
SAMPLE_CAP = 30
#: So many documents with several labels are broadcast (16 bytes each); more are joined by id, with the same result.
REPEATS_BROADCAST = 1_000_000
# A small lexicon of words that occur in documents; `la` is in two categories, the last term is no single token.
LEXICON = {"Flow": ["the", "of", "and", "with", "la"], "Utility": ["der", "und", "die", "la"], "Nostalgia": ["que", "le", "de", "for the"]}
TEXT_SCORES = {"the": 0.5, "der": -1.0, "que": 2.0, "le": 0.25}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark, sf_dir) -> DataFrame:
    """Parts as apps: lines not returned count as positive."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("positive"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("negative"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_partkey").cast("string").alias("appid"), F.col("p_name").alias("name"), "positive", "negative")


def details(spark, sf_dir) -> DataFrame:
    genres = F.array("p_type", "p_brand", F.element_at(F.split("p_name", " "), 1))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("appid"), F.lit(True).alias("ok"), F.when(F.col("p_size") > 5, "game").otherwise("dlc").alias("type"), genres.alias("genres"))


def reviews(spark, sf_dir) -> DataFrame:
    """Documents as reviews of their source; those without one belong to no app and are no reviews."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    created = (F.lit(1_577_836_800) + (F.col("doc_id") * 7919 * 41) % 31_536_000).cast("long")
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("appid"), F.col("doc_id").cast("string").alias("reviewId"), F.col("text").alias("review"), "lang", "doc_id",
        F.coalesce("quality", F.lit(0)).cast("int").alias("isPositive"), created.alias("timestamp_created"), F.length(F.coalesce("text", F.lit(""))).alias("charLen"),
    )
    totals = docs.groupBy(F.col("source").alias("appid")).agg((F.count("*") + 1).alias("totalEnglishReviews"))
    # a row per app, so no row of text is moved to its app's task; without use of the total the join falls away
    return rows.join(F.broadcast(totals), "appid", "left")


def review_texts(spark, sf_dir) -> DataFrame:
    """(appid, review, lang) of `reviews`, row for row, where labels matter only in that a document has a row for each of its own.

    So labels are counted, and just the documents with several meet their counts; no text is moved to join its label.
    """
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", F.col("source").alias("appid"), F.col("text").alias("review"), "lang")
    repeats = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").cast("int").alias("__rows")).filter("doc_id IS NOT NULL AND __rows > 1")
    n = repeats.limit(REPEATS_BROADCAST + 1).count()
    if n:
        once = F.array(F.lit(1))
        rows = docs.join(F.broadcast(repeats) if n <= REPEATS_BROADCAST else repeats, "doc_id", "left")
        docs = rows.withColumn("__each", F.explode(F.coalesce(F.array_repeat(F.lit(1), F.col("__rows")), once)))
    return docs.select("appid", "review", "lang")


# The same in SQL, as common table expressions.
CATALOG_SQL = """catalog AS (
  SELECT CAST(l_partkey AS VARCHAR) AS appid, p_name AS name, count(*) FILTER (l_returnflag <> 'R') AS pos, count(*) FILTER (l_returnflag = 'R') AS neg
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
scored AS (
  SELECT appid, name, pos AS "posReview", neg AS "negReview", pos + neg AS "totReview", round(pos / (pos + neg), 6) AS "posRate",
         round(ln(CAST(pos + neg AS DOUBLE)), 6) AS popularity, round(pos / (pos + neg) * ln(CAST(pos + neg AS DOUBLE)), 6) AS "acceptanceScore"
  FROM catalog)"""
ELIGIBLE_SQL = CATALOG_SQL + """,
eligible AS (SELECT * FROM scored WHERE "totReview" >= 25),
ranked AS (SELECT *, row_number() OVER (ORDER BY "acceptanceScore" DESC, CAST(appid AS BIGINT)) AS "rankAcceptance", count(*) OVER () AS n FROM eligible),
cut AS (SELECT *, CAST(floor(n * 0.25) AS BIGINT) AS q1, CAST(floor(n * 0.75) AS BIGINT) AS q3 FROM ranked),
mid AS (SELECT *, "rankAcceptance" - q1 AS "rankFiltered" FROM cut WHERE "rankAcceptance" - 1 >= q1 AND "rankAcceptance" - 1 < q3)"""
REVIEWS_SQL = """reviews AS (
  SELECT source AS appid, CAST(d.doc_id AS VARCHAR) AS "reviewId", text AS review, lang, d.doc_id, CAST(coalesce(quality, 0) AS INTEGER) AS "isPositive",
         1577836800 + (d.doc_id * 7919 * 41) % 31536000 AS timestamp_created, length(coalesce(text, '')) AS "charLen",
         count(*) OVER (PARTITION BY source) + 1 AS "totalEnglishReviews"
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE source IS NOT NULL)"""
