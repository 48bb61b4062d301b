"""Rule-based checks. Each gives rows (level, where, appid, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from critiq.functions.numeric import share
from critiq.functions.text import check_label
from critiq.operators.catalog import acceptance
from critiq.operators.describe import full_length_shares, length_shares
from critiq.operators.differences import differing_parts
from critiq.operators.pairing import JUMP_LABELS, NON_GAME_LABELS
from critiq.operators.sampling import BUCKETS, bucket_of, tertile_bounds
from critiq.sources.scratch import saved

# The limits of the rules.
LEAST_REVIEWS, POSITIVITY_POINTS, LEAST_SPAN, SHARE_POINTS = 50, 5.0, 0.6, 10.0


def issue(rows: DataFrame, level: str, where: str, detail: Column, appid: Column | None = None) -> DataFrame:
    app = F.col("appid") if appid is None else appid
    return rows.select(F.lit(level).alias("level"), F.lit(where).alias("where"), app.cast("string").alias("appid"), detail.cast("string").alias("detail"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unsorted_rows(rows: DataFrame, rank: str, score: str, slack: float = 1e-6) -> DataFrame:
    """Rows whose score is above that of the rank before. A self-join on the rank, so no window holds the whole table."""
    before = rows.select((F.col(rank) + 1).alias(rank), F.col(score).alias("__before"))
    return rows.join(before, rank).filter(F.col(score) > F.col("__before") + slack).drop("__before")


def catalog_issues(ranked: DataFrame) -> DataFrame:
    """Scores out of order, and scores that the counts do not give."""
    again = acceptance(ranked.select("appid", "name", F.col("posReview").alias("positive"), F.col("negReview").alias("negative"))).select("appid", F.col("acceptanceScore").alias("again"))
    differ = ranked.join(again, "appid").filter(F.abs(F.col("again") - F.col("acceptanceScore")) > 1e-6)
    return together(issue(unsorted_rows(ranked, "rankAcceptance", "acceptanceScore"), "ERROR", "catalog_order", F.col("rankAcceptance")), issue(differ, "INFO", "catalog_score", F.round("again", 6)))


def filtered_issues(filtered: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows out of order, repeated appids, and differences from the slice made anew."""
    filtered = saved(filtered.select("appid", "rankFiltered", "acceptanceScore"), "filtered")
    repeated = filtered.groupBy("appid").count().filter("count > 1")
    ours, theirs = differing_parts(filtered.select("appid"), expected.select("appid"), ["appid"])
    lacking, extra = theirs.exceptAll(ours), ours.exceptAll(theirs)
    return together(
        issue(unsorted_rows(filtered, "rankFiltered", "acceptanceScore"), "ERROR", "filtered_order", F.col("rankFiltered")), issue(repeated, "ERROR", "filtered_duplicate", F.col("count")),
        issue(lacking, "ERROR", "filtered_missing", F.lit("expected")), issue(extra, "ERROR", "filtered_extra", F.lit("not expected")),
    )


def pair_issues(pairs: DataFrame, forbidden=(*JUMP_LABELS, *NON_GAME_LABELS)) -> DataFrame:
    """Pairs without a first genre (WARN), with one that is passed over or no game's, with one that came before."""
    rows = pairs.withColumn("label", check_label(F.col("firstGenre")))
    seen = F.row_number().over(W.partitionBy("label").orderBy("pairIndex", F.desc("type"), "appid"))
    again = rows.filter("label != ''").withColumn("seen", seen).filter("seen > 1")
    return together(
        issue(rows.filter("label = ''"), "WARN", "pair_genre_missing", F.col("pairIndex")), issue(rows.filter(F.col("label").isin(*forbidden)), "ERROR", "pair_genre_forbidden", F.col("label")),
        issue(again, "ERROR", "pair_genre_repeated", F.col("label")),
    )


def review_issues(reviews: DataFrame, least: int = LEAST_REVIEWS) -> DataFrame:
    """Per app: totals that vary, too few reviews, repeated review ids."""
    per_app = reviews.groupBy("appid").agg(F.count_distinct("totalEnglishReviews").alias("totals"), F.max("totalEnglishReviews").alias("total"), (F.count("reviewId") - F.count_distinct("reviewId")).alias("repeated"))
    return together(
        issue(per_app.filter("totals > 1"), "ERROR", "reviews_total_varies", F.col("totals")), issue(per_app.filter(F.col("total") < least), "ERROR", "reviews_too_few", F.col("total")),
        issue(per_app.filter("repeated > 0"), "ERROR", "reviews_repeated", F.col("repeated")),
    )


def page_issues(pages: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Pages on file against (appid, pages) of the checkpoints; one trailing empty page is allowed. pages: appid, page, n_reviews."""
    held = pages.groupBy("appid").agg(F.count("*").alias("held"), F.max_by("n_reviews", "page").alias("last"))
    rows = checkpoints.join(held, "appid", "left").fillna(0, ["held"])
    allowed = (F.col("held") == F.col("pages")) | ((F.col("held") == F.col("pages") + 1) & (F.col("last") == 0))
    return issue(rows.filter(~allowed), "WARN", "pages_vs_checkpoint", F.concat_ws("/", "held", "pages"))


def master_issue(master: DataFrame, reviews: DataFrame) -> DataFrame:
    """A row if the master table and the per-app tables differ in length."""
    counts = master.agg(F.count("*").alias("m")).crossJoin(F.broadcast(reviews.agg(F.count("*").alias("r"))))  # one row each
    return issue(counts.filter("m != r"), "ERROR", "master_rows", F.concat_ws("/", "m", "r"), F.lit(None))


def sample_against_full(reviews: DataFrame, sample: DataFrame) -> DataFrame:
    """Per app: positivity, time span and bucket shares of sample and full, in one row."""
    def side(df, name):
        days = (F.max("timestamp_created") - F.min("timestamp_created")) / 86400.0
        return df.groupBy("appid").agg(F.count("*").alias(f"n_{name}"), (F.avg("isPositive") * 100).alias(f"positive_{name}"), days.alias(f"span_{name}"))

    def shares(df, name):
        return df.select("appid", *[(F.col(f"{b}_share") * 100).alias(f"{b}_{name}") for b in BUCKETS])

    # a label that is no bucket's gives way to the bucket by the tertiles of all of the app's reviews
    said = F.trim("lengthBucket")
    labelled = sample.join(tertile_bounds(reviews, ["appid"]), "appid", "left").withColumn("lengthBucket", F.when(said.isin(*BUCKETS), said).otherwise(bucket_of(F.coalesce("charLen", F.lit(0)))))
    return side(reviews, "full").join(side(sample, "sample"), "appid").join(shares(full_length_shares(reviews), "full"), "appid").join(shares(length_shares(labelled), "sample"), "appid")


def sample_issues(compared: DataFrame, positivity: float = POSITIVITY_POINTS, span: float = LEAST_SPAN, points: float = SHARE_POINTS) -> DataFrame:
    off = compared.select("appid", F.stack(F.lit(3), *[x for b in BUCKETS for x in (F.lit(b), F.col(f"{b}_sample") - F.col(f"{b}_full"))]).alias("bucket", "off"))
    return together(
        issue(compared.filter(F.abs(F.col("positive_sample") - F.col("positive_full")) > positivity), "WARN", "sample_positivity", F.round(F.col("positive_sample") - F.col("positive_full"), 4)),
        issue(compared.filter(F.col("span_sample") < span * F.col("span_full")), "WARN", "sample_span", F.round(share(F.col("span_sample"), F.col("span_full")), 4)),
        issue(off.filter(F.abs("off") > points), "WARN", "sample_length_share", F.concat_ws(":", "bucket", F.round("off", 4).cast("string"))),
    )


def app_summary(compared: DataFrame, issues: DataFrame) -> DataFrame:
    """Per app: counts, shares and spans of full and sample (sample_against_full), and issues by level."""
    levels = issues.filter("appid IS NOT NULL").groupBy("appid").pivot("level", ["ERROR", "WARN", "INFO"]).count().fillna(0)
    return compared.join(levels, "appid", "left").fillna(0, ["ERROR", "WARN", "INFO"])


def issues_by_level(issues: DataFrame) -> DataFrame:
    return issues.groupBy("level").agg(F.count("*").alias("n"))
