"""Descriptive statistics per app and over the corpus, shares, histograms, joins with pairs.

Null values do not count in means, medians and extremes; a null appid is an app of its own in groupings and matches nothing
in joins. Repeated rows count as often as they are there. Empty tables give no rows; a summary of one row has zero counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.functions.numeric import share
from critiq.operators.differences import differing_parts
from critiq.operators.ranking import first_per_key, percentiles
from critiq.operators.sampling import BUCKETS, with_length_bucket
from critiq.sources.scratch import saved


def per_app_stats(reviews: DataFrame) -> DataFrame:
    rows = reviews.groupBy("appid").agg(
        F.count("reviewId").alias("fetched"), F.sum("isPositive").alias("positive"), F.median("charLen").alias("median_len"), F.avg("charLen").alias("mean_len"),
        F.min("timestamp_created").alias("first_ts"), F.max("timestamp_created").alias("last_ts"), F.max("totalEnglishReviews").alias("total_english"),
    )
    return rows.withColumns({
        "positivity_ratio": share(F.col("positive"), F.col("fetched")), "days_span": (F.col("last_ts") - F.col("first_ts")) / 86400.0, "fetched_vs_total": share(F.col("fetched"), F.col("total_english")),
    })


def length_shares(bucketed: DataFrame) -> DataFrame:
    """Share of each bucket per app, absent ones 0."""
    counts = bucketed.groupBy("appid").pivot("lengthBucket", list(BUCKETS)).count().fillna(0)
    total = sum([F.col(b) for b in BUCKETS[1:]], F.col(BUCKETS[0]))
    return counts.select("appid", *[(F.col(b) / total).alias(f"{b}_share") for b in BUCKETS])


def full_length_shares(reviews: DataFrame) -> DataFrame:
    """The same by the tertiles over all of an app's reviews."""
    return length_shares(with_length_bucket(reviews, ["appid"]))


def with_pairs(per_app: DataFrame, pairs: DataFrame) -> DataFrame:
    """per_app with the columns of its pair row, if any: the first by pairIndex, then type (top before bottom) where there are more."""
    order = [F.desc(c) if c == "type" else F.asc(c) for c in ("pairIndex", "type") if c in pairs.columns] or [F.lit(1)]
    return per_app.join(first_per_key(pairs, ["appid"], *order), "appid", "left")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side that the other lacks, with `side`; null keys match null keys. Only buckets of keys that differ are compared."""
    def lacking(a, b, side):
        return a.select(*keys).distinct().join(b.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct(), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti").withColumn("side", F.lit(side))

    left, right = differing_parts(left.select(*keys), right.select(*keys), keys)
    return lacking(left, right, "left").unionByName(lacking(right, left, "right"))


def corpus_summary(per_app: DataFrame) -> DataFrame:
    """One row over all apps; the median is exact (ranking.percentiles)."""
    rows = saved(per_app.select("appid", "fetched", F.col("fetched_vs_total").cast("double").alias("ratio")), "ratios")
    ratio = F.col("ratio")
    one = rows.agg(
        F.count_distinct("appid").alias("apps"), F.sum("fetched").alias("reviews"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio"), F.count(F.when(ratio < 0.99, 1)).alias("incomplete"),
    )
    middle = percentiles(rows, [], ["ratio"], {"p50": 0.5})
    return one.crossJoin(F.broadcast(middle)).select("apps", "reviews", "min_ratio", F.col("ratio_p50").alias("median_ratio"), "max_ratio", "incomplete")  # one row each


def histogram(df: DataFrame, value: str, bins: int, clip: float | None = None) -> DataFrame:
    """(bin, n): equal bins from least to greatest value, the last one closed on the right; nulls left out; empty bins absent."""
    v = F.col(value).cast("double")
    rows = df.select((F.least(v, F.lit(float(clip))) if clip is not None else v).alias("v")).filter("v IS NOT NULL")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    return rows.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


def cross_table(bucketed: DataFrame) -> DataFrame:
    """Counts per app and sentiment of each bucket."""
    return bucketed.groupBy("appid", "isPositive").pivot("lengthBucket", list(BUCKETS)).count().fillna(0)
