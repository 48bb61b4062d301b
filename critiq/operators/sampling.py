"""Deterministic samples per app, stratified by sentiment and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from critiq.sources.scratch import saved

BUCKETS = ("short", "medium", "long")
DAY = 86_400


def tertile_bounds(reviews: DataFrame, keys: list[str], value: str = "charLen") -> DataFrame:
    """(keys, p33, p66): nearest-rank values at floor(0.333 (m-1)) and floor(0.666 (m-1)) of each group.

    Lengths are counted first, so a window sees one row per distinct length.
    """
    counts = reviews.groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counts.withColumns({"upto": F.sum("n").over(upto), "m": F.sum("n").over(W.partitionBy(*keys))})
    at = {name: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("m") - 1)), F.col(value))).alias(name) for name, q in (("p33", 0.333), ("p66", 0.666))}
    return placed.groupBy(*keys).agg(*at.values())


def bucket_of(value) -> Column:
    """The bucket of a length by the columns p33 and p66."""
    return F.when(value <= F.col("p33"), "short").when(value <= F.col("p66"), "medium").otherwise("long")


def with_length_bucket(reviews: DataFrame, keys: list[str], value: str = "charLen") -> DataFrame:
    """reviews with lengthBucket by the tertiles of their group."""
    bounds = tertile_bounds(reviews, keys, value)
    return reviews.join(bounds, keys).withColumn("lengthBucket", bucket_of(F.col(value))).drop("p33", "p66")


def stratum_index(positive: str = "isPositive"):
    """0 to 5: positive short, medium, long, then negative."""
    place = F.when(F.col("lengthBucket") == "short", 0).when(F.col("lengthBucket") == "medium", 1).otherwise(2)
    return place + F.when(F.col(positive) == 1, 0).otherwise(3)


def strata(apps: DataFrame) -> DataFrame:
    """All six strata of every app: two sentiments by three buckets."""
    six = F.array(*[F.struct(F.lit(s).alias("isPositive"), F.lit(b).alias("lengthBucket")) for s in (1, 0) for b in BUCKETS])
    return apps.select("appid", F.explode(six).alias("s")).select("appid", "s.isPositive", "s.lengthBucket")


def allocation(bucketed: DataFrame, cap: int = 150) -> DataFrame:
    """dealt() of the reviews' counts per stratum."""
    return dealt(bucketed.groupBy("appid", "isPositive", "lengthBucket").agg(F.count("*").alias("total")), cap)


def dealt(held: DataFrame, cap: int = 150) -> DataFrame:
    """(appid, isPositive, lengthBucket, stratum, total, target) from (appid, isPositive, lengthBucket, total): cap dealt to the strata by largest remainders.

    Equal remainders go to the higher stratum. An app with at most cap reviews keeps all. Doubles in the order
    (cap * total) / sum, as the rule states it.
    """
    rows = strata(held.select("appid").distinct()).join(held, ["appid", "isPositive", "lengthBucket"], "left").fillna(0, ["total"])
    app = W.partitionBy("appid")
    rows = rows.withColumns({"stratum": stratum_index(), "whole": F.sum("total").over(app)})
    rows = rows.withColumn("exact", (F.lit(cap) * F.col("total")).cast("double") / F.col("whole"))
    rows = rows.withColumn("floor", F.floor("exact")).withColumn("need", F.lit(cap) - F.sum("floor").over(app))
    place = F.row_number().over(app.orderBy(F.desc(F.col("exact") - F.col("floor")), F.desc("stratum")))
    target = F.when(F.col("whole") <= cap, F.col("total")).otherwise(F.col("floor") + (place <= F.col("need")).cast("long"))
    return rows.withColumn("target", target).select("appid", "isPositive", "lengthBucket", "stratum", "total", F.col("target").cast("long").alias("target"))


def is_even_pick(place, total, target):
    """Whether place (from 0) of `total` rows is among `target` evenly spaced centres floor((i + 0.5) * (n / k)).

    A place can only be the centre of an i next to place * k / n, so three of them are tested; all if k >= n.
    """
    guess = F.floor(place * target / total)
    hit = F.lit(False)
    for step in (-1, 0, 1):
        i = guess + step
        hit = hit | ((i >= 0) & (i < target) & (F.floor((i.cast("double") + 0.5) * (total.cast("double") / target)) == place))
    return F.when(target <= 0, False).when(target >= total, True).otherwise(hit)


def placed_by_time(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with place, from 0, in the order of (timestamp_created, reviewId as text) within keys; null times first.

    Days are counted first, so a task orders a day of a group and never a group.
    """
    day = F.coalesce(F.floor(F.col("timestamp_created") / DAY), F.lit(-(1 << 40)))
    rows = rows.withColumn("__day", day)
    before = rows.groupBy(*keys, "__day").agg(F.count("*").alias("__n"))
    ahead = W.partitionBy(*keys).orderBy("__day").rowsBetween(W.unboundedPreceding, -1)
    before = before.select(*keys, "__day", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy(*keys, "__day").orderBy("timestamp_created", F.col("reviewId").cast("string")))
    return rows.withColumn("__within", within).join(before, [*keys, "__day"]).withColumn("place", F.col("__before") + F.col("__within") - 1).drop("__day", "__before", "__within")


def stratified_sample(reviews: DataFrame, cap: int = 150) -> DataFrame:
    """reviews (appid, reviewId, isPositive, charLen, timestamp_created, ...) sampled, with lengthBucket and sampleIndexWithinApp.

    Rows with a null app or sentiment are in no stratum. Equal times go by id; rows equal in both may change places.
    """
    bucketed = with_length_bucket(reviews, ["appid", "isPositive"])
    plan = allocation(bucketed, cap).select("appid", "isPositive", "lengthBucket", "total", "target")
    rows = placed_by_time(bucketed, ["appid", "isPositive", "lengthBucket"]).join(plan, ["appid", "isPositive", "lengthBucket"])
    picked = rows.filter(is_even_pick(F.col("place"), F.col("total"), F.col("target"))).drop("place", "total", "target")
    index = F.row_number().over(W.partitionBy("appid").orderBy("timestamp_created", F.col("reviewId").cast("string")))
    return picked.withColumn("sampleIndexWithinApp", index)


def sampling_summary(reviews: DataFrame, sample: DataFrame, cap: int = 150) -> DataFrame:
    """App rows and stratum rows in one table; columns of the other grain are null.

    Reviews and sample go through one aggregation by grouping sets. Reviews with a null sentiment count for their app and are in no stratum;
    an app without sampled rows has null sample columns, a stratum without them selected 0 and no span.
    """
    bounds = tertile_bounds(reviews.filter("isPositive IS NOT NULL"), ["appid", "isPositive"])
    bucketed = reviews.join(bounds, ["appid", "isPositive"], "left").withColumn("lengthBucket", F.when(F.col("p33").isNotNull(), bucket_of(F.col("charLen"))))
    columns = ["appid", "isPositive", "lengthBucket", "timestamp_created"]
    both = bucketed.select(*columns, F.lit(False).alias("chosen")).unionByName(sample.select(*columns, F.lit(True).alias("chosen"))).filter("appid IS NOT NULL")
    both = both.withColumn("positive", F.col("isPositive"))  # the sets leave isPositive out of the app rows

    def side(chosen: bool, prefix: str) -> list[Column]:
        def own(c: str) -> Column:
            return F.when(F.col("chosen") == chosen, F.col(c))

        days = F.greatest(F.floor((F.max(own("timestamp_created")) - F.min(own("timestamp_created"))) / DAY), F.lit(0))
        n = F.count_if(F.col("chosen") == chosen)
        return [n.alias(f"{prefix}Reviews"), F.sum(own("positive")).alias(f"{prefix}Positive"), F.when(n > 0, days).alias(f"{prefix}SpanDays")]

    sets = [[F.col("appid")], [F.col(c) for c in columns[:3]]]
    counted = both.groupingSets(sets, *columns[:3]).agg(*side(False, "total"), *side(True, "sample"), (F.grouping("lengthBucket") == 1).alias("whole"))
    counted = saved(counted, "sampling_counts")  # seven rows an app
    sampled = F.when(F.col("sampleReviews") > 0, F.col("sampleReviews")).alias("sampleReviews")
    apps = counted.filter("whole AND totalReviews > 0").select("appid", "totalReviews", "totalPositive", "totalSpanDays", sampled, "samplePositive", "sampleSpanDays", F.lit("app").alias("grain"))
    groups = counted.filter("NOT whole AND isPositive IS NOT NULL AND lengthBucket IS NOT NULL")
    plan = dealt(groups.filter("totalReviews > 0").select("appid", "isPositive", "lengthBucket", F.col("totalReviews").alias("total")), cap).drop("stratum")
    chosen = groups.select("appid", "isPositive", "lengthBucket", F.col("sampleReviews").alias("selected"), F.col("sampleSpanDays").alias("stratumSpanDays"))
    rows = plan.join(chosen, ["appid", "isPositive", "lengthBucket"], "left").fillna(0, ["selected"]).withColumn("grain", F.lit("stratum"))
    return apps.unionByName(rows, allowMissingColumns=True)
