"""Catalogue scores: acceptance, ranks, slices by position.

Counts that are null or no numbers are 0, and an app without reviews scores 0. Equal scores go by appid as a number. Empty
catalogues give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.functions.numeric import to_long
from critiq.operators.ranking import first_per_key, global_rank


def acceptance(catalog: DataFrame, decimals: int = 6) -> DataFrame:
    """From (appid, name, positive, negative): counts, posRate, popularity (natural log of the total) and their product."""
    rows = catalog.withColumns({"posReview": to_long(F.col("positive")), "negReview": to_long(F.col("negative"))}).withColumn("totReview", F.col("posReview") + F.col("negReview"))
    some = F.col("totReview") > 0
    rate, popularity = F.col("posReview") / F.col("totReview"), F.log(F.col("totReview").cast("double"))
    metrics = {"posRate": rate, "popularity": popularity, "acceptanceScore": rate * popularity}
    return rows.select("appid", "name", "posReview", "negReview", "totReview", *[F.when(some, F.round(m, decimals)).otherwise(0.0).alias(k) for k, m in metrics.items()])


def ranked(scored: DataFrame, name: str = "rankAcceptance", n: int | None = None) -> DataFrame:
    """1..n by score descending, then appid as a number (appids that are no numbers last). n: the number of rows, counted if not given."""
    keyed = scored.withColumn("__app", F.col("appid").try_cast("long"))
    return global_rank(keyed, "acceptanceScore", "__app", name, n=n).drop("__app")


def eligible(scored: DataFrame, min_reviews: int = 50) -> DataFrame:
    """Rows with enough reviews, one per appid, the best."""
    return first_per_key(scored.filter(F.col("totReview") >= min_reviews), ["appid"], F.desc("acceptanceScore"), F.desc("totReview"), F.col("name"))


def quartile_slice(scored: DataFrame, mode: str = "keep_mid") -> DataFrame:
    """Rows whose position in the order by score lies between the quartiles (keep_mid), outside (keep_extremes), or all.

    Fewer than four rows are all kept. rankFiltered is the position among the rows kept.
    """
    n = scored.count()
    rows = ranked(scored, "rankAcceptance", n)
    q1, q3 = int(n * 0.25), int(n * 0.75)
    position = F.col("rankAcceptance") - 1
    middle = (position >= q1) & (position < q3)
    if n >= 4 and mode != "keep_all":
        rows = rows.filter(middle if mode == "keep_mid" else ~middle)
    skipped = F.lit(0)
    if n >= 4 and mode == "keep_mid":
        skipped = F.lit(q1)
    elif n >= 4 and mode == "keep_extremes":
        skipped = F.when(position >= q3, q3 - q1).otherwise(0)
    return rows.withColumn("rankFiltered", F.col("rankAcceptance") - skipped)


def quartile_borders(scored: DataFrame) -> DataFrame:
    """(position, appid, acceptanceScore) at the first and last place and on both sides of the quartiles."""
    n = scored.count()
    q1, q3 = int(n * 0.25), int(n * 0.75)
    wanted = [p for p in sorted({0, q1 - 1, q1, q3 - 1, q3, n - 1}) if 0 <= p < n]
    return ranked(scored, n=n).select((F.col("rankAcceptance") - 1).alias("position"), "appid", "acceptanceScore").filter(F.col("position").isin(wanted))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)
