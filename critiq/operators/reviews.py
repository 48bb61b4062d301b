"""Review pages to review rows, de-duplication, resume and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.operators.ranking import at_most_per_key, first_per_key

REVIEW = (
    "struct<recommendationid:string,author:struct<steamid:string,num_games_owned:long,num_reviews:long,playtime_forever:long,playtime_last_two_weeks:long,"
    "playtime_at_review:long,last_played:long>,language:string,review:string,timestamp_created:long,timestamp_updated:long,voted_up:boolean,"
    "votes_up:long,votes_funny:long,weighted_vote_score:string,comment_count:long,steam_purchase:boolean,received_for_free:boolean,"
    "written_during_early_access:boolean,primarily_steam_deck:boolean>"
)
PAGE = f"success int, query_summary struct<num_reviews:long,total_reviews:long,total_positive:long,total_negative:long>, reviews array<{REVIEW}>, cursor string"


def flatten_pages(pages: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """From (appid, page, json): a row per review with typed columns and defaults; context's columns are joined on appid."""
    rows = pages.withColumn("p", F.from_json("json", PAGE)).select("appid", "page", F.posexplode("p.reviews").alias("at", "r"))
    no, zero = F.lit(False), F.lit(0)
    flat = rows.select(
        "appid", F.col("r.recommendationid").alias("reviewId"), F.coalesce("r.language", F.lit("english")).alias("language"), F.coalesce("r.review", F.lit("")).alias("review"),
        F.coalesce("r.voted_up", no).cast("int").alias("isPositive"), F.coalesce("r.voted_up", no).alias("voted_up"),
        *[F.coalesce(f"r.{c}", zero).cast("long").alias(c) for c in ("timestamp_created", "timestamp_updated", "comment_count", "votes_up", "votes_funny")],
        F.col("r.author.steamid").alias("authorSteamId"), *[F.coalesce(f"r.author.{c}", zero).cast("long").alias(c) for c in ("playtime_forever", "playtime_last_two_weeks")],
        *[F.coalesce(f"r.{c}", no).alias(c) for c in ("received_for_free", "written_during_early_access", "steam_purchase")], F.col("r.weighted_vote_score").alias("weighted_vote_score"),
        F.length(F.coalesce("r.review", F.lit(""))).alias("charLen"), "page", "at",
    )
    return flat if context is None else flat.join(context, "appid", "left")


def deduplicated(reviews: DataFrame, *order: str) -> DataFrame:
    """The first row of each (appid, reviewId) in the stated order; null ids are a key of their own, rows equal in the order may change places."""
    return first_per_key(reviews, ["appid", "reviewId"], *[F.col(c) for c in order])


def capped(reviews: DataFrame, n: int, *order: str) -> DataFrame:
    return at_most_per_key(reviews, ["appid"], n, *[F.col(c) for c in order])


def not_in(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known; null equals null."""
    seen = known.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return rows.join(seen, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")


def only_in(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    seen = wanted.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return rows.join(seen, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return not_in(old, new, keys).unionByName(new)


def with_defaults(reviews: DataFrame) -> DataFrame:
    """charLen and isPositive where the column or the value is missing: the text's length, and voted_up; 0 without either.

    An isPositive that is no number counts as missing.
    """
    out = reviews if "charLen" in reviews.columns else reviews.withColumn("charLen", F.lit(None).cast("int"))
    out = out.withColumn("charLen", F.coalesce("charLen", F.length(F.coalesce("review", F.lit("")))))
    voted = F.col("voted_up").cast("int") if "voted_up" in out.columns else F.lit(None).cast("int")
    have = F.col("isPositive").try_cast("double").cast("int") if "isPositive" in out.columns else F.lit(None).cast("int")
    return out.withColumn("isPositive", F.coalesce(have, voted, F.lit(0)))
