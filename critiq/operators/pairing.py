"""Matched top and bottom pairs with distinct genres, and differences within pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.functions.text import genre_label
from critiq.operators.ranking import first_per_key

# Labels that are passed over, and labels that are no genre of a game.
JUMP_LABELS = ("free to play", "early access")
NON_GAME_LABELS = ("utilities", "software", "web publishing", "design and illustration", "design & illustration", "audio production",
                   "video production", "photo editing", "education", "animation and modeling", "animation & modeling", "typing")


def with_first_genre(details: DataFrame, jump=JUMP_LABELS, non_game=NON_GAME_LABELS, fold: bool = True) -> DataFrame:
    """firstGenre: the first of the first three genres that is neither passed over nor no game's; allGenres: all, joined."""
    refused = [*jump, *non_game]
    labels = F.expr("slice(genres, 1, 3)")
    exploded = details.select("appid", F.posexplode(labels).alias("at", "genre"))
    exploded = exploded.withColumn("label", genre_label(F.col("genre"), fold))
    first = exploded.filter(~F.col("label").isin(refused) & (F.col("label") != "")).groupBy("appid").agg(F.min_by("genre", "at").alias("firstGenre"), F.min_by("label", "at").alias("genreKey"))
    return details.join(first, "appid", "left").withColumn("allGenres", F.array_join("genres", ", "))


def pair_candidates(ranked: DataFrame, details: DataFrame, english: DataFrame, min_english: int = 50) -> DataFrame:
    """Ranked rows of games with a first genre and enough English reviews. english: appid, total_reviews and the two parts."""
    count = english.select("appid", F.coalesce("total_reviews", F.col("total_positive") + F.col("total_negative"), F.lit(0)).cast("long").alias("englishReviews"))
    rows = ranked.join(details, "appid").join(count, "appid")
    return rows.filter("ok AND type = 'game' AND firstGenre IS NOT NULL").filter(F.col("englishReviews") >= min_english)


def select_pairs(candidates: DataFrame, rank: str = "rankFiltered", pairs: int = 5) -> DataFrame:
    """Pairs from both ends of the ranking; a genre serves once, and the ends do not cross.

    A row that the walk passes has a genre in use already, so from the top only a genre's first candidate can be
    taken, from the bottom only its last. The loop on the driver sees the 2 * pairs + 1 genres next to either end. Ranks
    are distinct; rows with a null genre are of one genre. Fewer genres give fewer pairs, an empty table none.
    """
    ends = candidates.groupBy("genreKey").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    # a walk passes the genres in use, two for each pair chosen, so it never looks further than this from either end
    reach = 2 * pairs + 1
    seen = ends.orderBy("first").limit(reach).unionByName(ends.orderBy(F.desc("last")).limit(reach)).collect()
    from_top = sorted({(x["first"], x["genreKey"]) for x in seen})
    from_bottom = sorted({(x["last"], x["genreKey"]) for x in seen}, reverse=True)
    used, chosen, low, high = set(), [], -1, float("inf")
    while len(chosen) < pairs:
        a = next(((p, g) for p, g in from_top if g not in used and low < p < high), None)
        b = a and next(((p, g) for p, g in from_bottom if g not in used | {a[1]} and a[0] < p < high), None)
        if not b:
            break
        chosen.append((a[0], b[0]))
        used |= {a[1], b[1]}
        low, high = a[0], b[0]
    rows = [(i + 1, kind, p) for i, pair in enumerate(chosen) for kind, p in zip(("top", "bottom"), pair, strict=True)]
    picked = candidates.sparkSession.createDataFrame(rows, f"pairIndex int, type string, {rank} long")
    return candidates.drop("type").join(F.broadcast(picked), rank)


def pair_deltas(per_app: DataFrame, pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """For each pair with both sides: every metric of top and bottom, and their difference. An appid in several pairs counts in the first."""
    rows = per_app.select(F.col("appid").cast("string").alias("appid"), *metrics).join(first_per_key(pairs.select("pairIndex", "type", F.col("appid").cast("string").alias("appid")), ["appid"], F.col("pairIndex"), F.desc("type")), "appid")
    sides = [F.max(F.when(F.col("type") == side, F.col(m))).alias(f"{m}_{side}") for m in metrics for side in ("top", "bottom")]
    both = rows.groupBy("pairIndex").agg(*sides, F.max(F.col("type") == "top").alias("__t"), F.max(F.col("type") == "bottom").alias("__b")).filter("__t AND __b").drop("__t", "__b")
    return both.withColumns({f"{m}_diff": F.col(f"{m}_top") - F.col(f"{m}_bottom") for m in metrics})
