"""Token counts and lexicon scores, per app and per review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.functions.numeric import renormalised
from critiq.functions.text import token_rows, tokens
from critiq.operators.ranking import percentiles
from critiq.sources.scratch import saved

FUN = ("Flow", "Utility", "Nostalgia")
#: So many terms in all are matched as a set inside the row; more are joined, with the same result.
TERMS_IN_ROW = 5_000


def read_lexicon(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (file, row, token and category, score or weight): distinct (token, category), and (token, score), the last score given."""
    token = F.lower(F.trim("token"))
    rows = rows.withColumn("token", token).filter("token IS NOT NULL AND token != ''")
    has = set(rows.columns)
    empty = rows.select("token").limit(0)
    categories = rows.filter("category IS NOT NULL AND trim(category) != ''").select("token", F.trim("category").alias("category")).distinct() if "category" in has else empty.withColumn("category", F.lit(""))
    number = next((c for c in ("score", "weight") if c in has), None)
    scores = rows.withColumn("s", F.col(number).try_cast("double")).filter("s IS NOT NULL").groupBy("token").agg(F.max_by("s", F.struct("file", "row")).alias("score")) if number else empty.withColumn("score", F.lit(0.0))
    return categories, scores


def _app_tokens(reviews: DataFrame, *keys: str, **options) -> DataFrame:
    return token_rows(reviews.filter("appid IS NOT NULL"), "review", *keys, **options)


def token_counts(reviews: DataFrame, **options) -> DataFrame:
    """(appid, token, count, freq_per_1000), summed up on each task before the shuffle. Reviews without an appid do not count.

    An app's counts stay dealt by token: its total is broadcast, a row per app, and left out where the frequency is not used.
    """
    counts = _app_tokens(reviews, "appid", **options).groupBy("appid", "token").agg(F.count("*").alias("count"))
    totals = counts.groupBy("appid").agg(F.sum("count").alias("__all"))
    return counts.join(F.broadcast(totals), "appid", "left").withColumn("freq_per_1000", F.col("count") * 1000.0 / F.col("__all")).drop("__all")


def overall_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.sum("count").alias("count"))


def corpus_counts(reviews: DataFrame, **options) -> DataFrame:
    """`overall_counts` of `token_counts`, without the counts per app between: tokens alone are summed up on each task and dealt."""
    return _app_tokens(reviews, **options).groupBy("token").agg(F.count("*").alias("count"))


def token_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("appid").agg(F.sum("count").alias("total_tokens"), F.count("*").alias("distinct_tokens"))


def category_rates(counts: DataFrame, lexicon: DataFrame, categories: list[str], per: int = 1000) -> DataFrame:
    """Count of each category's tokens per app, and per 1,000 tokens; absent ones 0."""
    found = counts.join(lexicon, "token").groupBy("appid").pivot("category", categories).agg(F.sum("count"))
    rows = token_totals(counts).join(found, "appid", "left").fillna(0, categories)
    return rows.select("appid", "total_tokens", "distinct_tokens", *[F.col(c).alias(f"{c}_count") for c in categories], *[(F.col(c) * float(per) / F.col("total_tokens")).alias(f"{c}_per_{per}") for c in categories])


def lexicon_scores(counts: DataFrame, scores: DataFrame, per: int = 1000) -> DataFrame:
    """Sum of scores, score per 1,000 tokens and hits per app."""
    found = counts.join(scores, "token").groupBy("appid").agg(F.sum(F.col("score") * F.col("count")).alias("score_sum"), F.sum("count").alias("hits"))
    rows = token_totals(counts).join(found, "appid", "left").fillna(0)
    return rows.select("appid", "score_sum", (F.col("score_sum") * per / F.col("total_tokens")).alias(f"score_per_{per}"), "hits")


def lexicon_coverage(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per category: its tokens, those that occur, and those that can never be one token.

    The lexicon's tokens are broadcast and looked up where texts are read, so a task sends on those it has met, not all its words.
    """
    terms = lexicon.select("token").distinct()
    seen = counts.select("token").join(F.broadcast(terms), "token", "left_semi").distinct().withColumn("__seen", F.lit(1))
    rows = lexicon.join(seen, "token", "left")
    return rows.groupBy("category").agg(F.count_distinct("token").alias("tokens"), F.count("__seen").alias("seen"), F.count(F.when(F.col("token").rlike("[^a-z0-9]"), 1)).alias("unreachable"))


def _hits(terms: list[str] | None) -> Column:
    return F.size(F.filter("__tokens", lambda t: t.isin(terms))) if terms else F.lit(0)


def review_scores(reviews: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """A row per review: token count, counts per category, shares among hits (null without any), per 100 tokens, and soft shares.

    Soft shares are the counts per token, None the rest, made to sum to 1; an empty review is all None. lexicon has
    FUN's categories, its terms as a set inside the row if there are not too many. Null text is an empty review; rows with
    null or repeated ids are scored one by one; an empty table gives no rows.
    """
    found = tokens(F.col("review"))
    few = sum(map(len, lexicon.values())) <= TERMS_IN_ROW
    rows = reviews.withColumn("__tokens", found).withColumn("n_tokens", F.size("__tokens"))
    if few:
        rows = rows.withColumns({f"{c}_count": _hits(lexicon.get(c)) for c in FUN})
    else:
        terms = reviews.sparkSession.createDataFrame([(t, c) for c, all_ in lexicon.items() for t in set(all_)], "token string, category string")
        # each row has a number of its own, so null and repeated ids keep their own hits
        kept = ["__row", "appid", "reviewId", "charLen", "isPositive", "n_tokens"]
        each = rows.withColumn("__row", F.monotonically_increasing_id()).select(*kept, F.explode_outer("__tokens").alias("token"))
        rows = each.join(terms, "token", "left").groupBy(*kept).agg(*[F.count_if(F.col("category") == c).alias(f"{c}_count") for c in FUN])
    counts = {c: F.col(f"{c}_count") for c in FUN}
    hits = reduce(lambda a, b: a + b, counts.values())
    n = F.greatest(F.lit(1), F.col("n_tokens"))
    raw = {c: v / n for c, v in counts.items()}
    raw["None"] = F.lit(1.0) - reduce(lambda a, b: a + b, raw.values())
    shares = renormalised(raw)
    return rows.withColumn("hits", hits).select(
        "appid", "reviewId", "charLen", "isPositive", "n_tokens", *[f"{c}_count" for c in FUN], "hits", (F.col("hits") == 0).alias("zero_hit"),
        *[F.when(F.col("hits") > 0, v / F.col("hits")).alias(f"{c}_prop") for c, v in counts.items()], *[(v * 100.0 / n).alias(f"{c}_per_100") for c, v in counts.items()],
        *[v.alias(f"{c}_share") for c, v in shares.items()],
    )


def app_aggregate(scores: DataFrame) -> DataFrame:
    """Per app: reviews, those with a hit, means and medians of shares among hits, means of the rest.

    Medians are exact (ranking.percentiles); null shares, of reviews without a hit, do not count, and an app without any has none.
    """
    averaged = ("n_tokens", "charLen", *[f"{c}_per_100" for c in FUN], *[f"{c}_share" for c in (*FUN, "None")])
    props = [f"{c}_prop" for c in FUN]
    rows = saved(scores.select("appid", "zero_hit", *props, *averaged), "scores")
    with_fun = F.count(F.when(~F.col("zero_hit"), 1))
    means = rows.groupBy("appid").agg(
        F.count("*").alias("n_reviews"), with_fun.alias("n_with_fun"), (with_fun * 100.0 / F.count("*")).alias("pct_with_fun"),
        ((F.count("*") - with_fun) * 100.0 / F.count("*")).alias("zero_hit_pct"), *[F.avg(c).alias(f"{c}_mean") for c in (*props, *averaged)],
    )
    medians = percentiles(rows, ["appid"], props, {"median": 0.5}).withColumnRenamed("appid", "__app")
    return means.join(medians, F.col("appid").eqNullSafe(F.col("__app")), "left").drop("__app")


def app_mix(scores: DataFrame) -> DataFrame:
    """Per app: each category's part of all hits (0 without any), and the share of reviews without a hit."""
    whole = F.sum("hits")
    mix = [F.when(whole > 0, F.sum(f"{c}_count") / whole).otherwise(0.0).alias(c) for c in FUN]
    return scores.groupBy("appid").agg(*mix, (F.count(F.when(F.col("zero_hit"), 1)) / F.count("*")).alias("z"))


def run_headlines(scores: DataFrame) -> DataFrame:
    """Totals over the run, and the mean of the apps' means."""
    apps = scores.groupBy("appid").agg(F.count("*").alias("n"), F.count(F.when(F.col("zero_hit"), 1)).alias("z"), F.avg("n_tokens").alias("t"))
    return apps.agg(F.count("*").alias("apps"), F.sum("n").alias("reviews"), F.sum("z").alias("zero_hit_reviews"), F.avg("t").alias("mean_of_mean_tokens"))


def ordered_columns(df: DataFrame, ids: tuple[str, ...] = ("appid", "reviewId")) -> DataFrame:
    """Ids, other columns, counts, rates, shares among hits, per 100, shares."""
    suffixes = ("_count", "_per_1000", "_prop", "_per_100", "_share")
    fun = [f"{c}{s}" for s in suffixes for c in (*FUN, "None") if f"{c}{s}" in df.columns]
    first = [c for c in ids if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in {*first, *fun}], *fun)
