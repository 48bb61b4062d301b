"""Comparison of scoring methods: correlations, divergence, two-group test.

Rows with a null or NaN on either side are left out; equal values share their mean rank; repeated rows count as often as
they are there. Without rows correlations and divergence have none, the two-group test one row of zeros and nulls.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.functions.numeric import DIMENSIONS
from critiq.operators.ranking import ROWS_PER_RANGE, average_rank, value_ranks
from critiq.sources.scratch import saved


def compared(dictionary: DataFrame, model: DataFrame, counts: tuple[str, ...] = (), confidence: tuple[str, ...] = ()) -> DataFrame:
    """(appid, counts, <dimension>_dict, <dimension>_llm, confidence): both methods' shares for the apps that both have.

    counts are columns of the dictionary's table to carry along, confidence of the model's. Null appids match nothing; an
    app that stands twice in a table is compared twice.
    """
    left = dictionary.select("appid", *counts, *[F.col(k).alias(f"{k}_dict") for k in DIMENSIONS])
    return left.join(model.select("appid", *[F.col(k).alias(f"{k}_llm") for k in DIMENSIONS], *confidence), "appid")


def by_dimension(both: DataFrame) -> DataFrame:
    """(dimension, x, y): the shares of the two methods, a row per app and dimension; pairs with a null or NaN are left out."""
    each = [F.struct(F.lit(k).alias("dimension"), F.col(f"{k}_dict").cast("double").alias("x"), F.col(f"{k}_llm").cast("double").alias("y")) for k in DIMENSIONS]
    return both.select(F.inline(F.array(*each))).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def pearson(both: DataFrame) -> DataFrame:
    """(dimension, r, n). A dimension without a pair has no row; r is null where one side does not vary."""
    return by_dimension(both).groupBy("dimension").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def spearman(both: DataFrame) -> DataFrame:
    """(dimension, rho, n): the same on average ranks, all dimensions at once."""
    rows = saved(by_dimension(both), "both")
    rows = average_rank(average_rank(rows, "x", "rx", ("dimension",)), "y", "ry", ("dimension",))
    return rows.groupBy("dimension").agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def kl_divergence(both: DataFrame, scale: float = 1.0, eps: float = 1e-9) -> DataFrame:
    """(dimension, kl): sum of p ln(p / q) over apps, p and q divided by scale, cut to [eps, 1] and made to sum to 1."""
    cut = [F.greatest(F.lit(eps), F.least(F.lit(1.0), F.col(c) / scale)).alias(to) for c, to in (("x", "p"), ("y", "q"))]
    # sum p ln(p/q) / P - ln(P/Q), with P and Q the sums of the cut values
    kl = F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))) / F.sum("p") - F.log(F.sum("p") / F.sum("q"))
    return by_dimension(both).select("dimension", *cut).groupBy("dimension").agg(kl.alias("kl"))


def mann_whitney(rows: DataFrame, value: str, high: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row (n1, n2, u, z, p) for the values where `high` holds against the rest; normal approximation with ties.

    Both groups are counted by value; the values are ranked by ranges, so no task holds them all.
    """
    data = rows.select(F.col(value).alias("v"), F.col(high).alias("g")).filter("v IS NOT NULL AND g IS NOT NULL")
    counts = saved(data.groupBy("v").agg(F.count("*").alias("__n"), F.count(F.when(F.col("g"), 1)).alias("high")), "value_counts")
    ranks = value_ranks(counts.select("v", "__n"), "v", "r", rows_per_range=rows_per_range).join(counts.select("v", "high"), "v")
    t = F.col("__n").cast("double")
    one = ranks.agg(
        F.coalesce(F.sum("high"), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.col("__n") - F.col("high")), F.lit(0)).alias("n2"),
        F.sum(F.when(F.col("high") > 0, F.col("high") * F.col("r"))).alias("r1"), F.sum(t * t * t - t).alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    one = one.select("n1", "n2", u.alias("u"), F.when(spread > 0, (u - n1 * n2 / 2) / spread).alias("z"))
    # two-sided p by Zelen and Severo's approximation of the normal tail, within 1e-7
    a = F.abs("z")
    t = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return one.withColumn("p", F.least(F.lit(1.0), 2 * tail))
