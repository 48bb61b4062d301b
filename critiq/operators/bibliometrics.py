"""Bibliometric aggregations.

Papers without a year, element or category count where these play no part only; rows that repeat are counted as often as
they are there unless a function says distinct. Empty tables give no rows, or one row of nulls where there is one row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from critiq.operators.ranking import first_per_key


def per_year(papers: DataFrame, year: str = "Year") -> DataFrame:
    """(year, n) on a full calendar, gaps 0."""
    counts = papers.filter(F.col(year).isNotNull()).groupBy(F.col(year).cast("int").alias("year")).agg(F.count("*").alias("n"))
    calendar = counts.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return calendar.join(counts, "year", "left").fillna(0, ["n"])


def density(yearly: DataFrame, years: int = 5) -> DataFrame:
    """n of each year and of the following ones. The window sees one row per year."""
    return yearly.withColumn("density", F.sum("n").over(W.orderBy("year").rangeBetween(0, years - 1)))


def growth(yearly: DataFrame) -> DataFrame:
    """(slope, growth): least squares of ln n on the year over years with papers, and e^slope - 1."""
    rows = yearly.filter("n > 0").select(F.log(F.col("n").cast("double")).alias("y"), F.col("year").cast("double").alias("x"))
    return rows.agg(F.regr_slope("y", "x").alias("slope")).withColumn("growth", F.exp("slope") - 1)


def elements(papers: DataFrame, key: str = "ID", column: str = "Design Element") -> DataFrame:
    """(key, element): the list's distinct, trimmed entries."""
    return papers.select(key, F.explode(F.split(column, "[;,]")).alias("e")).select(key, F.trim("e").alias("element")).filter("element != ''").distinct()


def element_counts(exploded: DataFrame) -> DataFrame:
    return exploded.groupBy("element").agg(F.count("*").alias("n"))


def paper_categories(exploded: DataFrame, membership: DataFrame, categories: list[str], key: str = "ID") -> DataFrame:
    """(key, category) through (element, flag per category)."""
    flags = F.array(*[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.lit(c)) for c in categories])
    pairs = membership.select("element", F.explode(F.array_compact(flags)).alias("category"))
    return exploded.join(pairs, "element").select(key, "category").distinct()


def category_totals(of_papers: DataFrame) -> DataFrame:
    """(category, n, radius): papers and the circle's radius, the root of n / pi."""
    return of_papers.groupBy("category").agg(F.count("*").alias("n")).withColumn("radius", F.sqrt(F.col("n") / F.pi()))


def cooccurrence(of_papers: DataFrame, categories: list[str], key: str = "ID") -> DataFrame:
    """(a, b, n): papers with both categories; a = b counts those with that category only.

    A paper's set of categories is as long as the category list at most, so pairs stay within a row.
    """
    sets = of_papers.groupBy(key).agg(F.array_sort(F.collect_set("category")).alias("c"))
    names = sorted(categories)
    both = [F.when(F.array_contains("c", a) & F.array_contains("c", b), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in combinations(names, 2)]
    alone = [F.when((F.size("c") == 1) & F.array_contains("c", a), F.struct(F.lit(a).alias("a"), F.lit(a).alias("b"))) for a in names]
    return sets.select(F.explode(F.array_compact(F.array(*both, *alone))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def facet_counts(papers: DataFrame, facets: list[str]) -> DataFrame:
    """(n_facets, papers) and how many of them fill each facet."""
    filled = {f: F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) != "", 1).otherwise(0) for f in facets}
    rows = papers.select(*[v.alias(f) for f, v in filled.items()])
    return rows.groupBy(sum([F.col(f) for f in facets[1:]], F.col(facets[0])).alias("n_facets")).agg(F.count("*").alias("papers"), *[F.sum(f).alias(f) for f in facets])


def source_totals(papers: DataFrame, title: str, source: str, *order) -> DataFrame:
    """(source, found, kept): papers per source, and those that no earlier source had."""
    kept = first_per_key(papers, [title], *order).groupBy(source).agg(F.count("*").alias("kept"))
    return papers.groupBy(source).agg(F.count("*").alias("found")).join(kept, source, "left").fillna(0, ["kept"])


def venue_counts(papers: DataFrame, venue: str) -> DataFrame:
    return papers.groupBy(venue).agg(F.count("*").alias("n"))
