"""Global order at scale, top rows, first rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from critiq.sources.scratch import saved

#: Rows that one task may rank. A larger table is cut into ranges of the sort key first.
ROWS_PER_RANGE = 1_000_000


def _borders(df: DataFrame, column: str, parts: int) -> list[float]:
    """Ascending values that cut the column into about equal parts; at most parts - 1 of them come to the driver."""
    return sorted(set(df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.1 / parts)))


def _place(value: Column, borders: list[float]) -> Column:
    """How many of the ascending borders are at most the value: a binary search, so a row costs the logarithm of their number."""
    if not borders:
        return F.lit(0)
    array, steps = F.lit(borders), [1 << i for i in reversed(range(len(borders).bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda low, step: F.when((low + step <= len(borders)) & (F.get(array, low + step - 1) <= value), low + step).otherwise(low))


def global_rank(df: DataFrame, score: str, tie: str, name: str = "rank", rows_per_range: int = ROWS_PER_RANGE, n: int | None = None) -> DataFrame:
    """Row numbers from 1 by score descending, then the numeric column `tie`. n is the number of rows, counted if not given.

    Borders of score split the rows into ranges; rows on a border (blocks of equal scores) are split again by `tie`.
    Ranges are counted, and a row's number is what the ranges before hold plus its place in its own. The result does
    not depend on where the borders fall. Null scores come last; rows equal in both columns are numbered in any order.
    """
    n = df.count() if n is None else n
    parts = -(-n // rows_per_range)
    if parts <= 1:  # one task may rank them all
        return df.withColumn(name, F.row_number().over(W.orderBy(F.desc(score), F.asc(tie))).cast("long"))
    borders, ties = _borders(df, score, parts), _borders(df, tie, parts)
    rows = df.withColumn("__at", F.when(F.col(score).isNull(), -1).otherwise(_place(F.col(score).cast("double"), borders)))
    on_border = (F.col("__at") > 0) & (F.get(F.lit(borders or [0.0]), F.col("__at") - 1) == F.col(score).cast("double"))
    inside = F.when(on_border | (F.col("__at") == -1), _place(F.col(tie).cast("double"), ties)).otherwise(-1)
    # descending: above a border comes before on it
    rows = rows.withColumns({"__range": -2 * F.col("__at") + F.when(on_border, 1).otherwise(0), "__sub": inside}).drop("__at")
    counts = rows.groupBy("__range", "__sub").count()
    # one row per range: a few for each rows_per_range rows
    before = counts.select("__range", "__sub", F.coalesce(F.sum("count").over(W.orderBy("__range", "__sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("__range", "__sub").orderBy(F.desc(score), F.asc(tie)))
    placed = rows.withColumn("__place", place).join(F.broadcast(before), ["__range", "__sub"])
    return placed.withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__sub", "__place", "__before")


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the stated order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def at_most_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def _cut(counts: DataFrame, value: str, keys: list[str], rows_per_range: int) -> tuple[DataFrame, DataFrame]:
    """counts (keys, value, __n) with __range, and a row for each (keys, __range) with __before and __all: rows ahead of the range and in all.

    Borders cut all values into ranges of about rows_per_range, so what a key has in one range is no more than that. The sums over
    ranges see a row per range: a few for each rows_per_range rows.
    """
    parts = -(-counts.count() // rows_per_range)
    borders = _borders(counts, value, parts) if parts > 1 else []
    placed = counts.withColumn("__range", _place(F.col(value).cast("double"), borders))
    cells = placed.groupBy(*keys, "__range").agg(F.sum("__n").alias("__held"))
    line = W.partitionBy(*keys).orderBy("__range")
    before = F.sum("__held").over(line.rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("__held").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return placed, cells.withColumns({"__before": F.coalesce(before, F.lit(0)), "__all": total})


def _ahead(placed: DataFrame, cells: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The rows of those cells with __ahead, the number of rows with a smaller value. A task orders a range of a key, never a key."""
    inside = W.partitionBy(*keys, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    named = cells.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__range").alias("__cell"), "__before", "__all")
    rows = placed.join(named, [*[F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], F.col("__range") == F.col("__cell")])
    rows = rows.select(*keys, value, "__n", "__range", "__before", "__all")
    return rows.withColumn("__ahead", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))


def value_ranks(counts: DataFrame, value: str, name: str, keys: tuple[str, ...] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(keys, value, __n, name) from (keys, value, __n), a row per value: ranks from 1 ascending, the mean of the __n places that equal values take."""
    rows = _ahead(*_cut(counts, value, list(keys), rows_per_range), value, list(keys))
    return rows.select(*keys, value, "__n", (F.col("__ahead") + (F.col("__n") + 1) / 2).alias(name))


def average_rank(df: DataFrame, value: str, name: str, keys: tuple[str, ...] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with ranks from 1 ascending within keys, equal values with their mean rank. Values are counted first and ranked by value_ranks."""
    counts = saved(df.groupBy(*keys, value).agg(F.count("*").alias("__n")), "value_counts")
    return df.join(value_ranks(counts, value, name, keys, rows_per_range).drop("__n"), [*keys, value])


def percentiles(df: DataFrame, keys: list[str], columns: list[str], places: dict[str, float], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(keys, <column>_<name>): exact percentiles of every column for every key, by name -> share in `places`, interpolated between neighbours.

    Values of all keys and columns are counted together, ranges of values are counted, and only the ranges that hold a wanted
    place are ordered. Nulls do not count; a column without values is null; a key whose columns all lack values has no row.
    """
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("__column"), F.col(c).cast("double").alias("__value")) for c in columns]))
    rows = df.select(*keys, each).filter("__value IS NOT NULL")
    counts = saved(rows.groupBy(*keys, "__column", "__value").agg(F.count("*").alias("__n")), "value_counts")
    own = [*keys, "__column"]
    placed, cells = _cut(counts, "__value", own, rows_per_range)

    def exact(share: float) -> Column:
        return (F.col("__all") - 1) * F.lit(float(share))

    ends = [end(exact(q)) for q in places.values() for end in (F.floor, F.ceil)]
    wanted = cells.filter(F.exists(F.array(*ends), lambda p: (p >= F.col("__before")) & (p < F.col("__before") + F.col("__held"))))
    found = _ahead(placed, wanted, "__value", own)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__ahead") <= place) & (place < F.col("__ahead") + F.col("__n")), F.col("__value")))

    values = [F.struct(at(F.floor(exact(q))).alias("low"), at(F.ceil(exact(q))).alias("high"), F.max(exact(q) - F.floor(exact(q))).alias("part")).alias(n) for n, q in places.items()]
    groups = found.groupBy(*own).agg(*values)
    between = {n: F.col(f"{n}.low") + F.col(f"{n}.part") * (F.col(f"{n}.high") - F.col(f"{n}.low")) for n in places}
    wide = [F.max(F.when(F.col("__column") == c, between[n])).alias(f"{c}_{n}") for c in columns for n in places]
    return groups.groupBy(*keys).agg(*wide) if keys else groups.agg(*wide)
