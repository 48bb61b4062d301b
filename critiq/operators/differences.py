"""What two tables differ in, moving only the rows that may differ.

Both sides are cut into buckets by a hash of the compared columns. Of each bucket the tasks sum up checksums that do not depend on
the order of rows; only buckets whose checksums differ are shuffled and compared row by row. Equal tables move checksums alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.sources.scratch import saved

#: Buckets of either side; so many bucket numbers reach the driver at most.
BUCKETS = 4096


def _hashed(rows: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """rows with __bucket and two 64-bit hashes; a null is told from every value and from a null in another column."""
    parts = [p for c in columns for p in (F.col(c).isNull(), F.col(c))]
    first = F.xxhash64(*parts)
    return rows.withColumns({"__one": first, "__two": F.xxhash64(F.lit("again"), *parts), "__bucket": F.pmod(first, F.lit(buckets)).cast("int")})


def _checksums(hashed: DataFrame, side: int) -> DataFrame:
    """(__bucket, __n, four sums of half hashes, positive on side 1 and negative on side 0)."""
    sign = 1 if side else -1
    halves = [F.sum(sign * half).alias(f"{c}_{i}") for c in ("__one", "__two") for i, half in enumerate((F.col(c).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.col(c), 32)))]
    return hashed.groupBy("__bucket").agg(F.sum(F.lit(sign)).alias("__n"), *halves)


def differing_parts(left: DataFrame, right: DataFrame, columns: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """left and right without the buckets in which both hold the same rows of `columns`, as often; both are empty if the tables are equal.

    Sides are told apart by 128 bits of sums per bucket. The columns have the same types on both sides. Both sides are written once, so
    callers pass no more columns than they need.
    """
    left, right = saved(left, "left"), saved(right, "right")
    a, b = _hashed(left, columns, buckets), _hashed(right, columns, buckets)
    sums = _checksums(a, 0).unionByName(_checksums(b, 1))
    names = [c for c in sums.columns if c != "__bucket"]
    off = sums.groupBy("__bucket").agg(*[F.sum(c).alias(c) for c in names]).filter(" OR ".join(f"{c} != 0" for c in names))
    numbers = [r["__bucket"] for r in off.select("__bucket").collect()]  # BUCKETS at most
    return tuple(side.filter(F.col("__bucket").isin(numbers)).drop("__one", "__two", "__bucket") for side in (a, b))
