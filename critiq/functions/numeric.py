"""Numbers: safe casts, shares, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = ("Flow", "Utility", "Nostalgia", "None")


def to_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def to_long(c: Column, default: int = 0) -> Column:
    """Whole part of any number written as text; default where there is none. Whole numbers keep all their digits."""
    return F.coalesce(F.when(c.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), c.try_cast("long")), c.try_cast("double").try_cast("long"), F.lit(default)).cast("long")


def share(part: Column, whole: Column) -> Column:
    """part / whole; null where whole is 0."""
    return F.when(whole != 0, part / whole)


def renormalised(columns: dict[str, Column], last: str = "None") -> dict[str, Column]:
    """The columns cut to 0..1 and divided by their sum; all 0: `last` is 1."""
    cut = {k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))) for k, c in columns.items()}
    total = sum(list(cut.values())[1:], list(cut.values())[0])
    return {k: F.when(total > 0, c / total).otherwise(F.lit(1.0 if k == last else 0.0)) for k, c in cut.items()}
