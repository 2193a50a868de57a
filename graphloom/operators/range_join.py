"""Joins on an order comparison of one column of each side, without a product in one place.

Values are cut into bins at bounds taken from a sample. A left row stands in the bin of its value; a right row goes to
every bin that may hold partners, so pairs meet by an equal bin, and are compared. Bounds decide only how the
work is dealt, not what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins, and rows sampled for their bounds.
BINS, SAMPLE = 64, 20_000


def bounds(rows: DataFrame, column: str, bins: int = BINS, sample: int = SAMPLE) -> list:
    """Ascending values that cut a sample of the column into about equal parts; bounded, one small job."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).where(F.pmod(F.xxhash64("v"), F.lit(7)) == 0).limit(sample)
    held = sorted(r["v"] for r in values.collect())
    return sorted({held[len(held) * i // bins] for i in range(1, bins)}) if held else []


def bin_of(column: Column, cuts: list) -> Column:
    """How many of the cuts are at most the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= column)) if cuts else F.lit(0)


def range_join(left: DataFrame, x: str, op: str, right: DataFrame, y: str) -> DataFrame:
    """All pairs with x op y (<, <=, >, >=); columns of both sides, whose names differ. Nulls match nothing."""
    cuts = bounds(left, x)
    a = left.where(F.col(x).isNotNull()).withColumn("__bin", bin_of(F.col(x), cuts))
    own = bin_of(F.col(y), cuts)
    reach = F.sequence(F.lit(0), own) if op in ("<", "<=") else F.sequence(own, F.lit(len(cuts)))
    b = right.where(F.col(y).isNotNull()).withColumn("__to", F.explode(reach))
    compare = {"<": F.col(x) < F.col(y), "<=": F.col(x) <= F.col(y), ">": F.col(x) > F.col(y), ">=": F.col(x) >= F.col(y)}[op]
    return a.join(b, (F.col("__bin") == F.col("__to")) & compare).drop("__bin", "__to")
