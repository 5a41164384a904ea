"""Intervals of a record that overlap: a join that does not look at every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Offsets in a bin. A bin's words are met by the spans that reach into it, and no others.
BIN = 512


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str = "start", end: str = "end", size: int = BIN) -> DataFrame:
    """Columns of ``left`` and those of ``right``, but for the key, of all pairs of intervals that overlap within a record.

    ``right`` names its interval ``start_`` and ``end_``; other columns have different
    names on either side. Both sides are dealt to the bins of offsets that they reach
    into and meet by record and bin; a pair that shares several bins counts in the first
    of them. Time follows the number of intervals and of pairs found, not the product of
    the two sides. Empty intervals overlap with what they lie strictly inside of.
    """

    def dealt(df: DataFrame, a: str, b: str, first: str) -> DataFrame:
        low = F.floor(F.col(a) / size)
        high = F.floor(F.greatest(F.col(b) - 1, F.col(a)) / size)
        return df.withColumn(first, low).withColumn("bin_", F.explode(F.sequence(low, high)))

    met = dealt(left, start, end, "first_").join(dealt(right, "start_", "end_", "other_"), [key, "bin_"])
    met = met.where((F.col(start) < F.col("end_")) & (F.col(end) > F.col("start_")) & (F.col("bin_") == F.greatest("first_", "other_")))
    return met.drop("bin_", "first_", "other_")
