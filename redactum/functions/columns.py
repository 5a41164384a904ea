"""Columns that are computed once, where they are defined."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``columns``, which the optimizer leaves where they are.

    It moves filters through projections, and merges projections, by writing out the
    columns' definitions. Where each column is built on the one before, as here, that
    multiplies the plan with every step. A condition that holds for every row, but not
    for the optimizer's eyes the same each time, keeps a definition in its place.
    """
    return df.withColumns({n: F.when(F.spark_partition_id() >= 0, c) for n, c in columns.items()})
