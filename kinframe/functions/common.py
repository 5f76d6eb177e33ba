"""Small column helpers shared by all plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wide(df: DataFrame) -> DataFrame:
    """``df`` as a side of its next join, by a shuffle: for tables that grow with the input, which would pass through
    the driver if their compressed size still fell under the broadcast threshold."""
    return df.hint("merge")


def r6(c: str | Column) -> Column:
    """Round a double to 6 decimals (float outputs are compared at this precision)."""
    return F.round(col(c).cast("double"), 6)
