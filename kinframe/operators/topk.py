"""Top-k per group that stays balanced when one group is huge.

Stage 1 ranks inside (group, salt) sub-groups, so a hot group is split over
``salts`` tasks; stage 2 ranks the at most ``salts * k`` survivors per group.
The result equals a plain per-group ``row_number() <= k`` (ties are broken by
the full ``order`` list, which callers end with a unique column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    salt_cols: Sequence[str] | None = None, salts: int = 32,
                    rank_col: str = "rank") -> DataFrame:
    salt_src = [F.col(c) for c in (salt_cols or df.columns)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salts)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    pre = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (pre.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
            .drop("_salt", "_r1"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k: ``orderBy().limit()`` plans as TakeOrderedAndProject
    (per-partition top-k, then a merge of k rows per partition)."""
    return df.orderBy(*order).limit(k)
