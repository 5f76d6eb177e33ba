"""Previous-row lookup and running sums within a key, safe for hot keys.

``Window.partitionBy(key)`` sends every row of one key to one task; when one
key holds a third of the data that task holds a third of the data. Here rows
are range-partitioned on (key, order...) by Spark, the partition number is kept
as the *bucket* of the row, and this layout is checkpointed once, so that every
later read (and every recomputation) sees the same buckets. A hot key spans
many buckets.

* within a bucket, windows run over ``Window.partitionBy(bucket, key)``;
* what crosses a bucket's edge comes from a table with one row per bucket (the
  last row, for lag) or per bucket and key (the total, for running sums).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinframe.functions.common import wide
from kinframe.session import ensure_checkpoint_dir


def _bucketed(df: DataFrame, sort_cols: Sequence[str], buckets: int | None) -> DataFrame:
    """``df`` laid out in ranges of ``sort_cols``, with the range number as ``_b``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *sort_cols).withColumn("_b", F.spark_partition_id()).checkpoint()


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of column pairs."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def previous_in_group(df: DataFrame, key: str, order: Sequence[str], carry: Sequence[str],
                      prefix: str = "prev_", buckets: int | None = None) -> DataFrame:
    """Add ``prefix + c`` for each ``c`` in ``carry``: value on the preceding row
    of the same ``key`` when rows are ordered by ``order`` (null on the first).

    ``order`` must make the order total within a key (end it with a unique id).
    A null key is a key of its own.
    """
    cols = [key, *order, *[c for c in carry if c not in (key, *order)]]
    sort_cols = [key, *order]
    bucketed = _bucketed(df.select(*cols), sort_cols, buckets)

    w = Window.partitionBy("_b", key).orderBy(*order)
    local = bucketed.select(
        *cols, "_b",
        *[F.lag(c).over(w).alias(prefix + c) for c in carry],
        (F.row_number().over(w) == 1).alias("_head"))

    # Last row of every bucket: one row per bucket, a proven small side.
    last = F.max_by(F.struct(*[F.col(c).alias("k_" + c) for c in [key, *carry]]),
                    F.struct(*[F.col(c) for c in sort_cols]))
    # ranges may be empty: the row before a bucket is the last of the nearest one that is not
    tails = (bucketed.groupBy("_b").agg(last.alias("t"))
             .select(F.lead("_b").over(Window.orderBy("_b")).alias("_fix_b"), F.col("t.k_" + key).alias("_fix_key"),
                     *[F.col("t.k_" + c).alias("_fix_" + c) for c in carry]))
    joined = local.join(
        F.broadcast(tails), (F.col("_b") == F.col("_fix_b")) & F.col("_head") & F.col(key).eqNullSafe(F.col("_fix_key")),
        "left")
    return joined.select(
        *[F.col(c) for c in cols],
        *[F.when(F.col("_head"), F.col("_fix_" + c)).otherwise(F.col(prefix + c)).alias(prefix + c)
          for c in carry])


def running_sums(df: DataFrame, key: Sequence[str], order: Sequence[str], sums: dict[str, str],
                 inclusive: bool = True, buckets: int | None = None) -> DataFrame:
    """Running totals (``out -> value``) within ``key`` in ``order`` (a total order), in one layout.

    Replaces ``sum(value) OVER (PARTITION BY key ORDER BY order)``, whose
    un-keyed form is a single-partition window: each bucket sums locally; the
    totals (one row per bucket and key) give every run its offset. A null key is
    a key of its own.
    """
    key = list(key)
    b = _bucketed(df, key + list(order), buckets)
    frame = Window.partitionBy("_b", *key).orderBy(*order)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = b.select("*", *[F.coalesce(F.sum(v).over(frame), F.lit(0)).alias(f"_loc_{out}") for out, v in sums.items()])
    tot = b.groupBy("_b", *key).agg(*[F.sum(v).alias(f"_tot_{out}") for out, v in sums.items()])
    w = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(F.col("_b").alias("_ob"), *[F.col(k).alias(f"_o_{k}") for k in key],
                      *[F.coalesce(F.sum(f"_tot_{out}").over(w), F.lit(0)).alias(f"_off_{out}") for out in sums])
    on = (F.col("_b") == F.col("_ob")) & _same(key, [f"_o_{k}" for k in key])
    return wide(local).join(offs, on).select(*df.columns, *[(F.col(f"_loc_{out}") + F.col(f"_off_{out}")).alias(out) for out in sums])


def running_sum(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str,
                out: str = "running", inclusive: bool = True, buckets: int | None = None) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, key, order, {out: value}, inclusive, buckets)


def dense_index(df: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """0-based position within ``key`` in ``order`` (running count)."""
    return running_sum(df.withColumn("_one", F.lit(1)), key, order, "_one", out, inclusive=False).drop("_one")
