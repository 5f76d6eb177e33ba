"""Bins of parameter counts and other numbers (fixed edges and labels)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameter bin edges and labels (right-closed).
PARAM_BINS = [0, 1e6, 1e7, 1e8, 1e9, 1e10, 1e11, 1e12, float("inf")]
PARAM_LABELS = ["0-1M", "1M-10M", "10M-100M", "100M-1B", "1B-10B", "10B-100B", "100B-1T", ">1T"]
# The two coarser sets of right-closed bins (0 belongs to the first bin of the categories).
CATEGORY_BINS = [0, 1e6, 1e7, 1e8, 1e9, 1e10, float("inf")]
CATEGORY_LABELS = ["<1M", "1M-10M", "10M-100M", "100M-1B", "1B-10B", ">10B"]
RANGE_BINS = [0, 1e6, 1e7, 1e8, 1e9, float("inf")]
RANGE_LABELS = ["<1M", "1M-10M", "10M-100M", "100M-1B", ">1B"]
# Half-open ranges [lo, hi) of the gap analysis.
HALF_OPEN = [("Tiny (0-1M)", 0, 1e6), ("Small (1M-10M)", 1e6, 1e7), ("Medium (10M-100M)", 1e7, 1e8),
             ("Large (100M-1B)", 1e8, 1e9), ("Huge (1B-20B)", 1e9, 20e9), ("Gap (20B-70B)", 20e9, 70e9),
             ("Massive (>70B)", 70e9, float("inf"))]
# Popularity thresholds (count >= t) and labels, in order.
POPULARITY = [(100, "Very Popular (100+)"), (50, "Popular (50-99)"), (20, "Common (20-49)"),
              (10, "Moderate (10-19)")]


def right_closed(x: Column, edges, labels) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, lab in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((x > lo) & (x <= hi), F.lit(lab)).otherwise(out)
    return out


def right_closed_sql(x, edges, labels):
    parts = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        hi_s = f"{x} <= {hi!r}" if hi != float("inf") else "true"
        parts.append(f"WHEN {x} > {lo!r} AND {hi_s} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"
