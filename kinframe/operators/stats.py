"""Distribution statistics as aggregates that stay distributed.

Order statistics (quantiles, Gini, consecutive gaps) are computed from value
histograms plus ``running_sum``: no single-partition window and no
``collect_list`` of a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinframe.functions.common import wide
from kinframe.operators.sequence import previous_in_group, running_sum


def value_histogram(df: DataFrame, value: str, key: Sequence[str] = ()) -> DataFrame:
    """(key..., v, c) — count per distinct value (partial aggregation map-side)."""
    return df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("c"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], key: Sequence[str] = (),
                    prefix: str = "q") -> DataFrame:
    """Linear-interpolation quantiles (numpy default) per key, exact."""
    return histogram_quantiles(value_histogram(df, value, key), probs, key, prefix)


def histogram_quantiles(h: DataFrame, probs: Sequence[float], key: Sequence[str] = (), prefix: str = "q") -> DataFrame:
    """The quantiles of a histogram (key..., v, c) without null values.

    Rank r (0-based) holds value v when before(v) <= r < before(v) + c(v);
    p-quantile = v(floor(p(n-1))) + frac * (v(ceil) - v(floor)). Both values
    are picked from the running histogram by one aggregate per key.
    """
    key = list(key)
    cum = running_sum(h, key, ["v"], "c", "_before", inclusive=False)
    n = h.groupBy(*key).agg(F.sum("c").alias("_n"))
    if key:
        n = n.select(*[F.col(k).alias(f"_n_{k}") for k in key], "_n")
        on = F.lit(True)
        for k in key:
            on = on & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
        placed = wide(cum).join(n, on)
    else:
        placed = cum.crossJoin(n)  # one row

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("c")), F.col("v")))

    picks = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        picks += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}")]
    picked = placed.groupBy(*key).agg(F.first("_n").alias("_n"), *picks).where(F.col("_n").isNotNull())

    def between(i: int, p: float) -> Column:
        pos = (F.col("_n") - 1) * F.lit(float(p))
        return F.col(f"_lo{i}") + (pos - F.floor(pos)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))

    return picked.select(*key, *[between(i, p).alias(f"{prefix}{int(round(p * 100))}") for i, p in enumerate(probs)])


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient: values shifted by min if negative, +1e-9, then
    Σ(2i − n − 1)·x_(i) / (n·Σx) over the sorted values (one row)."""
    h = value_histogram(df, value)
    stats = h.agg(F.min("v").alias("_m"), F.sum("c").alias("_n"))
    shift = F.when(F.col("_m") < 0, -F.col("_m")).otherwise(F.lit(0.0))
    hx = h.crossJoin(stats).withColumn("x", F.col("v").cast("double") + shift + F.lit(1e-9))
    cum = running_sum(hx, [], ["v"], "c", "_s", inclusive=False)
    c, s, n = F.col("c"), F.col("_s"), F.col("_n")
    # Σ_{i=s+1}^{s+c} (2i − n − 1) = c(2s + c + 1) − c(n + 1)
    term = (c * (2 * s + c + 1) - c * (n + 1)) * F.col("x")
    return cum.agg((F.sum(term) / (F.first("_n") * F.sum(c * F.col("x")))).alias("gini"))


def shannon(df: DataFrame, group: Sequence[str], item: str) -> DataFrame:
    """−Σ p·log2(p + 1e-9) of item frequencies per group."""
    cnt = df.groupBy(*group, item).agg(F.count(F.lit(1)).alias("_c"))
    tot = cnt.groupBy(*group).agg(F.sum("_c").alias("_t"))
    p = F.col("_c") / F.col("_t")
    return cnt.join(tot, list(group)).groupBy(*group).agg(
        (-F.sum(p * F.log2(p + F.lit(1e-9)))).alias("shannon"))


def km_survival(df: DataFrame, group: Sequence[str], duration: str, event: str | None = None) -> DataFrame:
    """Product-limit survival per group at each distinct duration:
    (group, t, n_at_risk, d, survival)."""
    ev = F.col(event).cast("int") if event else F.lit(1)
    per = df.groupBy(*group, F.col(duration).alias("t")).agg(
        F.sum(ev).alias("d"), F.count(F.lit(1)).alias("_m"))
    # at risk at t = rows with duration >= t: reverse running count per group
    w = Window.partitionBy(*group).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    risk = per.withColumn("n_at_risk", F.sum("_m").over(w))
    factor = 1 - F.col("d") / F.col("n_at_risk")
    w2 = Window.partitionBy(*group).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.max(F.when(factor <= 0, 1).otherwise(0)).over(w2)
    logs = F.sum(F.when(factor > 0, F.log(factor)).otherwise(0.0)).over(w2)
    return risk.select(*group, "t", "n_at_risk", "d",
                       F.when(zero == 1, F.lit(0.0)).otherwise(F.exp(logs)).alias("survival"))


def consecutive_gaps(df: DataFrame, value: str) -> DataFrame:
    """Gaps between consecutive sorted values with duplicates as zero gaps:
    returns the distinct-value gaps (before, after, gap) plus totals to get
    mean/std over all n−1 gaps."""
    h = value_histogram(df, value).withColumn("_k", F.lit(0))
    prev = previous_in_group(h, "_k", ["v"], ["v"], prefix="p_")
    return prev.where(F.col("p_v").isNotNull()).select(
        F.col("p_v").alias("before"), F.col("v").alias("after"), (F.col("v") - F.col("p_v")).alias("gap"))


def significant_gaps(df: DataFrame, value: str, k: float = 2.0) -> DataFrame:
    """Gaps larger than mean + k·(population std) of all consecutive gaps."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    tot = v.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    g = consecutive_gaps(v, "x")
    sq = g.agg(F.sum(F.col("gap") * F.col("gap")).alias("ss"))
    m = tot.crossJoin(sq).select(((F.col("hi") - F.col("lo")) / (F.col("n") - 1)).alias("mean_gap"),
                                 (F.col("ss") / (F.col("n") - 1)).alias("_m2"))
    m = m.select("mean_gap", F.sqrt(F.greatest(F.col("_m2") - F.col("mean_gap") ** 2, F.lit(0.0))).alias("std_gap"))
    return (g.crossJoin(m).where(F.col("gap") > F.col("mean_gap") + k * F.col("std_gap"))
            .select("before", "after", F.col("gap").alias("gap_size"),
                    (F.col("gap") / F.col("mean_gap")).alias("relative_gap"), "mean_gap", "std_gap"))


def fixed_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max, last bin closed: (bin, lo, hi, n, density).

    A constant column gets bins from half below it to half above it."""
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    half = F.when(F.min("x") == F.max("x"), F.lit(0.5)).otherwise(F.lit(0.0))
    mm = x.agg((F.min("x") - half).alias("lo"), (F.max("x") + half).alias("hi"), F.count(F.lit(1)).alias("_n"))
    w = (F.col("hi") - F.col("lo")) / bins
    j = x.crossJoin(mm)  # one-row aggregate
    b = F.least(F.floor((F.col("x") - F.col("lo")) / w), F.lit(bins - 1)).cast("int")
    cnt = j.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return cnt.crossJoin(mm).select(
        "bin", (F.col("lo") + F.col("bin") * w).alias("bin_lo"), (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
        "n", (F.col("n") / (F.col("_n") * w)).alias("density"))
