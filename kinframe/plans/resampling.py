"""Bootstrap keys (§2.5): parameter statistics and mean similarities with 95 % intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.functions.common import r6
from kinframe.operators import bootstrap as B
from kinframe.operators import similarity as S
from kinframe.plans import stats as ps
from kinframe.plans.bins import HALF_OPEN
from kinframe.plans.registry import query
from kinframe.plans.similarity import COS_SQL
from kinframe.sources import bindings as b
from kinframe.sources.tables import Tables

N_BOOT, SEED = 1000, 42

SIZE_BINS = {name: (float(lo), float(hi)) for name, lo, hi in HALF_OPEN}
#: The closed gap of the published result.
GAP = (20e9, 70e9)
#: Column of a replicate -> section and statistic of the published result.
SHAPE = {
    **{c: ("parameter_distribution", c) for c in ("mean", "median", "std", "q1", "q3")},
    "correlation": ("depth_parameter_correlation", "depth_parameter_correlation"),
    "gap_percentage": ("gap_analysis", "gap_percentage"), "below": ("gap_analysis", "models_below_gap"),
    "above": ("gap_analysis", "models_above_gap"), "inside": ("gap_analysis", "models_in_gap"),
    **{c: ("parameter_bins", c) for c in SIZE_BINS},
}


def _uniform(key: str) -> str:
    return f"CAST(('0x' || substr(md5({key}), 1, 15)) AS BIGINT) / 1152921504606846976.0"


#: Least k with P(Binomial(n, p) <= k) >= u, by masses from the log gamma function.
QUANTILE = """CASE WHEN n = 0 THEN 0 WHEN p >= 1 THEN n ELSE list_reduce(list_transform(
  range(0, least(n, CAST(ceil(n * p + 15 * sqrt(n * p * (1 - p)) + 40) AS BIGINT)) + 1),
  lambda i: {'c': exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)), 'k': CAST(0 AS BIGINT)}),
  lambda a, x: {'c': a.c + x.c, 'k': a.k + CASE WHEN a.c + x.c < u THEN 1 ELSE 0 END}, {'c': CAST(0 AS DOUBLE), 'k': CAST(0 AS BIGINT)}).k END"""


def draws_sql(rows: str, n_boot: int = N_BOOT, seed: int = SEED) -> str:
    """CTEs up to ``draws(g, r, v, d, k)``: what every replicate draws of the cells of ``rows(g, v, d)``."""
    return f"""cells AS (SELECT g, CASE WHEN v > 0 THEN v END AS v, CASE WHEN v > 0 THEN d END AS d, count(*) AS w FROM ({rows}) z GROUP BY ALL),
sized AS (SELECT *, CASE WHEN v IS NULL THEN -1 ELSE row_number() OVER (PARTITION BY g, v IS NULL ORDER BY v, d) - 1 END AS cell,
  greatest({B.CHUNK}, CAST(ceil(sqrt(count(v) OVER (PARTITION BY g))) AS BIGINT)) AS size FROM cells),
placed AS (SELECT *, CASE WHEN cell < 0 THEN -1 ELSE cell // size END AS chunk FROM sized),
chunks AS (SELECT g, chunk, w, row_number() OVER o AS i, sum(w) OVER (PARTITION BY g ORDER BY chunk DESC) AS rest
  FROM (SELECT g, chunk, sum(w) AS w FROM placed GROUP BY g, chunk) z WINDOW o AS (PARTITION BY g ORDER BY chunk)),
parts AS (SELECT *, row_number() OVER (PARTITION BY g, chunk ORDER BY cell) AS i,
  sum(w) OVER (PARTITION BY g, chunk ORDER BY cell DESC) AS rest FROM placed),
top AS (SELECT g, r, CAST(0 AS BIGINT) AS i, CAST(sum(w) AS BIGINT) AS free, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS chunk FROM chunks, range({n_boot}) x(r) GROUP BY g, r
  UNION ALL SELECT g, r, i, n - k, k, chunk FROM (SELECT *, {QUANTILE} AS k FROM (SELECT t.g, t.r, c.i, c.chunk, t.free AS n, CAST(c.w / c.rest AS DOUBLE) AS p,
  {_uniform(f"'{seed}:' || t.g || ':' || t.r || ':c' || c.chunk")} AS u FROM top t JOIN chunks c ON c.g = t.g AND c.i = t.i + 1) q) s),
low AS (SELECT g, r, chunk, CAST(0 AS BIGINT) AS i, k AS free, CAST(0 AS BIGINT) AS k FROM top WHERE chunk IS NOT NULL
  UNION ALL SELECT g, r, chunk, i, n - k, k FROM (SELECT *, {QUANTILE} AS k FROM (SELECT t.g, t.r, t.chunk, c.i, t.free AS n, CAST(c.w / c.rest AS DOUBLE) AS p,
  {_uniform(f"'{seed}:' || t.g || ':' || t.r || ':' || c.cell")} AS u FROM low t JOIN parts c ON c.g = t.g AND c.chunk = t.chunk AND c.i = t.i + 1) q) s),
draws AS (SELECT l.g, l.r, p.v, p.d, l.k FROM low l JOIN parts p ON p.g = l.g AND p.chunk = l.chunk AND p.i = l.i WHERE l.k > 0)"""


def _quarter(share: float) -> str:
    """Linear quantile of the valid draws: the values at both sides of the position."""
    at = f"((n - 1) * {share})"
    pick = lambda x: f"max(v) FILTER (WHERE before <= {x} AND before + k > {x})"
    lo, hi = pick(f"floor({at})"), pick(f"ceil({at})")
    return f"{lo} + ({hi} - {lo}) * max({at} - floor({at}))"


def _within(lo: float, hi: float) -> str:
    return f"v >= {lo}" if hi == float("inf") else f"v >= {lo} AND v < {hi}"


_COUNTS = {"below": f"v < {GAP[0]}", "above": f"v > {GAP[1]}", "inside": f"v BETWEEN {GAP[0]} AND {GAP[1]}",
           **{name: _within(*ends) for name, ends in SIZE_BINS.items()}}
_COUNTED = ", ".join(f'coalesce(sum(k) FILTER (WHERE {on}), 0) AS "{name}"' for name, on in _COUNTS.items())
_LONG = " UNION ALL ".join(f"SELECT '{a}' AS section, '{s}' AS statistic, CAST(\"{c}\" AS DOUBLE) AS x FROM reps"
                           for c, (a, s) in SHAPE.items())
_INTERVAL = "avg(x) AS mean, quantile_cont(x, 0.025) AS ci_lower, quantile_cont(x, 0.975) AS ci_upper"
_ENDS = ("mean", "ci_lower", "ci_upper")
_ROUNDED = ", ".join(f"CASE WHEN abs({c}) < 1e6 THEN round({c}, 6) ELSE round({c}) END AS {c}" for c in _ENDS)

STATS_SQL = ps.ksql(f"SELECT section, statistic, {_ROUNDED} FROM (SELECT section, statistic, {_INTERVAL} FROM ({_LONG}) z GROUP BY section, statistic) y",
    draws_sql("SELECT '' AS g, parameters AS v, depth AS d FROM crawl"),
    f"""valid AS (SELECT r, v, d, k, sum(k) OVER (PARTITION BY r ORDER BY v, d) - k AS before, sum(k) OVER (PARTITION BY r) AS n,
  avg(v) OVER () AS cv FROM draws WHERE v IS NOT NULL),
sums AS (SELECT r, max(n) AS n, max(cv) AS cv, sum(k * (v - cv)) AS x, sum(k * (v - cv) * (v - cv)) AS xx, sum(k * d) AS y,
  sum(k * d * d) AS yy, sum(k * (v - cv) * d) AS xy, {_quarter(0.25)} AS q1, {_quarter(0.5)} AS median, {_quarter(0.75)} AS q3,
  {_COUNTED} FROM valid GROUP BY r),
reps AS (SELECT *, cv + x / n AS mean, sqrt((xx - x * x / n) / (n - 1)) AS std,
  (xy - x * y / n) / sqrt((xx - x * x / n) * (yy - y * y / n)) AS correlation, 100.0 * inside / n AS gap_percentage FROM sums)""")


@query("bootstrap_stats", sql=STATS_SQL)
def q_bootstrap_stats(t: Tables):
    """Mean and 95 % interval of every parameter statistic over bootstrap replicates of the crawl catalog; numbers
    of a million and more are rounded to whole ones."""
    reps = B.replicate_statistics(ps.crawl_full(t).withColumn("g", F.lit("")), "g", "parameters", "depth", SIZE_BINS, GAP, N_BOOT, SEED)
    out = B.intervals(reps, "g", SHAPE)
    return out.select("section", "statistic", *[F.when(F.abs(c) < 1e6, r6(c)).otherwise(F.round(c)).alias(c) for c in _ENDS])


MEAN_SQL = b.with_views(
    f"SELECT g AS level, m.n, round(m.mean, 6) AS mean, round(quantile_cont(x, 0.025), 6) AS ci_lower, round(quantile_cont(x, 0.975), 6) AS ci_upper FROM means JOIN m USING (g) GROUP BY g, m.n, m.mean",
    "emb_edge", ctes=(f"""sims AS (SELECT CAST(floor(log2(e.dst) / 2) AS BIGINT) AS g, {COS_SQL} AS s
FROM emb_edge e JOIN (SELECT vec_id, embedding AS a FROM embeddings) p ON p.vec_id = e.src
JOIN (SELECT vec_id, embedding AS c FROM embeddings) ch ON ch.vec_id = e.dst)""",
    "m AS (SELECT CAST(g AS VARCHAR) AS g, count(*) AS n, avg(s) AS mean, min(s) AS low FROM sims GROUP BY g)",
    draws_sql("SELECT m.g, s - low + 1 AS v, 0 AS d FROM sims JOIN m ON m.g = CAST(sims.g AS VARCHAR)"),
    "means AS (SELECT g, r, sum(k * (v - 1 + low)) / sum(k) AS x FROM draws JOIN m USING (g) GROUP BY g, r)"), recursive=True)


@query("bootstrap_mean_ci", sql=MEAN_SQL)
def q_bootstrap_mean_ci(t: Tables):
    """Mean parent-child cosine and its bootstrap interval per level of the vector tree."""
    e = b.emb_edge(t)
    p = t.embeddings.select(F.col("vec_id").alias("src"), F.col("embedding").alias("a"))
    c = t.embeddings.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("c"))
    sims = e.join(p, "src").join(c, "dst").select(F.floor(F.log2("dst") / 2).cast("string").alias("level"),
                                                  r6(S.cosine_dense(F.col("a"), F.col("c"))).alias("s"))
    out = B.mean_interval(sims, "level", "s", N_BOOT, SEED)
    return out.select("level", "n", *[r6(x).alias(x) for x in ("mean", "ci_lower", "ci_upper")])
