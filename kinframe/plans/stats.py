"""Statistics keys (§2.5) over the crawl catalog, parameters, lines and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinframe.functions.common import r6, wide
from kinframe.functions.dictionaries import CARD_FIELDS
from kinframe.operators import graph as g
from kinframe.operators import stats as st
from kinframe.operators.sequence import dense_index
from kinframe.operators.topk import top_k
from kinframe.plans import graph as pg
from kinframe.plans.catalog import crawl
from kinframe.plans.params import PARAMS_SQL, params_table
from kinframe.plans.registry import query
from kinframe.plans.bins import RANGE_BINS, RANGE_LABELS, right_closed, right_closed_sql
from kinframe.sources import bindings as b
from kinframe.sources.tables import Tables

KINDS = ["children_count", "adapters_count", "quantized_count", "merges_count"]


def crawl_full(t: Tables):
    """Crawl catalog: depth, derivative counts, card length, category, parameters."""
    e = pg.edges(t)
    n = b.cat(t)
    d = g.bfs_depths(e, g.roots(n, e))
    cards = t.documents.select(F.col("doc_id").alias("id"), F.length("text").alias("card_length"))
    p = params_table(t).select("id", "parameters")
    return (crawl(t).join(d, "id").join(n.select("id", "pipeline_tag", "created_at"), "id")
            .join(wide(cards), "id", "left").join(wide(p), "id", "left"))


CRAWL_SQL = f"""dcnt AS (SELECT n.id, coalesce(children_count, 0) AS children_count, coalesce(adapters_count, 0) AS adapters_count,
  coalesce(quantized_count, 0) AS quantized_count, coalesce(merges_count, 0) AS merges_count FROM cat n LEFT JOIN (SELECT src,
  count(*) FILTER (WHERE edge_type = 'finetune') AS children_count, count(*) FILTER (WHERE edge_type = 'adapter') AS adapters_count,
  count(*) FILTER (WHERE edge_type = 'quantized') AS quantized_count, count(*) FILTER (WHERE edge_type = 'merge') AS merges_count
  FROM edges GROUP BY src) x ON x.src = n.id),
{PARAMS_SQL.strip()},
crawl AS (SELECT c.*, c.children_count + c.adapters_count + c.quantized_count + c.merges_count AS total_derivatives,
  d.depth, n.pipeline_tag, n.created_at, length(doc.text) AS card_length, pc.parameters
  FROM dcnt c JOIN dep d ON d.id = c.id JOIN cat n ON n.id = c.id LEFT JOIN documents doc ON doc.doc_id = c.id LEFT JOIN pc ON pc.id = c.id)"""


def ksql(body: str, *ctes: str) -> str:
    return b.with_views(body, "cat", "lin_rel", "par", ctes=(pg.EDGES, pg.ROOTS, pg.DEPTH, CRAWL_SQL) + ctes,
                        recursive=True)


@query("depth_distribution", sql=ksql(
    """SELECT depth, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
  round(sum(count(*)) OVER (ORDER BY depth) / sum(count(*)) OVER (), 6) AS cumulative_share FROM crawl GROUP BY depth"""))
def q_depth_distribution(t: Tables):
    c = crawl_full(t).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    # one row per depth level: these windows run over a handful of rows
    tot = F.sum("n").over(Window.partitionBy())
    cum = F.sum("n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("depth", "n", r6(F.col("n") / tot).alias("share"), r6(cum / tot).alias("cumulative_share"))


@query("crosstab_by_depth", sql=ksql(
    """SELECT depth, pipeline_tag AS category, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY pipeline_tag), 6) AS share_of_category FROM crawl GROUP BY depth, pipeline_tag"""))
def q_crosstab_by_depth(t: Tables):
    c = crawl_full(t).groupBy("depth", F.col("pipeline_tag").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("depth", "category", "n",
                    r6(F.col("n") / F.sum("n").over(Window.partitionBy("category"))).alias("share_of_category"))


@query("crosstab_by_depth_type", sql=ksql(
    """SELECT depth, pipeline_tag AS type, library_name AS license, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share_overall,
  round(count(*) / sum(count(*)) OVER (PARTITION BY depth, pipeline_tag), 6) AS share_of_type
FROM (SELECT c.depth, c.pipeline_tag, n.library_name FROM crawl c JOIN cat n ON n.id = c.id) z GROUP BY depth, pipeline_tag, library_name"""))
def q_crosstab_by_depth_type(t: Tables):
    """Counts of (depth, type) by license (the library stands for it), with shares of all models and of the depth's type."""
    lic = b.cat(t).select("id", F.col("library_name").alias("license"))
    c = crawl_full(t).select("id", "depth", F.col("pipeline_tag").alias("type")).join(lic, "id").groupBy("depth", "type", "license").agg(F.count(F.lit(1)).alias("n"))
    c = c.checkpoint()
    total = c.agg(F.sum("n").alias("all"))
    per = c.groupBy(F.col("depth").alias("d"), F.col("type").alias("y")).agg(F.sum("n").alias("m"))
    return wide(c).join(per, (F.col("depth") == F.col("d")) & F.col("type").eqNullSafe(F.col("y"))).crossJoin(total).select(  # one row
        "depth", "type", "license", "n", r6(F.col("n") / F.col("all")).alias("share_overall"), r6(F.col("n") / F.col("m")).alias("share_of_type"))


#: Measures with a mean and quartiles per depth; the quartiles of the total have the plain names.
SPREAD = [*KINDS, "total_derivatives", "card_length"]
QUARTILES = {(m, p): f"q{p}" if m == "total_derivatives" else f"q{p}_{m}" for m in SPREAD for p in (25, 50, 75)}


@query("derivative_stats_by_depth", sql=ksql(
    """SELECT depth, count(*) AS n, """ + ", ".join(f"round(avg({m}), 6) AS mean_{m}" for m in SPREAD) + """,
  """ + ", ".join(f"round(quantile_cont({m}, {p / 100}), 6) AS {name}" for (m, p), name in QUARTILES.items()) + """ FROM crawl GROUP BY depth"""))
def q_derivative_stats_by_depth(t: Tables):
    """Per depth: the models, and mean and quartiles of every count of derivatives, of their total and of the card length
    (of the models with a card), all from one histogram of (depth, measure, value)."""
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("v")) for m in SPREAD])
    h = crawl_full(t).select("depth", F.explode(values).alias("e")).groupBy("depth", "e.measure", "e.v").agg(
        F.count(F.lit(1)).alias("c")).checkpoint()
    of = lambda m, x: F.max(F.when(F.col("measure") == m, x))
    means = h.groupBy("depth", "measure").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum(
        F.when(F.col("v").isNotNull(), F.col("c")))).alias("mean")).groupBy("depth").agg(
        of("total_derivatives", F.col("n")).alias("n"), *[r6(of(m, F.col("mean"))).alias(f"mean_{m}") for m in SPREAD])
    qs = st.histogram_quantiles(h.where("v IS NOT NULL"), [0.25, 0.5, 0.75], key=["depth", "measure"]).groupBy(
        F.col("depth").alias("d")).agg(*[r6(of(m, F.col(f"q{p}"))).alias(name) for (m, p), name in QUARTILES.items()])
    return means.join(qs, F.col("depth") == F.col("d")).drop("d")


PAIRS = [(a, b2) for i, a in enumerate(KINDS) for b2 in KINDS[i + 1:]]


@query("derivative_correlation_by_depth", sql=ksql(
    "SELECT depth, " + ", ".join(f"round(CASE WHEN stddev_samp({a}) * stddev_samp({c}) = 0 THEN NULL ELSE covar_samp({a}, {c}) / (stddev_samp({a}) * stddev_samp({c})) END, 6) AS corr_{a[:-6]}_{c[:-6]}" for a, c in PAIRS)
    + " FROM crawl GROUP BY depth"))
def q_derivative_correlation_by_depth(t: Tables):
    c = crawl_full(t)
    # Pearson r, null when a column is constant within the depth
    return c.groupBy("depth").agg(*[r6(F.try_divide(F.covar_samp(a, c2), F.stddev_samp(a) * F.stddev_samp(c2)))
                                    .alias(f"corr_{a[:-6]}_{c2[:-6]}") for a, c2 in PAIRS])


def _wide(x):
    """Numbers of a million and more at whole thousands, others at 6 decimals."""
    return F.when(F.abs(x) < 1e6, r6(x)).otherwise(F.round(x, -3))


def _wide_sql(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e6 THEN round({x}, 6) ELSE round({x}, -3) END"


#: Measures of the summary as SQL over the crawl catalog.
MEASURES = {"total_derivatives": "total_derivatives", "card_length": "card_length", "parameters": "parameters",
            "derivative_diversity": " + ".join(f"CAST({k} > 0 AS INT)" for k in KINDS)}


_SUMMARY = {"mean": "avg(x)", "median": "median(x)", "sum": "sum(x)", "std": "stddev_samp(x)", "min": "min(x)", "max": "max(x)"}


@query("summary_by_depth", sql=ksql(
    "SELECT depth, measure, n, " + ", ".join(f"{_wide_sql(k)} AS {k}" for k in _SUMMARY) + """, pct_positive FROM (
  SELECT depth, measure, count(x) AS n, """ + ", ".join(f"{f} AS {k}" for k, f in _SUMMARY.items()) + """,
    round(100.0 * count(*) FILTER (WHERE x > 0) / count(x), 6)::DOUBLE AS pct_positive FROM (""" + " UNION ALL ".join(
        f"SELECT depth, '{m}' AS measure, CAST({e} AS DOUBLE) AS x FROM crawl" for m, e in MEASURES.items()) + """) v
  WHERE x IS NOT NULL GROUP BY GROUPING SETS ((depth, measure), (measure))) z"""))
def q_summary_by_depth(t: Tables):
    """Per depth, and overall (depth null): every measure's mean, median, sum, deviation, extremes and share above 0, from
    one stored long table; medians exact from histograms."""
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(e).cast("double").alias("x")) for m, e in MEASURES.items()])
    long = crawl_full(t).select("depth", F.explode(values).alias("v")).select("depth", "v.*").where("x IS NOT NULL")
    long = long.select(F.explode(F.array("depth", F.lit(None).cast("int"))).alias("depth"), "measure", "x").checkpoint()
    by = long.groupBy("depth", "measure").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.sum("x").alias("sum"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"), r6(100.0 * F.count_if(F.col("x") > 0) / F.count("x")).alias("pct_positive"))
    med = st.exact_quantiles(long, "x", [0.5], key=["depth", "measure"]).select(F.col("depth").alias("d"), F.col("measure").alias("m"), F.col("q50").alias("median"))
    return by.join(med, F.col("depth").eqNullSafe(F.col("d")) & (F.col("measure") == F.col("m"))).select(
        "depth", "measure", "n", *[_wide(F.col(k)).alias(k) for k in _SUMMARY], "pct_positive")


#: Category and phrase of every field looked for in a card.
PHRASES = [(category, phrase) for category, phrases in CARD_FIELDS.items() for phrase in phrases]
PHRASE_SQL = "dim_phrase(category, phrase) AS (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in PHRASES) + ")"


def fields_in_cards(t: Tables):
    """``depth, hits``: one boolean per phrase and card, found where the card is scanned; the texts are not moved."""
    cards = t.documents.select(F.col("doc_id").alias("id"), F.lower("text").alias("low")).select(
        "id", F.array(*[F.coalesce(F.col("low").contains(p), F.lit(False)).cast("int") for _, p in PHRASES]).alias("hits"))
    return crawl_full(t).select("id", "depth").join(wide(cards), "id").select("depth", "hits")


@query("field_presence_by_depth", sql=ksql(
    """SELECT c.depth, p.category, p.phrase, round(100.0 * avg(CASE WHEN contains(lower(d.text), p.phrase) THEN 1 ELSE 0 END), 6)::DOUBLE AS pct
FROM crawl c JOIN documents d ON d.doc_id = c.id CROSS JOIN dim_phrase p GROUP BY c.depth, p.category, p.phrase""", PHRASE_SQL))
def q_field_presence_by_depth(t: Tables):
    """Share of the cards of a depth that have each field, all fields in one aggregate."""
    sums = fields_in_cards(t).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("hits")[k]) for k in range(len(PHRASES))]).alias("s"))
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(p).alias("phrase"), r6(100.0 * F.col("s")[k] / F.col("n")).alias("pct"))
                     for k, (c, p) in enumerate(PHRASES)])
    return sums.select("depth", F.explode(rows).alias("r")).select("depth", "r.*")


@query("category_completion_by_depth", sql=ksql(
    """SELECT depth, category, round(count(*) FILTER (WHERE hits > 0) / (max(np) * count(*)), 6) AS completion_capped,
  round(avg(hits / np), 6) AS mean_phrase_share FROM (
  SELECT c.depth, p.category, c.id, sum(CASE WHEN contains(lower(d.text), p.phrase) THEN 1 ELSE 0 END) AS hits, count(*) AS np
  FROM crawl c JOIN documents d ON d.doc_id = c.id CROSS JOIN dim_phrase p GROUP BY c.depth, p.category, c.id) x GROUP BY depth, category""",
    PHRASE_SQL))
def q_category_completion_by_depth(t: Tables):
    """Per category: cards with any field over all cards and fields, and the mean share of its fields."""
    own = {c: [k for k, (d, _) in enumerate(PHRASES) if d == c] for c in CARD_FIELDS}
    found = lambda ks: sum((F.col("hits")[k] for k in ks[1:]), F.col("hits")[ks[0]])
    cards = fields_in_cards(t).select("depth", *[found(ks).alias(f"h{i}") for i, ks in enumerate(own.values())])
    sums = cards.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"h{i}") > 0).alias(f"any{i}") for i in range(len(own))],
                                      *[F.sum(f"h{i}").alias(f"sum{i}") for i in range(len(own))])
    rows = F.array(*[F.struct(F.lit(c).alias("category"), r6(F.col(f"any{i}") / (len(ks) * F.col("n"))).alias("completion_capped"),
                              r6(F.col(f"sum{i}") / (len(ks) * F.col("n"))).alias("mean_phrase_share")) for i, (c, ks) in enumerate(own.items())])
    return sums.select("depth", F.explode(rows).alias("r")).select("depth", "r.*")


def valid_params(t: Tables):
    return params_table(t).where(F.col("parameters").isNotNull() & (F.col("parameters") > 0))


@query("parameter_statistics", sql=b.with_views(
    f"""SELECT (SELECT count(*) FROM pc) AS total, round(100.0 * count(*) / (SELECT count(*) FROM pc), 6)::DOUBLE AS coverage_pct,
  {_wide_sql('avg(parameters)')} AS mean, {_wide_sql('median(parameters)')} AS median, {_wide_sql('stddev_samp(parameters)')} AS std,
  min(parameters) AS min, max(parameters) AS max, {_wide_sql('quantile_cont(parameters, 0.25)')} AS q25, {_wide_sql('quantile_cont(parameters, 0.75)')} AS q75
FROM pc WHERE parameters IS NOT NULL""", "par", ctes=(PARAMS_SQL,)))
def q_parameter_statistics(t: Tables):
    p = params_table(t)
    tot = p.agg(F.count(F.lit(1)).alias("total"))
    v = p.where(F.col("parameters").isNotNull())
    a = v.agg(F.count(F.lit(1)).alias("_n"), _wide(F.avg("parameters")).alias("mean"),
              _wide(F.stddev_samp("parameters")).alias("std"), F.min("parameters").alias("min"), F.max("parameters").alias("max"))
    q = st.exact_quantiles(v, "parameters", [0.25, 0.5, 0.75])
    return tot.crossJoin(a).crossJoin(q).select(
        "total", r6(100.0 * F.col("_n") / F.col("total")).alias("coverage_pct"), "mean", _wide(F.col("q50")).alias("median"),
        "std", "min", "max", _wide(F.col("q25")).alias("q25"), _wide(F.col("q75")).alias("q75"))


@query("extraction_sources", sql=b.with_views(
    "SELECT parameter_source, count(*) AS n FROM pc GROUP BY parameter_source", "par", ctes=(PARAMS_SQL,)))
def q_extraction_sources(t: Tables):
    return params_table(t).groupBy("parameter_source").agg(F.count(F.lit(1)).alias("n"))


@query("gap_share", sql=b.with_views(
    """SELECT count(*) FILTER (WHERE parameters < 20e9) AS models_below_gap, count(*) FILTER (WHERE parameters >= 20e9 AND parameters <= 70e9) AS models_in_gap,
  count(*) FILTER (WHERE parameters > 70e9) AS models_above_gap,
  round(100.0 * count(*) FILTER (WHERE parameters >= 20e9 AND parameters <= 70e9) / count(*), 6)::DOUBLE AS gap_percentage
FROM pc WHERE parameters IS NOT NULL AND parameters > 0""", "par", ctes=(PARAMS_SQL,)))
def q_gap_share(t: Tables):
    v = valid_params(t)
    x = F.col("parameters")
    in_gap = (x >= 20e9) & (x <= 70e9)
    return v.agg(F.count_if(x < 20e9).alias("models_below_gap"), F.count_if(in_gap).alias("models_in_gap"),
                 F.count_if(x > 70e9).alias("models_above_gap"),
                 r6(100.0 * F.count_if(in_gap) / F.count(F.lit(1))).alias("gap_percentage"))


@query("depth_parameter_corr", sql=ksql(
    "SELECT round(corr(depth, parameters), 6) AS depth_parameter_correlation, count(*) AS n FROM crawl WHERE parameters IS NOT NULL AND parameters > 0"))
def q_depth_parameter_corr(t: Tables):
    c = crawl_full(t).where(F.col("parameters").isNotNull() & (F.col("parameters") > 0))
    return c.agg(r6(F.corr("depth", "parameters")).alias("depth_parameter_correlation"), F.count(F.lit(1)).alias("n"))


@query("trait_count_distribution", sql=b.with_views(
    "SELECT k, count(*) AS n_models FROM (SELECT id, count(*) AS k FROM cat_trait GROUP BY id) x GROUP BY k", "cat_trait"))
def q_trait_count_distribution(t: Tables):
    per = b.cat_trait(t).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("k").agg(F.count(F.lit(1)).alias("n_models"))


@query("gini", sql="""WITH v AS (SELECT CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY o_custkey),
s AS (SELECT CASE WHEN min(x) OVER () < 0 THEN x - min(x) OVER () ELSE x END + 1e-9 AS x FROM v),
r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM s)
SELECT round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) AS gini FROM r""")
def q_gini(t: Tables):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"))
    return st.gini(per, "orders").select(r6("gini").alias("gini"))


@query("shannon_diversity", sql="""SELECT user_id, round(-sum(p * log2(p + 1e-9)), 6) AS shannon FROM (
  SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) x GROUP BY user_id""")
def q_shannon_diversity(t: Tables):
    return st.shannon(t.events, ["user_id"], "event_type").select("user_id", r6("shannon").alias("shannon"))


@query("km_survival", sql="""WITH u AS (SELECT user_id, count(*) AS t, arg_min(event_type, (ts, event_id)) AS grp FROM events GROUP BY user_id),
p AS (SELECT grp, t, count(*) AS d FROM u GROUP BY grp, t),
r AS (SELECT grp, t, d, CAST(sum(d) OVER (PARTITION BY grp ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_at_risk FROM p)
SELECT grp, t, n_at_risk, d, round(CASE WHEN max(CASE WHEN d >= n_at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0
  ELSE exp(sum(CASE WHEN d < n_at_risk THEN ln(1 - d / n_at_risk) ELSE 0 END) OVER w) END, 6) AS survival
FROM r WINDOW w AS (PARTITION BY grp ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_km_survival(t: Tables):
    """Sequence length per user (all observed), grouped by the user's first event type."""
    u = t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("t"), F.min_by("event_type", F.struct("ts", "event_id")).alias("grp"))
    return st.km_survival(u, ["grp"], "t").select("grp", "t", "n_at_risk", "d", r6("survival").alias("survival"))


@query("ecosystem_saturation", sql=pg.gsql(
    """SELECT round(regr_slope(kids, x), 6) AS slope_children, round(regr_intercept(kids, x), 6) AS intercept_children,
  round(regr_slope(n_descendants, x), 6) AS slope_descendants, round(regr_intercept(n_descendants, x), 6) AS intercept_descendants
FROM (SELECT r.id, row_number() OVER (ORDER BY r.id) AS x, coalesce(o.c, 0) AS kids, dc.n_descendants FROM roots r JOIN dc ON dc.id = r.id
  LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) o ON o.src = r.id) z""", pg.ROOTS, pg.CLOSURE, recursive=True))
def q_ecosystem_saturation(t: Tables):
    e = pg.edges(t)
    n = b.cat(t)
    r = g.roots(n, e).join(g.descendant_counts(n, e), "id")
    kids = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    x = dense_index(r.join(kids, "id", "left"), [], ["id"], "at").select(
        (F.col("at") + 1).alias("x"), F.coalesce("c", F.lit(0)).alias("kids"), "n_descendants")
    return x.agg(r6(F.regr_slope("kids", "x")).alias("slope_children"), r6(F.regr_intercept("kids", "x")).alias("intercept_children"),
                 r6(F.regr_slope("n_descendants", "x")).alias("slope_descendants"),
                 r6(F.regr_intercept("n_descendants", "x")).alias("intercept_descendants"))


@query("trend_regression", sql="""SELECT l_linenumber, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem GROUP BY ROLLUP (l_linenumber)""")
def q_trend_regression(t: Tables):
    li = t.lineitem
    return li.rollup("l_linenumber").agg(
        r6(F.regr_slope("l_extendedprice", "l_quantity")).alias("slope"),
        r6(F.regr_intercept("l_extendedprice", "l_quantity")).alias("intercept"),
        r6(F.regr_r2("l_extendedprice", "l_quantity")).alias("r2"))


@query("tag_contrast", sql="""WITH a AS (SELECT event_type AS tag, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rk FROM events WHERE value >= 25 GROUP BY event_type),
b AS (SELECT event_type AS tag, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rk FROM events WHERE value < 25 GROUP BY event_type)
SELECT coalesce(a.rk, b.rk) AS rank, a.tag AS tag_high, a.n AS n_high, b.tag AS tag_low, b.n AS n_low
FROM (SELECT * FROM a WHERE rk <= 10) a FULL OUTER JOIN (SELECT * FROM b WHERE rk <= 10) b ON a.rk = b.rk""")
def q_tag_contrast(t: Tables):
    """Top-10 tags of two subsets side by side (rank-aligned full outer join)."""
    e = t.events.select("event_type", "value")

    def top(df):
        c = df.groupBy(F.col("event_type").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
        # ten rows are ranked
        return top_k(c, [F.desc("n"), F.asc("tag")], 10).withColumn("rk", F.row_number().over(Window.orderBy(F.desc("n"), "tag")).cast("bigint"))
    hi = top(e.where(F.col("value") >= 25)).select(F.col("rk").alias("rk_a"), F.col("tag").alias("tag_high"), F.col("n").alias("n_high"))
    lo = top(e.where(F.col("value") < 25)).select(F.col("rk").alias("rk_b"), F.col("tag").alias("tag_low"), F.col("n").alias("n_low"))
    j = hi.join(lo, hi.rk_a == lo.rk_b, "full_outer")
    return j.select(F.coalesce("rk_a", "rk_b").alias("rank"), "tag_high", "n_high", "tag_low", "n_low")


def _bins_sql(rows: str, bins: int) -> str:
    return f"""(WITH v AS ({rows}), m AS (SELECT min(x) - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS lo, max(x) + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS hi, count(*) AS n FROM v),
c AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin FROM v, m)
SELECT bin, round(lo + bin * (hi - lo) / {bins}, 6) AS bin_lo, round(lo + (bin + 1) * (hi - lo) / {bins}, 6) AS bin_hi, count(*) AS n,
  round(count(*) / (max(m.n) * (hi - lo) / {bins}), 9) AS density FROM c, m GROUP BY bin, lo, hi)"""


def _rounded_bins(h):
    return h.select("bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "n",
                    F.round("density", 9).alias("density"))


@query("histogram", sql=f"SELECT * FROM {_bins_sql('SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL', 50)} h")
def q_histogram(t: Tables):
    """50 bins over the values."""
    return _rounded_bins(st.fixed_histogram(t.lineitem, "l_extendedprice", 50))


@query("histogram_log10", sql=b.with_views(f"SELECT * FROM {_bins_sql('SELECT log10(parameters) AS x FROM pc WHERE parameters > 0', 50)} h", "par", ctes=(PARAMS_SQL,)))
def q_histogram_log10(t: Tables):
    """50 bins over the decimal logarithm of the parameter counts."""
    return _rounded_bins(st.fixed_histogram(valid_params(t).select(F.log10("parameters").alias("x")), "x", 50))


_WHOLE = "CAST(floor(l_extendedprice) AS BIGINT)"
_STRIPPED = f"rtrim(CAST({_WHOLE} AS VARCHAR), '0')"
_FLAGGED = {"round": f"(length({_STRIPPED}) <= 2 OR right({_STRIPPED}, 1) = '5')", "power_of_2": f"{_WHOLE} & ({_WHOLE} - 1) = 0"}


@query("histogram_properties", sql=" UNION ALL ".join(
    f"SELECT '{p}' AS property, h.* FROM {_bins_sql(f'SELECT DISTINCT floor(l_extendedprice) AS x FROM lineitem WHERE l_extendedprice >= 1 AND {f}', 20)} h"
    for p, f in _FLAGGED.items()))
def q_histogram_properties(t: Tables):
    """20 bins over the distinct values that are round, and over those that are powers of 2."""
    n, s = F.col("n"), F.col("s")
    v = t.lineitem.where("l_extendedprice >= 1").select(F.floor("l_extendedprice").cast("bigint").alias("n")).distinct().select(
        n, F.rtrim(n.cast("string"), F.lit("0")).alias("s"))
    flags = {"round": (F.length(s) <= 2) | s.endswith("5"), "power_of_2": n.bitwiseAND(n - 1) == 0}
    parts = [_rounded_bins(st.fixed_histogram(v.where(f), "n", 20)).select(F.lit(p).alias("property"), "*") for p, f in flags.items()]
    return parts[0].unionByName(parts[1])


@query("timeline_counts", sql="SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_timeline_counts(t: Tables):
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_RANGE_SQL = right_closed_sql("parameters", RANGE_BINS, RANGE_LABELS)


@query("timeline_counts_by_size", sql=ksql(
    f"SELECT CAST(created_at AS DATE) AS day, {_RANGE_SQL} AS size_range, count(*) AS n FROM crawl WHERE parameters > 0 GROUP BY ALL"))
def q_timeline_counts_by_size(t: Tables):
    """Models per day of creation and range of the parameter count."""
    c = crawl_full(t).where("parameters > 0")
    return c.groupBy(F.to_date("created_at").alias("day"), right_closed(F.col("parameters"), RANGE_BINS, RANGE_LABELS).alias("size_range")).agg(
        F.count(F.lit(1)).alias("n"))


@query("timeline_yearly_by_depth", sql=ksql(
    f"SELECT CAST(y AS INTEGER) AS year, depth, {_wide_sql('m')} AS mean_parameters, n FROM (SELECT year(created_at) AS y, depth, avg(parameters) AS m, count(*) AS n FROM crawl WHERE parameters IS NOT NULL GROUP BY 1, 2) z"))
def q_timeline_yearly_by_depth(t: Tables):
    """Mean parameter count per year of creation and depth."""
    c = crawl_full(t).where("parameters IS NOT NULL")
    return c.groupBy(F.year("created_at").alias("year"), "depth").agg(F.avg("parameters").alias("m"), F.count(F.lit(1)).alias("n")).select(
        "year", "depth", _wide(F.col("m")).alias("mean_parameters"), "n")


@query("timeline_stats", sql="""SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 6) AS mean_price,
  round(median(o_totalprice), 6) AS median_price, round(stddev_samp(o_totalprice), 6) AS std_price, count(*) AS n FROM orders GROUP BY 1""")
def q_timeline_stats(t: Tables):
    o = t.orders.select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    a = o.groupBy("day").agg(r6(F.avg("o_totalprice")).alias("mean_price"),
                             r6(F.stddev_samp("o_totalprice")).alias("std_price"), F.count(F.lit(1)).alias("n"))
    med = st.exact_quantiles(o, "o_totalprice", [0.5], key=["day"])
    return a.join(med, "day").select("day", "mean_price", r6("q50").alias("median_price"), "std_price", "n")


@query("date_stats", sql="""SELECT o_orderpriority, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date,
  round(avg(epoch(o_orderdate)), 3) AS mean_epoch, round(median(epoch(o_orderdate)), 3) AS median_epoch FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def q_date_stats(t: Tables):
    o = t.orders.select("o_orderpriority", "o_orderdate",
                        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("ep"))
    a = o.rollup("o_orderpriority").agg(F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"),
                                        F.round(F.avg("ep"), 3).alias("mean_epoch"))
    med = st.exact_quantiles(o, "ep", [0.5], key=["o_orderpriority"]).unionByName(
        st.exact_quantiles(o, "ep", [0.5]).select(F.lit(None).cast("string").alias("o_orderpriority"), "q50"))
    return a.join(med, a["o_orderpriority"].eqNullSafe(med["o_orderpriority"])).select(
        a["o_orderpriority"], "first_date", "last_date", "mean_epoch", F.round("q50", 3).alias("median_epoch"))


@query("gated_summary", sql=b.with_views(
    """SELECT count(*) AS total, count(*) FILTER (WHERE gated IS NOT NULL AND lower(gated) NOT IN ('false', '', '0', 'none')) AS gated,
  count(*) FILTER (WHERE NOT (gated IS NOT NULL AND lower(gated) NOT IN ('false', '', '0', 'none'))) AS ungated FROM cat""", "cat"))
def q_gated_summary(t: Tables):
    c = b.cat(t)
    truthy = F.col("gated").isNotNull() & ~F.lower("gated").isin("false", "", "0", "none")
    return c.agg(F.count(F.lit(1)).alias("total"), F.count_if(truthy).alias("gated"), F.count_if(~truthy).alias("ungated"))


@query("library_summary", sql=b.with_views(
    """SELECT arg_max(library_name, (n, library_name)) AS top_library, max(n) AS top_count, round(avg(n), 6) AS mean_count,
  round(median(n), 6) AS median_count, count(*) AS n_libraries FROM (SELECT library_name, count(*) AS n FROM cat GROUP BY 1) x""", "cat"))
def q_library_summary(t: Tables):
    c = b.cat(t).groupBy("library_name").agg(F.count(F.lit(1)).alias("n"))
    a = c.agg(F.max_by("library_name", F.struct("n", "library_name")).alias("top_library"), F.max("n").alias("top_count"),
              r6(F.avg("n")).alias("mean_count"), F.count(F.lit(1)).alias("n_libraries"))
    med = st.exact_quantiles(c, "n", [0.5])
    return a.crossJoin(med).select("top_library", "top_count", "mean_count", r6("q50").alias("median_count"), "n_libraries")


@query("value_counts", sql=b.with_views("SELECT pipeline_tag, count(*) AS n FROM cat GROUP BY 1", "cat"))
def q_value_counts(t: Tables):
    return b.cat(t).groupBy("pipeline_tag").agg(F.count(F.lit(1)).alias("n"))


DESCRIBE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax"]


@query("describe_numeric", sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
  round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem) t"""
    for c in DESCRIBE_COLS))
def q_describe_numeric(t: Tables):
    """All numeric columns in one pass: unpivoted to (column, value)."""
    u = t.lineitem.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in DESCRIBE_COLS])).alias("e")).select("e.*")
    a = u.groupBy("column_name").agg(F.count("x").alias("count"), r6(F.avg("x")).alias("mean"),
                                     r6(F.stddev_samp("x")).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    q = st.exact_quantiles(u, "x", [0.25, 0.5, 0.75], key=["column_name"])
    return a.join(q, "column_name").select("column_name", "count", "mean", "std", "min", r6("q25").alias("q25"),
                                           r6("q50").alias("q50"), r6("q75").alias("q75"), "max")


@query("significant_gaps", sql="""WITH s AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
d AS (SELECT x AS after, lag(x) OVER (ORDER BY x) AS before FROM (SELECT DISTINCT x FROM s) u),
m AS (SELECT (max(x) - min(x)) / (count(*) - 1) AS mean_gap, count(*) AS n FROM s),
v AS (SELECT sqrt(greatest(sum((after - before) * (after - before)) / (max(m.n) - 1) - max(m.mean_gap) * max(m.mean_gap), 0)) AS std_gap FROM d, m WHERE before IS NOT NULL)
SELECT before, after, round(after - before, 6) AS gap_size, round((after - before) / mean_gap, 6) AS relative_gap, round(mean_gap, 6) AS mean_gap, round(std_gap, 6) AS std_gap
FROM d, m, v WHERE before IS NOT NULL AND after - before > mean_gap + 2 * std_gap""")
def q_significant_gaps(t: Tables):
    g2 = st.significant_gaps(t.lineitem, "l_extendedprice")
    return g2.select("before", "after", r6("gap_size").alias("gap_size"), r6("relative_gap").alias("relative_gap"),
                     r6("mean_gap").alias("mean_gap"), r6("std_gap").alias("std_gap"))
