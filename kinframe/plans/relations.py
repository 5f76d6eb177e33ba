"""Comparisons along lineage pairs, and number properties of distinct values."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.functions.common import r6
from kinframe.operators.numbers import with_divisors
from kinframe.plans import graph as pg
from kinframe.plans.registry import query
from kinframe.sources import bindings as b
from kinframe.sources.tables import Tables


@query("pair_depth_difference", sql=pg.gsql(
    """SELECT e.src AS u, e.dst AS v, abs(a.depth - c.depth) AS depth_difference
FROM edges e JOIN dep a ON a.id = e.src JOIN dep c ON c.id = e.dst""", pg.ROOTS, pg.DEPTH, recursive=True))
def q_pair_depth_difference(t: Tables):
    """Absolute depth difference of every lineage pair."""
    d = pg.depths(t).select("id", "depth")
    pairs = pg.edges(t).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return (pairs.join(d.select(F.col("id").alias("u"), F.col("depth").alias("du")), "u")
            .join(d.select(F.col("id").alias("v"), F.col("depth").alias("dv")), "v")
            .select("u", "v", F.abs(F.col("du") - F.col("dv")).alias("depth_difference")))


NUMBER_SQL = """WITH v AS (SELECT DISTINCT CAST(floor(l_extendedprice) AS BIGINT) AS n FROM lineitem WHERE l_extendedprice >= 1),
f AS (SELECT n, rtrim(CAST(n AS VARCHAR), '0') AS s, len(list_filter(range(1, CAST(floor(sqrt(n)) AS BIGINT) + 1), lambda d: n % d = 0)) * 2
  - CASE WHEN CAST(floor(sqrt(n)) AS BIGINT) * CAST(floor(sqrt(n)) AS BIGINT) = n THEN 1 ELSE 0 END AS divisors FROM v),
p AS (SELECT n, unnest(['power_of_2', 'power_of_10', 'round', 'prime', 'many_divisors']) AS property,
  unnest([n & (n - 1) = 0, s = '1', length(s) <= 2 OR right(s, 1) = '5', divisors = 2, divisors > 12]) AS hit FROM f)
SELECT property, count(*) FILTER (WHERE hit) AS n, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 6) AS percent FROM p GROUP BY property"""


@query("number_properties", sql=NUMBER_SQL)
def q_number_properties(t: Tables):
    """Distinct whole values that are powers, round, prime or rich in divisors: counts and percentages."""
    n, s = F.col("n"), F.col("s")
    v = t.lineitem.where("l_extendedprice >= 1").select(F.floor("l_extendedprice").cast("bigint").alias("n")).distinct()
    f = with_divisors(v, "n").withColumn("s", F.rtrim(n.cast("string"), F.lit("0")))
    flags = {"power_of_2": n.bitwiseAND(n - 1) == 0, "power_of_10": s == "1",
             "round": (F.length(s) <= 2) | s.endswith("5"), "prime": F.col("divisors") == 2,
             "many_divisors": F.col("divisors") > 12}
    p = f.select(F.explode(F.array(*[F.struct(F.lit(k).alias("property"), e.alias("hit")) for k, e in flags.items()])).alias("p"))
    return p.groupBy("p.property").agg(
        F.count_if("p.hit").alias("n"), r6(100.0 * F.count_if("p.hit") / F.count(F.lit(1))).alias("percent"))


DRIFT_SQL = """WITH doc_edge AS (SELECT CAST(floor(doc_id / 4) AS BIGINT) AS src, doc_id AS dst FROM documents WHERE doc_id >= 4),
card AS (SELECT d.doc_id AS id, d.n_chars AS len, l.quality FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
e AS (SELECT p.len AS pl, p.quality AS pq, c.len AS cl, c.quality AS cq FROM doc_edge x JOIN card p ON p.id = x.src JOIN card c ON c.id = x.dst)
SELECT count(*) AS edges, round(avg(CASE WHEN pq IS NULL THEN 0.0 ELSE 1.0 END) - avg(CASE WHEN cq IS NULL THEN 0.0 ELSE 1.0 END), 6) AS card_drift,
  count(pq + cq) AS both_have, round(avg(CASE WHEN pq + cq IS NOT NULL THEN CAST(pq = 0 AS DOUBLE) - CAST(cq = 0 AS DOUBLE) END), 6) AS auto_drift,
  count(*) FILTER (WHERE pq = 1 AND cq = 1) AS bespoke, round(avg(CASE WHEN pq = 1 AND cq = 1 THEN 100.0 * (cl - pl) / pl END), 6) AS mean_length_change
FROM e"""


@query("card_drift", sql=DRIFT_SQL)
def q_card_drift(t: Tables):
    """Parent minus child share of having a card (a label row stands for it), of it being auto-generated
    (quality 0) where both have one, and the mean length change in percent where both are written."""
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    card = t.documents.join(labels, "doc_id", "left").select("doc_id", "n_chars", "quality")
    ends = {k: card.select(F.col("doc_id").alias(k), F.col("n_chars").cast("double").alias(f"{k}_len"),
                           F.col("quality").alias(f"{k}_q")) for k in ("src", "dst")}
    e = b.doc_edge(t).select("src", "dst").join(ends["src"], "src").join(ends["dst"], "dst")
    p, c = F.col("src_q"), F.col("dst_q")
    share = lambda x: F.when(x, 1.0).otherwise(0.0)
    both, bespoke = p.isNotNull() & c.isNotNull(), (p == 1) & (c == 1)
    return e.agg(
        F.count(F.lit(1)).alias("edges"), r6(F.avg(share(p.isNotNull())) - F.avg(share(c.isNotNull()))).alias("card_drift"),
        F.count_if(both).alias("both_have"), r6(F.avg(F.when(both, share(p == 0) - share(c == 0)))).alias("auto_drift"),
        F.count_if(bespoke).alias("bespoke"),
        r6(F.avg(F.when(bespoke, 100.0 * (F.col("dst_len") - F.col("src_len")) / F.col("src_len")))).alias("mean_length_change"))


@query("edge_diff_fields", sql=b.with_views(
    """SELECT field, count(*) FILTER (WHERE o = n) AS equal, count(*) FILTER (WHERE o <> n) AS replaced,
  count(*) FILTER (WHERE n IS NULL) AS deleted, count(*) FILTER (WHERE o IS NULL) AS inserted FROM (
  SELECT coalesce(p.field, c.field) AS field, p.v AS o, c.v AS n FROM
    (SELECT e.dst AS edge, k AS field, json_extract_string(x.props, '$."' || k || '"') AS v FROM evt_edge e JOIN events x ON x.event_id = e.src, unnest(json_keys(x.props)) u(k)) p
    FULL JOIN (SELECT e.dst AS edge, k AS field, json_extract_string(x.props, '$."' || k || '"') AS v FROM evt_edge e JOIN events x ON x.event_id = e.dst, unnest(json_keys(x.props)) u(k)) c
    ON c.edge = p.edge AND c.field = p.field) d GROUP BY field""", "evt_edge"))
def q_edge_diff_fields(t: Tables):
    """Per JSON field: edges of the event lineage on which it stays equal, is replaced, deleted or inserted."""
    e = b.evt_edge(t).select("src", "dst")
    fields = t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "v"))

    def side(end: str, name: str):
        return e.join(fields, F.col(end) == F.col("event_id")).select(F.col("dst").alias("edge"), "field", F.col("v").alias(name))

    d = side("src", "o").join(side("dst", "n"), ["edge", "field"], "full")
    return d.groupBy("field").agg(
        F.count_if(F.col("o") == F.col("n")).alias("equal"), F.count_if(F.col("o") != F.col("n")).alias("replaced"),
        F.count_if(F.col("n").isNull()).alias("deleted"), F.count_if(F.col("o").isNull()).alias("inserted"))
