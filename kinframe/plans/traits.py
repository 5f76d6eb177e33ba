"""Trait mutation keys (§2.7 traits, §2.5 mutation_rate, §2.6 top_traits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.functions.common import r6
from kinframe.operators import traits as tr
from kinframe.plans import graph as pg
from kinframe.plans.registry import query
from kinframe.sources import bindings as b
from kinframe.sources.tables import Tables


def evt_traits(t: Tables):
    """Event lineage edges with single-valued trait arrays on both ends."""
    e = b.evt_edge(t)
    return e.select("src", "dst", tr.as_trait_array(F.col("src_trait")).alias("src_traits"),
                    tr.as_trait_array(F.col("dst_trait")).alias("dst_traits"))


def evt_transitions(t: Tables):
    return tr.trait_transitions(evt_traits(t))


def evt_counter(t: Tables):
    return tr.trait_counter(t.events.select(F.col("event_type").alias("trait")))


# SQL fragments of the oracle -------------------------------------------------
_TRANS = """tr AS (
SELECT from_trait, to_trait, CAST(sum(a) AS BIGINT) AS added_transitions, CAST(sum(r) AS BIGINT) AS removed_transitions, count(*) AS transitions
FROM (SELECT src_trait AS from_trait, dst_trait AS to_trait, 1 AS a, 0 AS r FROM evt_edge WHERE src_trait <> dst_trait
      UNION ALL SELECT src_trait, dst_trait, 0, 1 FROM evt_edge WHERE src_trait <> dst_trait) x
GROUP BY from_trait, to_trait)"""

_CANON = """canon AS (
SELECT least(from_trait, to_trait) AS trait_a, greatest(from_trait, to_trait) AS trait_b,
       CAST(sum(CASE WHEN from_trait < to_trait THEN transitions ELSE 0 END) AS BIGINT) AS n_ab,
       CAST(sum(CASE WHEN from_trait < to_trait THEN 0 ELSE transitions END) AS BIGINT) AS n_ba
FROM tr WHERE from_trait <> to_trait GROUP BY 1, 2)"""

_NET = """net AS (
SELECT trait, CAST(sum(f) AS BIGINT) AS net_flow FROM (
  SELECT from_trait AS trait, transitions AS f FROM tr UNION ALL SELECT to_trait, -transitions FROM tr) x GROUP BY trait),
ord AS (SELECT trait, net_flow, CAST(row_number() OVER (ORDER BY net_flow DESC, trait) AS INTEGER) AS position FROM net)"""


def _evt(body: str, *ctes: str) -> str:
    return b.with_views(body, "evt_edge", ctes=ctes)


@query("trait_counter", sql=b.with_views(
    "SELECT trait, count(*) AS appearances FROM cat_trait WHERE trait IS NOT NULL GROUP BY trait",
    "cat_trait"))
def q_trait_counter(t: Tables):
    return tr.trait_counter(b.cat_trait(t))


@query("trait_transitions", sql=_evt(
    "SELECT * FROM tr", _TRANS))
def q_trait_transitions(t: Tables):
    return evt_transitions(t)


@query("trait_appearances", sql=_evt(
    """SELECT n.trait, CAST(coalesce(c.appearances, 0) AS BIGINT) AS total_appearances
FROM (SELECT from_trait AS trait FROM tr UNION SELECT to_trait FROM tr) n
LEFT JOIN (SELECT event_type AS trait, count(*) AS appearances FROM events GROUP BY 1) c ON c.trait = n.trait""", _TRANS))
def q_trait_appearances(t: Tables):
    return tr.trait_appearances(evt_transitions(t), evt_counter(t))


@query("trait_ratios", sql=_evt(
    "SELECT trait_a, trait_b, n_ab, n_ba, round(n_ab / (n_ab + n_ba), 6) AS ratio FROM canon WHERE n_ab + n_ba > 0",
    _TRANS, _CANON))
def q_trait_ratios(t: Tables):
    return tr.trait_ratios(evt_transitions(t)).withColumn("ratio", r6("ratio"))


_ORIENTED_SQL = """SELECT CASE WHEN n_ab > n_ba THEN trait_a ELSE trait_b END AS from_trait,
       CASE WHEN n_ab > n_ba THEN trait_b ELSE trait_a END AS to_trait,
       abs(n_ab - n_ba) AS traffic, n_ab + n_ba AS total_n
FROM canon WHERE n_ab <> n_ba"""


@query("oriented_traits", sql=_evt(_ORIENTED_SQL, _TRANS, _CANON))
def q_oriented_traits(t: Tables):
    return tr.oriented_traits(evt_transitions(t))


@query("oriented_totals", sql=_evt(
    f"""SELECT CAST(coalesce(sum(traffic), 0) AS BIGINT) AS total_traffic, CAST(coalesce(sum(total_n), 0) AS BIGINT) AS total_n,
count(*) AS edge_count FROM ({_ORIENTED_SQL}) o""", _TRANS, _CANON))
def q_oriented_totals(t: Tables):
    return tr.oriented_totals(tr.oriented_traits(evt_transitions(t)))


@query("top_traits", sql=b.with_views(
    """SELECT trait, total_appearances, CAST(row_number() OVER (ORDER BY r) AS INTEGER) AS rank FROM (
  SELECT trait, total_appearances, r FROM (
    SELECT trait, total_appearances, row_number() OVER (ORDER BY total_appearances DESC, trait) AS r
    FROM (SELECT trait, count(*) AS total_appearances FROM cat_trait WHERE trait IS NOT NULL GROUP BY trait) c) x
  WHERE r <= 10 + 5 AND trait NOT IN ('other', 'unknown', 'None', '', '[]')) y
QUALIFY row_number() OVER (ORDER BY r) <= 10""", "cat_trait"))
def q_top_traits(t: Tables):
    counter = tr.trait_counter(b.cat_trait(t)).withColumnRenamed("appearances", "total_appearances")
    return tr.top_traits(counter, 10)


@query("net_flow_order", sql=_evt("SELECT * FROM ord", _TRANS, _NET))
def q_net_flow_order(t: Tables):
    return tr.net_flow_order(evt_transitions(t))


@query("order_score", sql=_evt(
    """SELECT CAST(coalesce(sum(CASE WHEN a.position < c.position THEN transitions ELSE 0 END), 0) AS BIGINT) AS compatible_traffic,
       CAST(coalesce(sum(transitions), 0) AS BIGINT) AS total_traffic,
       round(CASE WHEN sum(transitions) > 0 THEN sum(CASE WHEN a.position < c.position THEN transitions ELSE 0 END) / sum(transitions) END, 6) AS compatible_share
FROM tr JOIN ord a ON a.trait = tr.from_trait JOIN ord c ON c.trait = tr.to_trait WHERE a.position <> c.position""",
    _TRANS, _NET))
def q_order_score(t: Tables):
    trans = evt_transitions(t)
    return tr.order_score(trans, tr.net_flow_order(trans)).withColumn(
        "compatible_share", r6("compatible_share"))


@query("order_violations", sql=_evt(
    """SELECT from_trait, to_trait, transitions, a.position AS from_pos, c.position AS to_pos
FROM tr JOIN ord a ON a.trait = tr.from_trait JOIN ord c ON c.trait = tr.to_trait WHERE a.position > c.position""",
    _TRANS, _NET))
def q_order_violations(t: Tables):
    trans = evt_transitions(t)
    return tr.order_violations(trans, tr.net_flow_order(trans))


@query("mutation_rate", sql=_evt(
    """SELECT round(coalesce(sum(CASE WHEN src_trait <> dst_trait THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0), 6) AS mutations, count(*) AS traffic,
       round(sum(CASE WHEN src_trait <> dst_trait THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / count(*), 6) AS mutation_rate
FROM evt_edge WHERE src_trait IS NOT NULL AND src_trait <> '' AND dst_trait IS NOT NULL AND dst_trait <> ''"""))
def q_mutation_rate(t: Tables):
    m = tr.mutation_rate(evt_traits(t))
    return m.select(r6("mutations").alias("mutations"), "traffic", r6("mutation_rate").alias("mutation_rate"))


LIN_TRAITS = """tt AS (SELECT p_partkey AS id, list_filter([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)], lambda x: x <> '') AS ts FROM part),
lt AS (SELECT s.ts AS st, d.ts AS dt FROM edges JOIN tt s ON s.id = src JOIN tt d ON d.id = dst)"""


def lin_traits(t: Tables):
    """Lineage edges with the multi-valued traits of both ends."""
    return tr.attach_traits(pg.edges(t), b.cat_traits_array(t))


@query("lin_trait_transitions", sql=pg.gsql(
    """SELECT from_trait, to_trait, CAST(sum(a) AS BIGINT) AS added_transitions, CAST(sum(r) AS BIGINT) AS removed_transitions, count(*) AS transitions FROM (
  SELECT f AS from_trait, x AS to_trait, 1 AS a, 0 AS r FROM (SELECT st, unnest(list_filter(list_distinct(dt), lambda z: NOT list_contains(st, z))) AS x FROM lt) k, unnest(k.st) u(f)
  UNION ALL SELECT x, f, 0, 1 FROM (SELECT dt, unnest(list_filter(list_distinct(st), lambda z: NOT list_contains(dt, z))) AS x FROM lt) k, unnest(k.dt) u(f)) y
GROUP BY from_trait, to_trait""", LIN_TRAITS))
def q_lin_trait_transitions(t: Tables):
    """Transition graph of the multi-valued traits along lineage edges."""
    return tr.trait_transitions(lin_traits(t))


@query("lin_mutation_rate", sql=pg.gsql(
    """SELECT round(sum(j), 6) AS mutations, count(*) AS traffic, round(avg(j), 6) AS mutation_rate FROM (
  SELECT 1 - len(list_intersect(st, dt)) / len(list_distinct(list_concat(st, dt))) AS j FROM lt WHERE len(st) > 0 AND len(dt) > 0) z""", LIN_TRAITS))
def q_lin_mutation_rate(t: Tables):
    """Mean Jaccard distance of the trait sets along lineage edges."""
    m = tr.mutation_rate(lin_traits(t))
    return m.select(r6("mutations").alias("mutations"), "traffic", r6("mutation_rate").alias("mutation_rate"))
