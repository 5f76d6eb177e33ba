"""Deterministic kinship samples and their similarity (§2.7 samplers, §2.8 kinship)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.functions.common import r6
from kinframe.operators import sampling as sm
from kinframe.operators import similarity as S
from kinframe.operators.bootstrap import mean_interval
from kinframe.plans import graph as pg
from kinframe.plans.registry import query
from kinframe.plans.similarity import TF_SQL, tfidf_sql, tfidf_table
from kinframe.sources import bindings as b
from kinframe.sources.tables import Tables

#: Draws per sampler and configuration.
N = 5000
SEED = 42


def U(key_sql: str) -> str:
    return f"('0x' || substr(md5({key_sql}), 1, 15))::BIGINT"


def K(motif: str, slot: str) -> str:
    return f"'{SEED}:{motif}:' || CAST(i AS VARCHAR) || ':{slot}'"


DRAWS = f"dr AS (SELECT range AS i FROM range({N}))"
NIDX = "nidx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS nidx FROM cat)"
CIDX = "cidx AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS cidx FROM edges)"
OUTD = "od AS (SELECT src AS id, count(*) AS k FROM edges GROUP BY src)"


def ssql(body: str, *ctes: str) -> str:
    return pg.gsql(body, DRAWS, *ctes)


def kin(t: Tables) -> sm.Kin:
    return sm.index_kin(b.cat(t).select("id"), pg.edges(t))


RANDOM_SQL = f"""SELECT 1 AS config, d.i, na.id AS u, nb.id AS v FROM (
  SELECT i, a, CASE WHEN b0 >= a THEN b0 + 1 ELSE b0 END AS b FROM (
    SELECT i, {U(K('random', 'a'))} % n AS a, {U(K('random', 'b'))} % (n - 1) AS b0 FROM dr, (SELECT count(*) AS n FROM cat) c) x) d
JOIN nidx na ON na.nidx = d.a JOIN nidx nb ON nb.nidx = d.b"""
EDGES_SQL = f"""SELECT 1 AS config, d.i, e.src AS u, e.dst AS v FROM (SELECT i, {U(K('edges', 'e'))} % (SELECT count(*) FROM edges) AS eidx FROM dr) d
JOIN (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS eidx FROM edges) e ON e.eidx = d.eidx"""


@query("sample_random_pairs", sql=ssql(RANDOM_SQL, NIDX))
def q_sample_random_pairs(t: Tables):
    return sm.sample_random_pairs(kin(t), N, SEED)


@query("sample_edges", sql=ssql(EDGES_SQL))
def q_sample_edges(t: Tables):
    return sm.sample_edges(kin(t), N, SEED)


SIB2_CTES = (
    "it AS (SELECT id AS src, k, k * (k - 1) // 2 AS w, sum(k * (k - 1) // 2) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cum FROM od WHERE k >= 2)",
    f"pk AS (SELECT d.i, it.src, it.k FROM (SELECT i, {U(K('siblings2', 'p'))} % (SELECT sum(w) FROM it) AS x FROM dr) d JOIN it ON coalesce(it.cum, 0) <= d.x AND d.x < coalesce(it.cum, 0) + it.w)",
    f"ab AS (SELECT i, src, a, CASE WHEN b0 >= a THEN b0 + 1 ELSE b0 END AS b FROM (SELECT i, src, {U(K('siblings2', 'a'))} % k AS a, {U(K('siblings2', 'b'))} % (k - 1) AS b0 FROM pk) z)",
    "j AS (SELECT ab.i, ab.src, ca.dst AS wa, cb.dst AS wb FROM ab JOIN cidx ca ON ca.src = ab.src AND ca.cidx = ab.a JOIN cidx cb ON cb.src = ab.src AND cb.cidx = ab.b)",
)


@query("sample_siblings2", sql=ssql(
    "SELECT 1 AS config, i, src AS u, wa AS v FROM j UNION ALL SELECT 2, i, wa, wb FROM j", OUTD, CIDX, *SIB2_CTES))
def q_sample_siblings2(t: Tables):
    return sm.sample_siblings2(kin(t), N, SEED)


CHAIN3_CTES = (
    f"it AS (SELECT e.src, e.dst, od.k AS w, sum(od.k) OVER (ORDER BY e.src, e.dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cum FROM edges e JOIN od ON od.id = e.dst WHERE od.k >= 1)",
    f"pk AS (SELECT d.i, it.src AS pu, it.dst AS pv, it.w AS k FROM (SELECT i, {U(K('chain3', 'e'))} % (SELECT sum(w) FROM it) AS x FROM dr) d JOIN it ON coalesce(it.cum, 0) <= d.x AND d.x < coalesce(it.cum, 0) + it.w)",
    f"j AS (SELECT pk.i, pk.pu, pk.pv, c.dst AS pw FROM pk JOIN cidx c ON c.src = pk.pv AND c.cidx = {U(K('chain3', 'c'))} % pk.k)",
)


@query("sample_chain3", sql=ssql(
    "SELECT 1 AS config, i, pu AS u, pw AS v FROM j UNION ALL SELECT 2, i, pv, pw FROM j UNION ALL SELECT 3, i, pu, pv FROM j",
    OUTD, CIDX, *CHAIN3_CTES))
def q_sample_chain3(t: Tables):
    return sm.sample_chain3(kin(t), N, SEED)


PIDX = "pidx AS (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS pidx FROM edges)"
IND = "ind AS (SELECT dst AS id, count(*) AS k FROM edges GROUP BY dst)"


def _other_sql(n: str, first: str, draw: str) -> str:
    return f"CASE WHEN {draw} % ({n} - 1) >= {first} THEN {draw} % ({n} - 1) + 1 ELSE {draw} % ({n} - 1) END"


def _picked_sql(name: str, motif: str, items: str, weight: str, order: str, slot: str) -> str:
    """CTEs ``<name>i`` (items with running weight) and ``<name>p`` (the draws with their item)."""
    return (f"{name}i AS (SELECT *, {weight} AS w, coalesce(sum({weight}) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM ({items}) z WHERE {weight} > 0), "
            f"{name}p AS (SELECT d.i, t.* FROM (SELECT i, {U(K(motif, slot))} % (SELECT sum(w) FROM {name}i) AS x FROM dr) d JOIN {name}i t ON t.cum <= d.x AND d.x < t.cum + t.w)")


_KIN_EDGES = "SELECT e.src, e.dst, c.cidx, ou.k AS ou, coalesce(iu.k, 0) AS iu, coalesce(ov.k, 0) AS ov FROM edges e JOIN cidx c ON c.src = e.src AND c.dst = e.dst JOIN od ou ON ou.id = e.src LEFT JOIN ind iu ON iu.id = e.src LEFT JOIN od ov ON ov.id = e.dst"
_CHILD = "JOIN cidx {0} ON {0}.src = {1} AND {0}.cidx = {2}"
SIB3_CTES = (_picked_sql("s3", "siblings3", "SELECT id, k FROM od", "(k * (k - 1) * (k - 2) // 6)", "id", "p"),
             f"s3j AS (SELECT p.i, p.id AS p, a.dst AS w, c.dst AS x FROM s3p p {_CHILD.format('a', 'p.id', U(K('siblings3', 'a')) + ' % p.k')} "
             f"{_CHILD.format('c', 'p.id', _other_sql('p.k', U(K('siblings3', 'a')) + ' % p.k', U(K('siblings3', 'b'))))})")
FORK_CTES = (_picked_sql("fb", "fork_below", _KIN_EDGES, "(ov * (ov - 1) // 2)", "src, dst", "e"),
             f"fbj AS (SELECT p.i, p.src AS s, p.dst AS v, a.dst AS w, c.dst AS x FROM fbp p {_CHILD.format('a', 'p.dst', U(K('fork_below', 'c')) + ' % p.ov')} "
             f"{_CHILD.format('c', 'p.dst', _other_sql('p.ov', U(K('fork_below', 'c')) + ' % p.ov', U(K('fork_below', 'd'))))})")
UNCLE_CTES = (_picked_sql("un", "uncle", _KIN_EDGES, "(ov * (ou - 1))", "src, dst", "e"),
              f"unj AS (SELECT p.i, p.src AS s, p.dst AS v, a.dst AS w, c.dst AS x FROM unp p {_CHILD.format('a', 'p.dst', U(K('uncle', 'c')) + ' % p.ov')} "
              f"{_CHILD.format('c', 'p.src', _other_sql('p.ou', 'p.cidx', U(K('uncle', 'x'))))})")
CHAIN4_CTES = (_picked_sql("c4", "chain4", _KIN_EDGES, "(iu * ov)", "src, dst", "e"),
               f"c4j AS (SELECT p.i, p.src AS s, p.dst AS v, a.dst AS w, t.src AS t FROM c4p p {_CHILD.format('a', 'p.dst', U(K('chain4', 'c')) + ' % p.ov')} "
               f"JOIN pidx t ON t.dst = p.src AND t.pidx = {U(K('chain4', 't'))} % p.iu)")


def _configs_sql(table: str, configs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {c} AS config, i, least({a}, {z}) AS u, greatest({a}, {z}) AS v FROM {table}" for c, (a, z) in enumerate(configs, 1))


SIB3_SQL = "SELECT 1 AS config, i, p AS u, w AS v FROM s3j UNION ALL SELECT 2, i, least(w, x), greatest(w, x) FROM s3j"
FORK_SQL = _configs_sql("fbj", [("s", "w"), ("v", "w"), ("s", "v"), ("w", "x")])
UNCLE_SQL = _configs_sql("unj", [("s", "w"), ("w", "x"), ("v", "w"), ("s", "v"), ("v", "x")])
CHAIN4_SQL = _configs_sql("c4j", [("t", "w"), ("s", "w"), ("t", "v"), ("v", "w"), ("s", "v"), ("t", "s")])
_BASE = (OUTD, IND, CIDX, PIDX)


@query("sample_siblings3", sql=ssql(SIB3_SQL, *_BASE, *SIB3_CTES))
def q_sample_siblings3(t: Tables):
    return sm.sample_siblings3(kin(t), N, SEED)


@query("sample_fork_below", sql=ssql(FORK_SQL, *_BASE, *FORK_CTES))
def q_sample_fork_below(t: Tables):
    return sm.sample_fork_below(kin(t), N, SEED)


@query("sample_uncle", sql=ssql(UNCLE_SQL, *_BASE, *UNCLE_CTES))
def q_sample_uncle(t: Tables):
    return sm.sample_uncle(kin(t), N, SEED)


@query("sample_chain4", sql=ssql(CHAIN4_SQL, *_BASE, *CHAIN4_CTES))
def q_sample_chain4(t: Tables):
    return sm.sample_chain4(kin(t), N, SEED)


def kin_cosines(t: Tables):
    """``motif, config, u, v, cosine`` of all 8 motifs and 24 configurations: TF-IDF cosines of the card texts; pairs
    whose ends lack a card are left out. The graph is indexed once, the distinct pairs are compared once."""
    index = kin(t)
    samples = reduce(DataFrame.unionByName, [f(index, N, SEED).withColumn("motif", F.lit(m)) for m, f in sm.SAMPLERS.items()])
    samples = samples.checkpoint()  # 24 configurations of N pairs
    ends = samples.select(F.explode(F.array("u", "v")).alias("doc")).distinct()
    w = tfidf_table(t, only=F.broadcast(ends)).checkpoint()  # at most 2 x 24 x N ids
    have = w.select(F.col("doc").alias("id")).distinct()
    s = (samples.join(have.withColumnRenamed("id", "u"), "u", "left_semi")
         .join(have.withColumnRenamed("id", "v"), "v", "left_semi"))
    cos = S.cosine_sparse(s.select("u", "v").distinct(), w)
    return s.join(cos, ["u", "v"]).select("motif", "config", "u", "v", "cosine"), index


_ALL_KIN = " UNION ALL ".join(f"SELECT '{m}' AS motif, config, u, v FROM ({q}) m_{m}" for m, q in {
    "random_pairs": RANDOM_SQL, "edges": EDGES_SQL, "siblings2": "SELECT 1 AS config, i, src AS u, wa AS v FROM j UNION ALL SELECT 2, i, wa, wb FROM j",
    "siblings3": SIB3_SQL, "fork_below": FORK_SQL, "uncle": UNCLE_SQL, "chain4": CHAIN4_SQL}.items())
KIN_SQL = ssql(f"""SELECT motif, config, round(avg(s), 6) AS mean_similarity, count(*) AS pairs, max(population) AS population
FROM (SELECT motif, config, coalesce(d.s, 0) AS s FROM kinp p LEFT JOIN dots d ON d.u = p.u AND d.v = p.v) x JOIN pops USING (motif) GROUP BY motif, config""",
    *_BASE, NIDX, *SIB2_CTES, *SIB3_CTES, *FORK_CTES, *UNCLE_CTES, *CHAIN4_CTES,
    *[c.replace("it AS", "it3 AS").replace("pk AS", "pk3 AS").replace("j AS", "j3 AS").replace("FROM it)", "FROM it3)").replace("JOIN it ON", "JOIN it3 it ON").replace("FROM pk", "FROM pk3 pk") for c in CHAIN3_CTES],
    TF_SQL, tfidf_sql(), f"""kinp AS (SELECT * FROM ({_ALL_KIN}
  UNION ALL SELECT 'chain3', 1, pu, pw FROM j3 UNION ALL SELECT 'chain3', 2, pv, pw FROM j3 UNION ALL SELECT 'chain3', 3, pu, pv FROM j3) z
  WHERE u IN (SELECT doc FROM tw) AND v IN (SELECT doc FROM tw))""",
    "dots AS (SELECT p.u, p.v, sum(a.weight * c.weight) AS s FROM (SELECT DISTINCT u, v FROM kinp) p JOIN tw a ON a.doc = p.u JOIN tw c ON c.doc = p.v AND c.term = a.term GROUP BY p.u, p.v)",
    """pops AS (SELECT 'random_pairs' AS motif, (SELECT CAST(count(*) * (count(*) - 1) AS BIGINT) FROM cat) AS population UNION ALL SELECT 'edges', (SELECT count(*) FROM edges)
  UNION ALL SELECT 'siblings2', (SELECT CAST(sum(w) AS BIGINT) FROM it) UNION ALL SELECT 'siblings3', (SELECT CAST(sum(w) AS BIGINT) FROM s3i) UNION ALL SELECT 'chain3', (SELECT CAST(sum(w) AS BIGINT) FROM it3)
  UNION ALL SELECT 'fork_below', (SELECT CAST(sum(w) AS BIGINT) FROM fbi) UNION ALL SELECT 'uncle', (SELECT CAST(sum(w) AS BIGINT) FROM uni) UNION ALL SELECT 'chain4', (SELECT CAST(sum(w) AS BIGINT) FROM c4i))""")


@query("kinship_similarity", sql=KIN_SQL)
def q_kinship_similarity(t: Tables):
    """Mean TF-IDF cosine per kinship motif and configuration with the sample size and the motif's population."""
    cosines, index = kin_cosines(t)
    sizes = index.totals.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(m) for m in sm.SAMPLERS]),
        F.array(F.expr("n_nodes * (n_nodes - 1)"), F.col("n_edges"), *[F.col(f"all_{m}") for m in list(sm.SAMPLERS)[2:]]))).alias("motif", "population"))
    means = cosines.groupBy("motif", "config").agg(r6(F.avg("cosine")).alias("mean_similarity"), F.count(F.lit(1)).alias("pairs"))
    return means.join(sizes, "motif").select("motif", "config", "mean_similarity", "pairs", F.col("population").cast("long").alias("population"))


# No SQL: the replicates of 24 groups of thousands of values take DuckDB too long; tests/test_resampling.py holds the operator against them.
@query("kinship_intervals")
def q_kinship_intervals(t: Tables):
    """Bootstrap interval of the mean similarity of every motif and configuration."""
    cosines, _ = kin_cosines(t)
    grouped = cosines.select(F.concat_ws(":", "motif", "config").alias("kin"), r6("cosine").alias("cosine"))
    out = mean_interval(grouped, "kin", "cosine", 1000, SEED)
    return out.select(F.split_part("kin", F.lit(":"), F.lit(1)).alias("motif"), F.split_part("kin", F.lit(":"), F.lit(2)).cast("int").alias("config"),
                      "n", *[r6(c).alias(c) for c in ("mean", "ci_lower", "ci_upper")])
