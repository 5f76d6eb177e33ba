"""Deterministic, reproducible draws over the lineage graph.

A draw is a hash of a text key ``'<seed>:<motif>:<i>:<slot>'`` (60 bits of its
md5), so any engine computing the same key gets the same draw. Weighted picks
use cumulative weights from ``running_sum`` and an equi-join on weight buckets
(a parent whose weight spans many buckets is exploded over at most the bucket
count), never a single-partition window or a nested-loop range join.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.operators.graph import degrees
from kinframe.operators.sequence import dense_index, running_sums
from kinframe.session import ensure_checkpoint_dir


def u64(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def draw_key(seed: int, motif: str, slot: str) -> Column:
    return F.concat(F.lit(f"{seed}:{motif}:"), F.col("i").cast("string"), F.lit(f":{slot}"))


@dataclasses.dataclass(frozen=True)
class Kin:
    """A lineage graph indexed once for all samplers (every table is checkpointed).

    ``nodes``: id, nidx, out-degree k and running weights of sibling pairs and triples; ``edges``: src, dst, eidx, the
    place ``cidx`` of dst among the children of src and ``pidx`` of src among the parents of dst, the degrees ``ou``
    (children of src), ``iu`` (parents of src), ``ov`` (children of dst), and the running weights of the edge motifs;
    ``totals``: one row with the number of nodes and edges and the total weights."""

    nodes: DataFrame
    edges: DataFrame
    totals: DataFrame


#: Motif -> weight of a node (out-degree k) or of an edge.
NODE_WEIGHTS = {"siblings2": "k * (k - 1) div 2", "siblings3": "k * (k - 1) * (k - 2) div 6"}
EDGE_WEIGHTS = {"chain3": "ov", "fork_below": "ov * (ov - 1) div 2", "uncle": "ov * (ou - 1)", "chain4": "iu * ov"}


def index_kin(nodes: DataFrame, edges: DataFrame) -> Kin:
    ensure_checkpoint_dir(nodes.sparkSession)
    links = edges.select("src", "dst").checkpoint()
    deg = degrees(nodes, links).select("id", F.col("out_degree").alias("k"), F.col("in_degree").alias("i")).checkpoint()
    per_node = deg.select("id", "k", F.lit(1).alias("one"), *[F.expr(w).alias(f"w_{m}") for m, w in NODE_WEIGHTS.items()])
    n = running_sums(per_node, [], ["id"], {"nidx": "one", **{f"cum_{m}": f"w_{m}" for m in NODE_WEIGHTS}}, inclusive=False).drop("one").checkpoint()
    e = dense_index(dense_index(links, ["src"], ["dst"], "cidx"), ["dst"], ["src"], "pidx")
    e = (e.join(deg.select(F.col("id").alias("src"), F.col("k").alias("ou"), F.col("i").alias("iu")), "src")
         .join(deg.select(F.col("id").alias("dst"), F.col("k").alias("ov")), "dst"))
    e = e.select("src", "dst", "cidx", "pidx", "ou", "iu", "ov", F.lit(1).alias("one"), *[F.expr(w).alias(f"w_{m}") for m, w in EDGE_WEIGHTS.items()])
    e = running_sums(e, [], ["src", "dst"], {"eidx": "one", **{f"cum_{m}": f"w_{m}" for m in EDGE_WEIGHTS}}, inclusive=False).drop("one").checkpoint()
    totals = n.agg(F.count(F.lit(1)).alias("n_nodes"), *[F.sum(f"w_{m}").alias(f"all_{m}") for m in NODE_WEIGHTS]).crossJoin(  # one row each
        e.agg(F.count(F.lit(1)).alias("n_edges"), *[F.sum(f"w_{m}").alias(f"all_{m}") for m in EDGE_WEIGHTS])).checkpoint()
    return Kin(n, e, totals)


def weighted_pick(items: DataFrame, weight: str, cum: str, draws: DataFrame, x: str, total: str, buckets: int = 1024) -> DataFrame:
    """Join each draw (value ``x`` in [0, total)) to the item whose range [cum, cum + weight) contains it."""
    width = F.greatest(F.ceil(F.col(total) / buckets), F.lit(1)).cast("bigint")
    sized = items.where(F.col(weight) > 0).crossJoin(draws.select(F.max(width).alias("_bw")))  # one row
    it = sized.withColumn("_bk", F.explode(F.sequence(F.floor(F.col(cum) / F.col("_bw")),
                                                      F.floor((F.col(cum) + F.col(weight) - 1) / F.col("_bw")))))
    d = draws.withColumn("_bk", F.floor(F.col(x) / width))
    j = d.join(it.drop("_bw"), "_bk")
    return j.where((F.col(cum) <= F.col(x)) & (F.col(x) < F.col(cum) + F.col(weight))).drop("_bk")


def _draws(kin: Kin, n: int) -> DataFrame:
    return kin.totals.sparkSession.range(n).select(F.col("id").alias("i")).crossJoin(kin.totals)  # totals: one row


def _picked(kin: Kin, motif: str, n: int, seed: int, slot: str) -> DataFrame:
    """``n`` nodes or edges drawn with the motif's weight."""
    total = f"all_{motif}"
    d = _draws(kin, n).where(F.col(total) > 0).select("i", total, (u64(draw_key(seed, motif, slot)) % F.col(total)).alias("x"))
    return weighted_pick(kin.nodes if motif in NODE_WEIGHTS else kin.edges, f"w_{motif}", f"cum_{motif}", d, "x", total)


def _relative(kin: Kin, picked: DataFrame, of: str, place: str, out: str, up: bool = False) -> DataFrame:
    """Adds the child (``up``: the parent) of column ``of`` at position ``place``."""
    side, end, at = ("dst", "src", "pidx") if up else ("src", "dst", "cidx")
    return picked.join(kin.edges.select(F.col(side).alias(of), F.col(at).alias(place), F.col(end).alias(out)), [of, place])


def _other(first: Column, key: Column, n: str) -> Column:
    """A position among ``n`` other than ``first``."""
    b0 = u64(key) % (F.col(n) - 1)
    return F.when(b0 >= first, b0 + 1).otherwise(b0)


def _pairs(j: DataFrame, configs: list[tuple[str, str]], ordered: bool = False) -> DataFrame:
    """``config, i, u, v`` of every configuration, in one pass; ``ordered``: the lesser end first."""
    ends = [F.struct(F.lit(c).alias("config"), *((F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) if ordered else (
        F.col(a).alias("u"), F.col(b).alias("v")))) for c, (a, b) in enumerate(configs, start=1)]
    return j.select("i", F.explode(F.array(*ends)).alias("p")).select("p.config", "i", "p.u", "p.v")


def sample_random_pairs(kin: Kin, n: int, seed: int = 42) -> DataFrame:
    a = u64(draw_key(seed, "random", "a")) % F.col("n_nodes")
    d = _draws(kin, n).where("n_nodes > 1").select("i", a.alias("a"), _other(a, draw_key(seed, "random", "b"), "n_nodes").alias("b"))
    na = kin.nodes.select(F.col("nidx").alias("a"), F.col("id").alias("u"))
    nb = kin.nodes.select(F.col("nidx").alias("b"), F.col("id").alias("v"))
    return d.join(na, "a").join(nb, "b").select(F.lit(1).alias("config"), "i", "u", "v")


def sample_edges(kin: Kin, n: int, seed: int = 42) -> DataFrame:
    d = _draws(kin, n).where("n_edges > 0").select("i", (u64(draw_key(seed, "edges", "e")) % F.col("n_edges")).alias("eidx"))
    return d.join(kin.edges, "eidx").select(F.lit(1).alias("config"), "i", F.col("src").alias("u"), F.col("dst").alias("v"))


def _two_children(kin: Kin, motif: str, n: int, seed: int) -> DataFrame:
    """A parent ``p`` drawn with the motif's weight and two of its children, ``w`` and ``x``."""
    a = u64(draw_key(seed, motif, "a")) % F.col("k")
    p = _picked(kin, motif, n, seed, "p").select("i", F.col("id").alias("p"), a.alias("ca"), _other(a, draw_key(seed, motif, "b"), "k").alias("cb"))
    return _relative(kin, _relative(kin, p, "p", "ca", "w"), "p", "cb", "x")


def sample_siblings2(kin: Kin, n: int, seed: int = 42) -> DataFrame:
    """Parent drawn with weight C(k, 2); two distinct children. Config 1:
    parent–child, config 2: the sibling pair."""
    return _pairs(_two_children(kin, "siblings2", n, seed), [("p", "w"), ("w", "x")])


def sample_siblings3(kin: Kin, n: int, seed: int = 42) -> DataFrame:
    """Parent drawn with weight C(k, 3). Config 1: parent–child, config 2: two of the three siblings."""
    return _pairs(_two_children(kin, "siblings3", n, seed).select("i", "p", "w", F.least("w", "x").alias("a"), F.greatest("w", "x").alias("b")),
                  [("p", "w"), ("a", "b")])


def _edge_and_child(kin: Kin, motif: str, n: int, seed: int, *more: Column) -> DataFrame:
    """An edge ``s`` → ``v`` drawn with the motif's weight and a child ``w`` of its end."""
    p = _picked(kin, motif, n, seed, "e").select("i", F.col("src").alias("s"), F.col("dst").alias("v"),
                                                 (u64(draw_key(seed, motif, "c")) % F.col("ov")).alias("at"), *more)
    return _relative(kin, p, "v", "at", "w")


def sample_chain3(kin: Kin, n: int, seed: int = 42) -> DataFrame:
    """Edge (s, v) drawn with weight outdeg(v), then a child w of v.
    Config 1: s–w, 2: v–w, 3: s–v."""
    return _pairs(_edge_and_child(kin, "chain3", n, seed), [("s", "w"), ("v", "w"), ("s", "v")])


def sample_fork_below(kin: Kin, n: int, seed: int = 42) -> DataFrame:
    """Edge (s, v) drawn with weight C(outdeg(v), 2), then two children w, x of v.
    Config 1: s–w, 2: v–w, 3: s–v, 4: w–x."""
    at = u64(draw_key(seed, "fork_below", "c")) % F.col("ov")
    j = _edge_and_child(kin, "fork_below", n, seed, _other(at, draw_key(seed, "fork_below", "d"), "ov").alias("at2"))
    return _pairs(_relative(kin, j, "v", "at2", "x"), [("s", "w"), ("v", "w"), ("s", "v"), ("w", "x")], ordered=True)


def sample_uncle(kin: Kin, n: int, seed: int = 42) -> DataFrame:
    """Edge (s, v) drawn with weight outdeg(v)·(outdeg(s) − 1), a child w of v and another child x of s.
    Config 1: s–w, 2: w–x, 3: v–w, 4: s–v, 5: v–x."""
    j = _edge_and_child(kin, "uncle", n, seed, _other(F.col("cidx"), draw_key(seed, "uncle", "x"), "ou").alias("at2"))
    return _pairs(_relative(kin, j, "s", "at2", "x"), [("s", "w"), ("w", "x"), ("v", "w"), ("s", "v"), ("v", "x")], ordered=True)


def sample_chain4(kin: Kin, n: int, seed: int = 42) -> DataFrame:
    """Edge (s, v) drawn with weight indeg(s)·outdeg(v), a parent t of s and a child w of v.
    Config 1: t–w, 2: s–w, 3: t–v, 4: v–w, 5: s–v, 6: t–s."""
    j = _edge_and_child(kin, "chain4", n, seed, (u64(draw_key(seed, "chain4", "t")) % F.col("iu")).alias("at2"))
    return _pairs(_relative(kin, j, "s", "at2", "t", up=True),
                  [("t", "w"), ("s", "w"), ("t", "v"), ("v", "w"), ("s", "v"), ("t", "s")], ordered=True)


#: Every motif and its sampler.
SAMPLERS = {"random_pairs": sample_random_pairs, "edges": sample_edges, "siblings2": sample_siblings2, "chain3": sample_chain3,
            "siblings3": sample_siblings3, "fork_below": sample_fork_below, "uncle": sample_uncle, "chain4": sample_chain4}
