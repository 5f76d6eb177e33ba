"""Containment of names, nested trees and nested metadata against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinframe.functions import params as PM
from kinframe.operators import names as N
from kinframe.operators.trees import flatten_trees
from kinframe.plans.buckets import coverage


@pytest.mark.parametrize("group", [4096, 2])
def test_contained_names_equal_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(N, "GROUP", group)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé_") for _ in range(n))
    texts = [word(rng.randrange(0, 40)) for _ in range(200)] + ["steelred17x", "aaaaaaaaaaaa", None, "", "aaaaaaaaaaaa"]
    names = [word(rng.randrange(0, 12)) for _ in range(300)] + [t[2:14] for t in texts[:60]] + ["steelred1", "steelred17xy", "", None, "a" * 7]
    got = N.contained_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    got = [r.name for r in got.collect()]
    want = {n for n in names if n is not None and any(n in t for t in texts if t is not None)}
    assert sorted(got) == sorted(want) and 50 < len(want) < len(set(names))


def test_no_texts(spark):
    names = spark.createDataFrame([("",), ("abc",), ("abcdefgh",)], "name string")
    assert N.contained_names(names, spark.createDataFrame([], "text string")).collect() == []


def test_coverage_follows_the_rules(spark):
    ids = [(1, "org/Steel-Red_1"), (2, "org/steel"), (3, "other"), (4, " "), (5, None), (6, "a/b/c"), (7, "x/Foo"), (8, "y/foo.csv")]
    files = [("Steel-Red_1_finetunes_2025.csv",), ("abc-big.csv",), ("foo.csv",), ("_finetunes_odd.csv",), (None,)]
    got = coverage(spark.createDataFrame(ids, "id long, model_id string"), spark.createDataFrame(files, "file string"))
    assert {r.id: r.status for r in got.collect()} == {1: "exact", 2: "contained", 3: "missing", 6: "contained", 7: "contained", 8: "exact"}


def walk(model, out, edges, level=0):
    if "model_id" not in model:
        return
    meta = model.get("metadata", {})
    key = model["model_id"].split("hub.example/")[-1]
    out[key] = (meta.get("downloads", 0), meta.get("likes", 0), model.get("depth", 0), min(level, out.get(key, (0, 0, 0, level))[3]))
    for child in model.get("children", []):
        if "model_id" in child:
            edges.add((key, child["model_id"].split("hub.example/")[-1]))
            walk(child, out, edges, level + 1)


def test_nested_trees_of_any_depth(spark):
    deep = {"model_id": "n0", "depth": 0}
    for k in range(1, 30):
        deep = {"model_id": f"n{k}", "metadata": {"downloads": k, "likes": 2 * k}, "depth": 30 - k, "children": [deep, {"model_id": f"leaf{k}"}]}
    repeat = {"model_id": "https://hub.example/r", "metadata": {"downloads": 5, "other": [1, {"a": 2}]}, "children": [
        {"model_id": "x", "metadata": {"likes": 1}, "depth": 4, "children": [{"model_id": "y"}, {"no": "id"}]},
        {"model_id": "y", "metadata": {"likes": 7}, "children": [{"model_id": "x", "metadata": {"likes": 9}}]}, {"model_id": "y"}]}
    docs = [("deep", json.dumps(deep)), ("rep", json.dumps(repeat)), ("bad", "{oops"), ("null", None), ("none", "{}"), ("one", '{"model_id": "z", "children": null}')]
    nodes, edges = flatten_trees(spark.createDataFrame(docs, "k string, text string"), "k", "text")
    got = {(r.tree, r.id): (r.downloads, r.likes, r.depth, r.level) for r in nodes.collect()}
    links = {(r.tree, r.src, r.dst) for r in edges.collect()}
    want, ties = {}, set()
    for tree, model in (("deep", deep), ("rep", repeat), ("one", {"model_id": "z"})):
        out, e = {}, set()
        walk(model, out, e)
        want |= {(tree, k): v for k, v in out.items()}
        ties |= {(tree, *x) for x in e}
    assert got == want and links == ties and len(want) > 60
    assert edges.count() == len(ties)


def number(text):
    import re
    t = str(text).strip().replace(",", "").lower()
    m = re.match(r"^(\d+)x(\d+)([bkmg])?$", t)
    if m:
        return float(m[1]) * float(m[2]) * (PM.MULTIPLIERS[m[3]] if m[3] else 1)
    m = re.match(PM.SUFFIXED, t)
    if m:
        return float(m[1]) * (PM.MULTIPLIERS[m[2]] if m[2] else 1)
    try:
        return float(t)
    except ValueError:
        return None


def value(v):
    if isinstance(v, dict):
        return next((x for x in map(value, v.values()) if x is not None), None)
    return number(v) if isinstance(v, (str, int, float)) and not isinstance(v, bool) else None


def search(doc):
    for k in PM.PARAM_KEYS:
        if k in doc and (x := value(doc[k])) is not None:
            return x
    safe = doc.get("safetensors")
    if isinstance(safe, dict):
        inner = safe.get("parameters") if isinstance(safe.get("parameters"), dict) else {}
        for v in [safe.get("total"), *[inner.get(t) for t in PM.SAFETENSOR_DTYPES]]:
            if v is not None and not isinstance(v, dict) and (x := number(v)) is not None:
                return x
    return next((x for v in doc.values() if isinstance(v, dict) and (x := search(v)) is not None), None)


def random_doc(rng, depth):
    keys = [*PM.PARAM_KEYS, "config", "zeta", "alpha", "safetensors", "total", "F32", "BF16", "type"]
    out = {}
    for k in rng.sample(keys, rng.randrange(1, 5)):
        out[k] = random_doc(rng, depth - 1) if depth and rng.random() < 0.55 else rng.choice(["n/a", "7B", "8x7b", 12, 1.5, "1,234", "", None, "none"])
    return out


def test_nested_parameter_counts_equal_recursion(spark):
    rng = random.Random(11)
    docs = [random_doc(rng, 5) for _ in range(400)]
    docs += [{"config": {"num_parameters": "7B"}}, {"parameters": {"type": "dense", "n": {"x": "3M"}}, "size": 5}, {}, {"a": {"b": {"c": {"d": {"model_size": 9}}}}}]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, m string")
    got = {r.id: r.params for r in PM.params_from_metadata(frame, "m").collect()}
    want = {i: search(d) for i, d in enumerate(docs)}
    assert {i: (got[i], want[i], docs[i]) for i in want if got[i] != want[i]} == {}
    assert got[400] == 7e9 and got[401] == 3e6 and sum(v is not None for v in want.values()) > 150
    for text in (None, "", "[]", "no json", "{'size': {'n': '2K',}}"):
        one = PM.params_from_metadata(spark.createDataFrame([(text,)], "m string"), "m").first().params
        assert one == (2000 if text and "2K" in text else None)


def test_wide_documents_are_searched_whole(spark):
    doc = {"meta": {f"k{i}": {"note": "x"} for i in range(300)}, "last": {"size": "4M"}}
    assert PM.params_from_metadata(spark.createDataFrame([(json.dumps(doc),)], "m string"), "m").select(F.max("params")).first()[0] == 4e6
