"""Parsing of stored pages: sections, subjects; listings with their flags."""

from pyspark.sql import functions as F

from kinframe.plans import text as X

TREE = ('<div class="x text-smd"><div class="flex"><p>Base model</p> <a class="q" href="/b/base"> b/base </a></div>'
        '<div class="mt-2 flex"><div class="font-semibold">Quantized <span>from</span></div><a href="/p/one">p/one</a><a href="/x"><b>p/two</b> </a></div>'
        '<div class="flex"><div class="font-semibold">Merge</div><a href="/m?other=base_model:merge:q/three">here</a><a href="/self">me/self</a><a href="/n">noslash</a></div>'
        '<div class="flex"><div class="font-semibold">Datasets</div><a href="/d/e">d/e</a></div><div class="flex"><a href="/n/label">n/label</a></div></div>')


def test_sections_give_the_relationship(spark):
    pages = [("me/self", f"<nav><a href='/a/b'>a/b</a></nav>{TREE}"), ("no/tree", '<p>Base model</p><div class="flex"><div class="font-semibold">Merge</div><a href="/a/b">a/b</a></div>'),
             ("no/base", TREE.replace("Base model", "Other")), ("none", None), ("no/link", TREE.replace('<a class="q" href="/b/base"> b/base </a>', ""))]
    got = X.lineage_rows(spark.createDataFrame(pages, "model_id string, html string")).collect()
    own = {(r.parent_model_id, r.parent_relationship, r.base_model_id) for r in got if r.model_id == "me/self"}
    assert own == {("p/one", "quantized", "b/base"), ("p/two", "quantized", "b/base"), ("q/three", "merged", "b/base")}
    assert {r.model_id for r in got} == {"me/self", "no/link"} and {r.base_model_id for r in got if r.model_id == "no/link"} == {None}


def test_subjects_of_a_landing_page(spark):
    html = [(1, '<META content="a, b,a" name="keywords"><p class="x">no</p><SPAN class="art-Subject y"> c &amp; <i>d</i></SPAN><div class="keywords"> </div><p class="classification">a</p>'),
            (2, "<p>nothing</p>"), (3, None)]
    got = spark.createDataFrame(html, "k int, html string").select("k", X.subjects_of(F.col("html")).alias("s")).collect()
    assert [r.s for r in got] == [["a", " b", "c & d"], [], None]
