"""Every vector asks for its neighbours."""

from kinframe.plans import neighbors
from kinframe.plans.registry import ORACLE
from kinframe.sources.tables import Tables


def test_every_vector_has_its_neighbours(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    ids = {r.vec_id for r in t.embeddings.select("vec_id").collect()}
    got = {}
    for r in neighbors.q_top_k_neighbors(t).collect():
        got.setdefault(r.id, set()).add(r.rank)
    assert got == {i: {1, 2, 3, 4, 5} for i in ids}
    assert "% 50" not in ORACLE["top_k_neighbors"]
