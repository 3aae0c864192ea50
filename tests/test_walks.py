from tracequarry.operators.structures import g2_dependency_walks
from tracequarry.operators.trace import g1_api_graph


def test_walks_follow_edges(spark, sf_dir):
    edges = {(r.source, r.target) for r in g1_api_graph(spark, sf_dir).collect()}
    rows = g2_dependency_walks(spark, sf_dir).collect()
    walks = [r.walk.split(">") for r in rows]
    assert rows and len({r.walk for r in rows}) == len(rows)
    for r, w in zip(rows, walks, strict=True):
        assert len(w) == r.tools <= 5 and 1 <= r.seed <= 20
        assert all(pair in edges for pair in zip(w, w[1:]))
