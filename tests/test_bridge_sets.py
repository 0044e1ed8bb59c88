"""Bridges are ranked by counts; sets of communities are made for the report alone."""

from graphloom.operators import analyze
from tests.test_graph import graph


def test_bridges_collect_sets_of_the_report_alone(spark):
    kg = graph(spark, ["a", "b", "c", "d", "e"], [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("a", "e"), ("e", "e"), ("a", "gone")], communities={"a": 1, "b": 1, "c": 2, "d": 3})
    rows = analyze.community_bridges(kg, 2)
    assert [(r.id, r.community, r.total_edges, r.cross_edges, r.bridge_ratio, r.communities_touched) for r in rows.collect()] == [("d", 3, 1, 1, 1.0, [1, 3]), ("c", 2, 2, 2, 1.0, [1, 2])][::-1]
    assert "edge_seq" not in rows._jdf.queryExecution().optimizedPlan().toString()  # the edges were read before, for counts
