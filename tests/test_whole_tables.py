"""Queries without SQL against brute force over whole tables."""

from test_graph import graph

from graphloom.operators import traverse
from graphloom.plans import registry
from graphloom.sources.tables import star


def test_resolve_imports_of_all_parts(spark, sf_dir):
    keys = [r.p_partkey for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").collect()]
    assert max(keys) >= 100
    want = set()
    for k in keys:
        j = (k * 7 + 3) % 100
        want |= {(f"web_m{k}_ts_{a}{k}", f"web_m{j}_ts_{b}{j}") for a in ("thing", "make") for b in ("thing", "make")}
    rows = registry.QUERIES["resolve_imports"](spark, sf_dir).collect()
    assert sorted((r.source, r.target) for r in rows) == sorted(want)


def test_shortest_path_beyond_64_steps(spark):
    ids = [f"n{i:02}" for i in range(67)]
    kg = graph(spark, ids, list(zip(ids, ids[1:], strict=False)))
    assert traverse.shortest_path(kg, ids[0], ids[-1]) == ids


def test_label_propagation_covers_the_whole_graph(spark, sf_dir):
    kg = star(spark, sf_dir)
    part = {r.node_id: r.community for r in registry.QUERIES["label_propagation"](spark, sf_dir).collect()}
    assert set(part) == {r.id for r in kg.nodes.select("id").collect()}
    near, members = {}, {}
    for r in kg.edges.select("source", "target").collect():
        near.setdefault(r.source, set()).add(r.target)
        near.setdefault(r.target, set()).add(r.source)
    for x, c in part.items():
        members.setdefault(c, set()).add(x)
    for m in members.values():  # each community is connected
        seen = todo = {min(m)}
        while todo:
            todo = {y for x in todo for y in near.get(x, ()) if y in m} - seen
            seen = seen | todo
        assert seen == m
