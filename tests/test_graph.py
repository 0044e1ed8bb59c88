"""Graphs made by hand, and brute force on random small multigraphs."""

import random

import pytest

from graphloom.graph import KG
from graphloom.operators import analyze as A
from graphloom.operators import build, community, iterate, search, traverse
from graphloom.operators.components import connected_components


def graph(spark, nodes, edges, communities=None, files=None):
    n = [(x, x, (files or {}).get(x, f"src/{x}.py"), "function", (communities or {}).get(x), i) for i, x in enumerate(nodes)]
    e = [(a, b, *(r or ["calls"]), "EXTRACTED", 1.0, 1.0, i) for i, (a, b, *r) in enumerate(edges)]
    return KG(
        spark.createDataFrame(n, "id string, label string, source_file string, node_type string, community int, node_seq long"),
        spark.createDataFrame(e, "source string, target string, relation string, confidence string, confidence_score double, weight double, edge_seq long"),
    )


LINES = (["north", "mid", "east", "south", "depot"], [("north", "mid"), ("mid", "south"), ("mid", "east"), ("east", "south"), ("south", "depot")])


def test_degrees_count_parallel_edges_and_loops_once(spark):
    kg = graph(spark, ["a", "b", "c"], [("a", "b"), ("a", "b", "uses"), ("a", "a")])
    assert {r.id: r.degree for r in kg.degrees().collect()} == {"a": 3, "b": 2, "c": 0}


def test_empty_graph(spark):
    kg = graph(spark, [], [])
    assert A.god_nodes(kg).count() == 0
    assert iterate.pagerank(kg).count() == 0
    assert community.cluster(kg).count() == 0
    assert A.graph_stats(kg).first().node_count == 0


def test_build_keeps_first_and_drops_dangling(spark):
    n = spark.createDataFrame([("a", "one", "x.py", "class", 0), ("a", "two", "x.py", "class", 1), ("b", "b", "tests/b_test.go", "class", 2)], "id string, label string, source_file string, node_type string, node_seq long")
    e = spark.createDataFrame([("a", "b", "calls", 0), ("a", "zz", "calls", 1)], "source string, target string, relation string, edge_seq long")
    kg = build.build(n, e)
    assert {r.id: r.label for r in kg.nodes.collect()} == {"a": "one", "b": "b"}
    assert kg.edges.count() == 1


def test_cohesion(spark):
    kg = graph(spark, "abc", [("a", "b"), ("b", "c"), ("a", "c")], dict.fromkeys("abc", 0))
    assert A.cohesion(kg).first().cohesion == 1.0
    kg = graph(spark, "abc", [("a", "b")], dict.fromkeys("abc", 0))
    assert A.cohesion(kg, rounded=True).first().cohesion == 0.33


def test_bridges(spark):
    kg = graph(spark, ["a", "b", "bridge", "c"], [("bridge", "a"), ("bridge", "b"), ("bridge", "c")], {"a": 0, "b": 0, "bridge": 0, "c": 1})
    rows = {r.id: r for r in A.community_bridges(kg).collect()}
    assert (rows["bridge"].cross_edges, rows["bridge"].total_edges) == (1, 3)
    assert rows["c"].bridge_ratio == 1.0 and rows["c"].communities_touched == [0, 1]


def test_traversal_and_paths(spark):
    kg = graph(spark, *LINES)
    for depth, n in ((0, 1), (1, 2), (2, 4), (3, 5)):
        assert traverse.bfs(kg, ["north"], depth).count() == n
    assert traverse.shortest_path(kg, "north", "depot") == ["north", "mid", "south", "depot"]
    assert traverse.shortest_path(kg, "north", "nowhere") is None
    assert [r.path for r in traverse.simple_paths(kg, "north", "depot", 3).collect()] == [["north", "mid", "south", "depot"], ["north", "mid", "east", "south", "depot"]]
    assert [len(r.path) for r in traverse.simple_paths(kg, "north", "depot", 3, strict=True).collect()] == [4]
    assert traverse.simple_paths(kg, "north", "north", 3).count() == 0
    assert traverse.dfs(kg, ["north"], 5)[0] == "north" and len(traverse.dfs(kg, ["north"], 5)) == 5


def test_low_confidence_edges_are_avoided(spark):
    kg = graph(spark, "abc", [("a", "b"), ("a", "c"), ("c", "b")])
    from pyspark.sql import functions as F

    kg = KG(kg.nodes, kg.edges.withColumn("confidence_score", F.when(F.col("edge_seq") == 0, 0.3).otherwise(1.0)))
    assert traverse.weighted_path(kg, "a", "b")[1] == ["a", "b"]
    assert traverse.weighted_path(kg, "a", "b", 0.5) == (2.0, ["a", "c", "b"])
    assert traverse.weighted_path(kg, "a", "a") == (0.0, ["a"])


def random_graph(seed, n=9, m=16):
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    return ids, [(r.choice(ids), r.choice(ids)) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_iterations_against_brute_force(spark, seed):
    ids, edges = random_graph(seed)
    kg = graph(spark, ids, edges)
    reach = {a: {a} for a in ids}
    for _ in ids:
        for a, b in edges:
            for x in ids:
                if a in reach[x]:
                    reach[x] |= reach[b]
    got = {r.id: r.component for r in iterate.strong_components(kg.edges).collect()}
    assert got == {x: min(y for y in ids if y in reach[x] and x in reach[y]) for x in got}
    near = {a: [] for a in ids}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(20):
        lost = sum(rank[x] for x in ids if not near[x])
        rank = {x: 0.15 / len(ids) + 0.85 * (sum(rank[y] / len(near[y]) for y in near[x]) + lost / len(ids)) for x in ids}
    got = {r.id: r.score for r in iterate.pagerank(kg, tolerance=0.0).collect()}
    assert all(abs(got[x] - rank[x]) < 1e-12 for x in ids)


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_cycles(spark):
    kg = graph(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    rows = iterate.cycles(kg).collect()
    assert [r.nodes for r in rows] == [["a", "b", "c"]] and abs(rows[0].severity - 1 / 3) < 1e-12
    assert iterate.cycles(graph(spark, "abc", [("a", "b"), ("b", "c")])).count() == 0


def test_communities(spark):
    a, b = ["a1", "a2", "a3"], ["b1", "b2", "b3"]
    tri = lambda x: [(x[0], x[1]), (x[1], x[2]), (x[0], x[2])]
    rows = community.cluster(graph(spark, [*a, *b, "z"], tri(a) + tri(b))).collect()
    got = {}
    for r in rows:
        got.setdefault(r.community, set()).add(r.node_id)
    assert list(map(got.get, range(3))) == [set(a), set(b), {"z"}]
    part = community.propagate(graph(spark, [*a, *b], tri(a) + tri(b)))
    assert part.count() == 6 and part.select("community").distinct().count() >= 2


def test_incremental_clustering_covers_all(spark):
    kg = graph(spark, [f"n{i}" for i in range(12)], [(f"n{i}", f"n{i + 1}") for i in range(11) if i != 5])
    before = community.cluster(kg)
    after = community.cluster_incremental(kg, before, ["src/n0.py"])
    assert after.count() == 12


def test_question_terms():
    assert search.question_terms("How does the ApproveItem handler work with user_id?") == ["approveitem", "approve", "item", "work", "user_id", "user"]
    assert search.question_terms("the handler") == ["handler"]
    assert search.normal_terms(["ApproveItem", "user_id"]) == ["approve", "approveitem", "item", "user", "user_id"]


def test_production_before_tests(spark):
    kg = graph(spark, ["prod", "twin"], [], files={"prod": "src/config.go", "twin": "src/config_test.go"})
    from pyspark.sql import functions as F

    kg = KG(kg.nodes.withColumn("label", F.lit("Config")), kg.edges)
    assert [r.id for r in search.score_nodes(kg, ["Config"], 2).collect()] == ["prod", "twin"]


def test_tools_and_rpc(spark):
    import json

    from graphloom.tools import Tools, handle

    t = Tools(graph(spark, *LINES))
    answer = json.loads(handle(t, json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "shortest_path", "arguments": {"source": "north", "target": "depot"}}})))
    assert json.loads(answer["result"]["content"][0]["text"]) == ["north", "mid", "south", "depot"]
    assert json.loads(handle(t, "{"))["error"]["code"] == -32700
    assert json.loads(handle(t, '{"id": 1, "method": "x"}'))["error"]["code"] == -32601
    assert len(Tools.NAMES) == 16
    found = t.query_graph("north")
    assert found["nodes"][0] == "north" and not found["truncated"]


@pytest.mark.parametrize("seed", [1, 2])
def test_delta_stepping_equals_dijkstra(spark, seed):
    rng = random.Random(seed)
    ids = [f"v{i}" for i in range(24)]
    rows = [(a, b, rng.choice([0.05, 0.3, 0.9, 1.0, 2.0]), i) for i, (a, b) in enumerate((rng.choice(ids[:22]), rng.choice(ids[:22])) for _ in range(50))]
    kg = KG(spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(rows, "source string, target string, weight double, edge_seq long").selectExpr("*", "1.0 as confidence_score"))
    near = {}
    for a, b, w, _ in rows:
        near.setdefault(a, []).append((b, 1 / w))
        near.setdefault(b, []).append((a, 1 / w))
    for target in (ids[7], ids[23]):
        want, got = traverse.local_dijkstra(near, ids[0], target), traverse.weighted_path(kg, ids[0], target)
        assert (want is None) == (got is None)
        if got:
            assert got[0] == pytest.approx(want[0]) and got[1][0] == ids[0] and got[1][-1] == target
            assert sum(min(c for x, c in near[a] if x == b) for a, b in zip(got[1], got[1][1:], strict=False)) == pytest.approx(got[0])
