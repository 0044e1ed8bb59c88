import random

import duckdb
from pyspark.sql import functions as F

from graphloom.graph import KG
from graphloom.operators import iterate


def reach(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())
    out = {}
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[x] = seen
    return out


def strong(edges):
    r = reach(edges)
    return {x: min(y for y in r[x] if x in r[y]) for x in r}


def frame(spark, edges):
    return spark.createDataFrame(edges, "source string, target string")


def found(spark, edges):
    return {r.id: r.component for r in iterate.strong_components(frame(spark, edges)).collect()}


def counted(monkeypatch):
    calls, cut = [], iterate.cut
    monkeypatch.setattr(iterate, "cut", lambda df: calls.append(1) or cut(df))
    return calls


def test_long_ring_and_chain_take_few_rounds(spark, monkeypatch):
    calls = counted(monkeypatch)
    n = 120
    ring = [(f"r{i:03}", f"r{(i * 7 + 3) % n:03}") for i in range(n)]
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(n)] + [("c000", "r000"), (f"c{n:03}", "r010")]
    edges = ring + chain
    assert found(spark, edges) == strong(edges)
    assert len(calls) < 60


def test_long_cycles_take_few_rounds(spark, monkeypatch):
    calls = counted(monkeypatch)
    n = 120
    edges = [(f"a{i:03}", f"a{(i + 1) % n:03}") for i in range(n)] + [("x", "y"), ("y", "z"), ("z", "x"), ("y", "x"), ("z", "a000")]
    kg = KG(frame(spark, edges), frame(spark, edges).withColumn("relation", F.lit("calls")))
    got = [(list(r.nodes), r.severity) for r in iterate.cycles(kg).collect()]
    assert got == [(["x", "y"], 0.5), ([f"a{i:03}" for i in range(n)], 1 / n)]
    assert len(calls) < 90


def test_components_of_mixed_graphs(spark):
    rng = random.Random(5)
    edges = []
    for g in range(4):
        n = rng.randint(2, 9)
        edges += [(f"{g:02}-{rng.randrange(n)}", f"{g:02}-{rng.randrange(n)}") for _ in range(rng.randint(1, 2 * n))]
        if g % 3 == 0:  # a chain between two nodes, or from one to itself
            a, b = (f"{g:02}-{rng.randrange(n)}" for _ in range(2))
            way = [a, *(f"{g:02}+{i}" for i in range(rng.randint(1, 6))), b]
            edges += zip(way, way[1:])
    assert found(spark, edges) == strong(edges)


def test_whole_orbits_where_the_sql_stops_at_64_steps(spark, tmp_path):
    """The registered SQL follows 64 steps of an orbit; on longer ones it names no component."""
    from graphloom.plans import registry

    n = 1009
    spark.range(n).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    ends = [(f"part:{i}", f"part:{(i * 7 + 3) % n}") for i in range(n)]
    want = strong(ends)
    assert max(map(list(want.values()).count, set(want.values()))) > 64
    got = registry.QUERIES["connected_components"](spark, str(tmp_path)).collect()
    assert {r.node: r.component for r in got} == want
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert dict(con.execute(f"select node, component from ({registry.SQL['connected_components']})").fetchall()) != want
