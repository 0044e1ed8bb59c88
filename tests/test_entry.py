import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import registry
from graphloom.streaming import watch

FAST = [
    "god_nodes", "community_bridges", "cohesion", "graph_stats", "architecture_links", "graph_diff", "score_nodes", "make_id", "page_text", "plain_chunks", "debounced_events", "sensitive_files",
    "calls_by_word", "event_transitions",
]


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(columns).collect())
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    r = con.execute(registry.SQL[name])
    at = [d[0] for d in r.description]
    assert sorted(at) == columns
    assert got == sorted(repr([plain(x[at.index(c)]) for c in columns]) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(entry.queries())


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("x")
    seen = []
    watch.watch(spark, str(tmp_path / "in"), lambda df, i: seen.extend(r.path for r in df.select("path").collect()), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert len(seen) == 1 and seen[0].endswith("a.py")


def test_upsert(spark):
    n = spark.createDataFrame([("a", "f"), ("b", "g")], "id string, source_file string")
    e = spark.createDataFrame([("a", "b", "f")], "source string, target string, source_file string")
    fresh = spark.createDataFrame([("a2", "f")], "id string, source_file string")
    nodes, edges = watch.upsert(n, e, fresh, e.limit(0), spark.createDataFrame([("f",)], "source_file string"))
    assert sorted(r.id for r in nodes.collect()) == ["a2", "b"] and edges.count() == 0
