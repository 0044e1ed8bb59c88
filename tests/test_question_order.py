"""Questions of the first category that fill a report make the others needless; if they don't, all are asked."""

from graphloom.graph import KG
from graphloom.operators import analyze
from pyspark.sql import functions as F
from tests.test_graph import graph


def test_a_full_report_looks_no_further(spark):
    kg = graph(spark, ["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")], communities={"a": 1, "b": 2, "c": 3, "d": 4})
    edges = kg.edges.withColumn("confidence", F.when(F.col("edge_seq") < 3, "AMBIGUOUS").otherwise("INFERRED"))
    more = graph(spark, ["a", "b", "c", "d", "e", "f"], [("a", "b"), ("a", "c"), ("a", "d")], communities={"b": 2, "c": 3, "d": 4})
    full = analyze.suggest_questions(KG(kg.nodes, edges), top_n=2)
    assert "Join" not in full._jdf.queryExecution().sparkPlan().toString()
    every = analyze.suggest_questions(KG(kg.nodes, edges), top_n=1 << 30).collect()
    for n in (1, 2, 3, 4, 50):
        assert analyze.suggest_questions(KG(kg.nodes, edges), top_n=n).collect() == every[:n]
    rows = analyze.suggest_questions(more, top_n=5).collect()
    assert rows and {r["rank"] for r in rows} >= {2, 4}
    assert analyze.suggest_questions(more, top_n=0).collect() == []
