from graphloom.graph import KG
from graphloom.operators import analyze


def test_edges_of_one_number_have_an_order(spark):
    names = "abcdef"
    nodes = spark.createDataFrame([(x, x.upper(), f"src/{x}.py", "class", i) for i, x in enumerate(names)], "id string, label string, source_file string, node_type string, community int")
    rows = [("a", x, "calls", "AMBIGUOUS", 7) for x in names[1:]]
    for edges in (rows, rows[::-1]):
        kg = KG(nodes, spark.createDataFrame(edges, "source string, target string, relation string, confidence string, edge_seq long").coalesce(1))
        assert [(r.source, r.target) for r in analyze.surprising_connections(kg, 2).collect()] == [("a", "b"), ("a", "c")]
