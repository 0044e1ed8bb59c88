"""Graphs as node-link JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import KG
from graphloom.operators.build import drop_dangling, merge_nodes

NODE = "id string, label string, source_file string, source_location string, node_type string, community int"
EDGE = "source string, target string, relation string, confidence string, confidence_score double, source_file string, source_location string, weight double"
DOCUMENT = f"nodes array<struct<{NODE}>>, links array<struct<{EDGE}>>"


def _struct(ddl: str) -> str:
    return ", ".join(":".join(c.split()) for c in ddl.split(","))


def parse(docs: DataFrame, column: str = "value") -> KG:
    """Documents in a column; missing scores and weights are 1, repeated nodes and dangling edges go."""
    d = docs.select(F.from_json(column, f"nodes array<struct<{_struct(NODE)}>>, links array<struct<{_struct(EDGE)}>>").alias("d"))
    nodes = d.select(F.posexplode(F.coalesce("d.nodes", F.array())).alias("node_seq", "n")).select("n.*", F.col("node_seq").cast("long").alias("node_seq"))
    edges = d.select(F.posexplode(F.coalesce("d.links", F.array())).alias("edge_seq", "e")).select("e.*", F.col("edge_seq").cast("long").alias("edge_seq"))
    edges = edges.withColumns({"confidence_score": F.coalesce("confidence_score", F.lit(1.0)), "weight": F.coalesce("weight", F.lit(1.0))})
    nodes = merge_nodes(nodes)
    return KG(nodes, drop_dangling(edges, nodes))


def read(spark: SparkSession, path: str) -> KG:
    return parse(spark.read.text(path, wholetext=True))


def lines(kg: KG) -> DataFrame:
    """``(part, ord, line)``: a JSON line for each node and edge."""
    n = kg.nodes.select(F.lit("nodes").alias("part"), F.col("id").alias("ord"), F.to_json(F.struct(*[c for c in kg.nodes.columns if c != "node_seq"])).alias("line"))
    e = kg.edges.select(F.lit("links").alias("part"), F.lpad(F.col("edge_seq").cast("string"), 20, "0").alias("ord"), F.to_json(F.struct(*[c for c in kg.edges.columns if c != "edge_seq"])).alias("line"))
    return n.unionByName(e)


def write(kg: KG, path: str) -> None:
    """One document, streamed to a local file without holding the graph."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"directed": false, "multigraph": true, "graph": ')
        hyper = [r.asDict() for r in kg.hyperedges.toLocalIterator()] if kg.hyperedges is not None else []
        f.write(json.dumps({"hyperedges": hyper} if hyper else {}))
        for part in ("nodes", "links"):
            f.write(f', "{part}": [')
            for i, r in enumerate(lines(kg).where(F.col("part") == part).orderBy("ord").toLocalIterator()):
                f.write((", " if i else "") + r["line"])
            f.write("]")
        f.write("}\n")
