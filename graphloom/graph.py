"""The property graph as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KG:
    """``nodes(id, label, source_file, node_type, community, ...)``, ``edges(source, target, relation, ..., edge_seq)``.

    Edges are undirected for analyses, keep their direction for exports and
    cycles, and may run parallel. A self-loop counts once in ``degrees`` and
    twice in ``sym``.
    """

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None

    def sym(self, *columns: str) -> DataFrame:
        """``(src, dst)`` in both directions, with further columns of the edges."""
        ends = F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")), F.struct(F.col("target").alias("src"), F.col("source").alias("dst")))
        return self.edges.select(F.explode(ends).alias("e"), *columns).select("e.src", "e.dst", *columns)

    def degrees(self) -> DataFrame:
        """``(id, degree)`` of every node; ends are counted before the shuffle, so hubs do no harm."""
        ends = F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(F.array("source", "target"))
        counted = self.edges.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def with_degree(self) -> DataFrame:
        return self.nodes.join(self.degrees(), "id")

    def membership(self) -> DataFrame:
        """``(node_id, community)`` of the nodes that have one."""
        return self.nodes.where(F.col("community").isNotNull()).select(F.col("id").alias("node_id"), "community")

    def with_ends(self, *columns: str) -> DataFrame:
        """Edges with the named node columns of both ends, prefixed ``s_`` and ``t_``."""
        left = self.nodes.select(F.col("id").alias("source"), *[F.col(c).alias(f"s_{c}") for c in columns])
        right = self.nodes.select(F.col("id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in columns])
        return self.edges.join(left, "source").join(right, "target")

    def clustered(self, membership: DataFrame) -> KG:
        """With the communities of ``membership(node_id, community)``."""
        named = membership.select(F.col("node_id").alias("id"), "community")
        return KG(self.nodes.drop("community").join(named, "id", "left"), self.edges, self.hyperedges)


def is_file_node() -> Column:
    """The label is the file's whole name."""
    return (F.col("label") != "") & (F.col("label") == F.element_at(F.split("source_file", "/"), -1))


def is_method_stub() -> Column:
    """``.x()``, or ``x()`` with one edge at the most."""
    return (F.col("label").startswith(".") & F.col("label").endswith("()")) | (F.col("label").endswith("()") & (F.col("degree") <= 1))
