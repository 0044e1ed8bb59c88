"""Connected components by hooking and shortcutting on DataFrames.

Every round lowers parents over edges, lowers the parents' parents and halves
the paths, so the rounds grow with the logarithm of the component's size. All
reductions are ``min`` aggregates, which combine before the shuffle. Lookups of
a parent that more than a thousandth of all nodes have, or of a node that so
many edges meet, are answered by a broadcast of those at most ``HOT`` rows; so a
component that holds a third of all nodes does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.workspace import cut


HOT = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each key once; ``hot`` has ``HOT`` keys at the most."""
    few = F.broadcast(hot)
    by_broadcast = rows.join(F.broadcast(table.join(few, key, "left_semi")), key)
    return by_broadcast.unionByName(rows.join(few, key, "left_anti").join(table, key))


def often(rows: DataFrame, key: str) -> DataFrame:
    """The keys, fewer than ``HOT``, that more than one of ``HOT`` rows has."""
    return cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows.count() / HOT).select(key))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges(src, dst)`` of any ordered type → ``(node, component)``, component = least node.

    Nodes without an edge do not appear; self-loops give singletons; null ends are dropped.
    """
    ends = edges.select("src", "dst").where("src is not null and dst is not null")
    sym = cut(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    if sym.isEmpty():
        return sym.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    parents = cut(sym.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("parent")))
    state = F.bit_xor(F.xxhash64("node", "parent"))
    was, nodes = parents.agg(state, F.count(F.lit(1))).first()
    met = often(sym, "dst")
    any_met = not met.isEmpty()
    for _ in range(max_rounds):
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        hot = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > nodes / HOT).select("parent")
        seen = looked_up(parents, up, "parent", hot).select("node", "parent", "grand")
        grand = seen.select(F.col("node").alias("dst"), "grand")
        far = looked_up(sym, grand, "dst", met) if any_met else sym.join(grand, "dst")
        low = far.groupBy(F.col("src").alias("node")).agg(F.min("grand").alias("low"))
        offers = seen.join(low, "node").select(
            F.explode(
                F.array(
                    F.struct(F.col("node").alias("node"), F.least("parent", "grand", "low").alias("parent")),
                    F.struct(F.col("parent").alias("node"), F.least("grand", "low").alias("parent")),
                )
            ).alias("o")
        )
        parents = cut(offers.select("o.*").groupBy("node").agg(F.min("parent").alias("parent")))
        now = parents.agg(state).first()[0]
        if now == was:
            return parents.select("node", F.col("parent").alias("component"))
        was = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
