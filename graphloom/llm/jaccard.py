"""Groups of documents linked by an exact Jaccard similarity of their word shingles.

Candidates come from SimHash fingerprints of the shingles, linked through
BK-trees within three bits, which finds most near copies. No radius of a 64-bit
SimHash holds a Jaccard similarity: at 0.8 the distance is about ten bits on
average with a spread of three, far beyond block masks. So further candidates
come from prefixes: in any one order of all shingles, two sets with the
similarity share a shingle among the first ``n - ceil(0.8 n) + 1`` of each.
The order is by hash, shingles that are common in a sample last, so that a
common passage makes no large shard; a wrong guess costs time, never a pair.

In a shard, pairs are dropped by size and by bitmaps that hold the parity of a
set's shingles by hash: bitmaps differ in at most as many bits as the sets have
shingles that only one has, so this drops no similar pair either. What is left
is chained into candidate components; a shard that over ``MOST`` sets of a sample
share is chained whole, as more candidates only cost time. A component of at most ``NODES`` sets
with ``LOAD`` shingles is split by exact similarities in one task, a document
travels there once. A larger one is dealt into blocks of that size: each block
is split together with a few pivots, which settles nearly all of a large group
of near copies; the sets outside of its largest class then meet those inside and
each other, block by block, so that no pair of unlike classes is left out and no
task holds more than two blocks.

Defined cases: equal sets are one node; texts without a word are one group;
shorter texts are one shingle; repeated rows count once, and rows with one
doc_id but unlike texts are told apart; an empty table gives an empty result;
extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.batches import bound
from graphloom.llm.simhash import SEED, _signed, fingerprint, hashes, links
from graphloom.operators.components import connected_components, looked_up, often
from graphloom.workspace import Scratch, written

WORDS, PART, WHOLE = 5, 4, 5  # similar: at least PART / WHOLE
SAMPLE, COMMON, MOST_COMMON = 32, 8, 200_000  # for the order only
MOST, NODES, LOAD, PIVOTS = 32, 512, 1 << 19, 8  # sampled sets a shard, sets and shingles a block, pivots a component


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes in order."""
    return np.unique(np.array(hashes(text, words), dtype=np.uint64))


def text_id(text: str = "text") -> Column:
    """A digest that tells texts apart; null for a null text."""
    return F.unhex(F.sha2(F.col(text), 256))


def _of_fingerprints(once: DataFrame) -> DataFrame:
    """``once(node, fp)`` → edges between nodes that have one fingerprint or two within the radius."""
    heads = once.groupBy("fp").agg(F.min("node").alias("head"))
    same = once.join(heads, "fp").where("node <> head").select(F.col("head").alias("src"), F.col("node").alias("dst"))
    near = links(heads.select("fp"))
    a, b = heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), heads.select(F.col("fp").alias("dst"), F.col("head").alias("b"))
    return same.unionByName(near.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))


def node_of(s: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(s.tobytes(), SEED))


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which two similar sets share one. ``common``: rising hashes."""
    n = len(s)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.argsort(common[at] == s, kind="stable")]
    return s[: n - -(-PART * n // WHOLE) + 1]


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles by their low bits; at least as many bits as shingles."""
    b = 64
    while b < len(s):
        b *= 2
    return np.packbits(np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1, bitorder="little").tobytes()


def may_match(n: int, x: int, b: int, m: int, y: int, c: int) -> bool:
    """False only for sets that are not similar: sizes, bitmaps as integers and their bits."""
    if WHOLE * min(n, m) < PART * max(n, m):
        return False
    while b > c:
        b //= 2
        x = (x >> b) ^ (x & ((1 << b) - 1))
    while c > b:
        c //= 2
        y = (y >> c) ^ (y & ((1 << c) - 1))
    return (WHOLE + PART) * (x ^ y).bit_count() <= (WHOLE - PART) * (n + m)


def similar(a: frozenset, b: frozenset) -> bool:
    if WHOLE * min(len(a), len(b)) < PART * max(len(a), len(b)):
        return False
    both = len(a & b)
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def classes(items: list, linked) -> list[list[int]]:
    """Positions of ``items`` by connected class; each is compared with those not yet reached."""
    left, out = list(range(len(items))), []
    while left:
        found = [left.pop(0)]
        for at in found:  # grows
            if not left:
                break
            hit = [linked(items[at], items[i]) for i in left]
            found += [i for i, h in zip(left, hit, strict=True) if h]
            left = [i for i, h in zip(left, hit, strict=True) if not h]
        out.append(found)
    return out


def _common(docs: DataFrame) -> np.ndarray:
    def run(batches):
        for pdf in batches:
            got = [shingles(t) for t in pdf["text"]]
            yield pd.DataFrame({"h": np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)})

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("common")), F.lit(SAMPLE)) == 0).select("text")
    often = some.mapInPandas(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON)
    return np.sort(np.array([r["h"] for r in often.collect()], dtype=np.int64).view(np.uint64))


def _sketches(docs: DataFrame) -> DataFrame:
    common = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                h = hashes(t, WORDS)
                s = np.unique(np.array(h, dtype=np.uint64))
                rows.append((node_of(s), len(s), prefix(s, common.value).view(np.int64), bitmap(s), _signed(fingerprint(h))))
            out = pd.DataFrame(rows, columns=["node", "n", "keys", "bits", "fp"])
            yield pd.concat([pdf[["doc_id", "unnamed", "text_id"]].reset_index(drop=True), out], axis=1)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), text_id().alias("text_id"), "text")
    told = rows.mapInPandas(run, "doc_id long, unnamed boolean, text_id binary, node long, n int, keys array<long>, bits binary, fp long")
    return told.withColumn("doc_id", F.when(~F.col("unnamed"), F.col("doc_id"))).drop("unnamed")


def _chains(shards: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            e = []
            for members in pdf["members"]:
                items = [(m["n"], int.from_bytes(m["bits"], "little"), 8 * len(m["bits"])) for m in members]
                for c in classes(items, lambda a, b: may_match(*a, *b)):
                    e += [(members[a]["node"], members[b]["node"]) for a, b in zip(c, c[1:], strict=False)]
            yield pd.DataFrame({"src": np.array([a for a, _ in e], dtype=np.int64), "dst": np.array([b for _, b in e], dtype=np.int64)})

    return shards.mapInPandas(run, "src long, dst long").distinct()


def _sets(pdf: pd.DataFrame) -> dict[int, frozenset]:
    """Sets by node; rows of another text with the same doc_id are left out."""
    sets = {}
    for node, t in zip(pdf["node"].tolist(), pdf["text"], strict=True):
        if node not in sets and node_of(s := shingles(t)) == node:
            sets[node] = frozenset(s.tolist())
    return sets


def _split(pdf: pd.DataFrame) -> pd.DataFrame:
    sets = _sets(pdf)
    nodes = sorted(sets)
    got = [(nodes[i], nodes[min(c)]) for c in classes([sets[x] for x in nodes], similar) for i in c]
    return pd.DataFrame(got, columns=["node", "group"])


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges from a block's nodes and its component's pivots to the first of their classes, pivots first; ``own``: of the block."""
    own = set(pdf.loc[~pdf["pivot"], "node"].tolist())
    rows = pdf.sort_values(["pivot", "node"], ascending=[False, True]).drop_duplicates("node")
    nodes, sets = rows["node"].tolist(), [frozenset(s.tolist()) for s in rows["set"]]
    got = [(nodes[i], nodes[c[0]], nodes[i] in own) for c in classes(sets, similar) for i in c]
    return pd.DataFrame(got, columns=["src", "dst", "own"])


def _between(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges between classes with similar sets; those of the largest class are one class and not compared."""
    root = {c: c for c in pdf["class"].tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    rows = [(c, frozenset(s.tolist()), inner) for c, s, inner in zip(pdf["class"].tolist(), pdf["set"], pdf["inner"], strict=True)]
    outer, others = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    edges = []
    for i, (c, s, _) in enumerate(outer):
        for d, t, _ in others or outer[:i]:
            if top(c) != top(d) and similar(s, t):
                root[top(c)] = top(d)
                edges.append((c, d))
    return pd.DataFrame(edges, columns=["src", "dst"], dtype="int64")


def _blocks(nodes: str, load: str) -> Column:
    return F.ceil(F.greatest(F.col(nodes) / NODES, F.col(load) / LOAD)).cast("int")


def _dealt(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit("block")), F.col(blocks)).cast("int")


def _numbers(blocks: str) -> Column:
    return F.sequence(F.lit(0), F.col(blocks) - 1)


def _split_large(texts: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, group)`` for ``texts(component, node, text)``; ``sizes(component, blocks)``."""

    def run(batches):
        for pdf in batches:
            sets = [shingles(t) for t in pdf["text"]]
            own = [node_of(s) == n for s, n in zip(sets, pdf["node"].tolist(), strict=True)]
            pdf["set"] = [s.view(np.int64) for s in sets]
            yield pdf.loc[own, ["component", "node", "set"]]

    sets = scratch.written(texts.mapInPandas(run, "component long, node long, set array<long>"), "sets")
    order = Window.partitionBy("component").orderBy(F.xxhash64("node"), "node")
    chosen = sets.select("component", "node").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= PIVOTS).select("node")
    pivots = sets.join(chosen, "node").join(sizes, "component").select("component", "node", "set", F.explode(_numbers("blocks")).alias("block"), F.lit(True).alias("pivot"))
    mine = sets.join(sizes, "component").select("component", "node", "set", _dealt("blocks").alias("block"), F.lit(False).alias("pivot"))
    first = scratch.written(mine.unionByName(pivots).groupBy("component", "block").applyInPandas(_block, "src long, dst long, own boolean"), "blocks")
    own = first.where("own").select(F.col("src").alias("node"), F.col("dst").alias("class"))
    known = scratch.written(sets.dropDuplicates(["node"]).join(own, "node"), "classes")

    of = known.groupBy("component", "class").agg(F.count(F.lit(1)).alias("k"), F.sum(F.size("set")).alias("load"))
    largest = F.max_by("class", F.struct("k", "class")).alias("largest")
    total = of.groupBy("component").agg(largest, F.max("k").alias("in_k"), F.max_by("load", F.struct("k", "class")).alias("in_load"), F.sum("k").alias("k"), F.sum("load").alias("load"))
    total = total.where(F.col("k") > F.col("in_k")).withColumns({"out_k": F.col("k") - F.col("in_k"), "out_load": F.col("load") - F.col("in_load")})
    dealt = known.join(total.select("component", "largest", _blocks("in_k", "in_load").alias("ins"), _blocks("out_k", "out_load").alias("outs")), "component").withColumn("inner", F.col("class") == F.col("largest"))
    of_inner = F.transform(_numbers("outs"), lambda a: F.struct(a.alias("a"), _dealt("ins").alias("b"), F.lit(True).alias("cross")))
    across = F.transform(_numbers("ins"), lambda b: F.struct(_dealt("outs").alias("a"), b.alias("b"), F.lit(True).alias("cross")))
    among = F.transform(_numbers("outs"), lambda b: F.struct(F.least(b, _dealt("outs")).alias("a"), F.greatest(b, _dealt("outs")).alias("b"), F.lit(False).alias("cross")))
    meets = dealt.select("component", "class", "inner", "set", F.explode(F.when(F.col("inner"), of_inner).otherwise(F.concat(across, among))).alias("at"))
    found = meets.groupBy("component", "at").applyInPandas(_between, "src long, dst long").distinct()
    return connected_components(scratch.written(first.select("src", "dst").unionByName(found).distinct(), "between")).select("node", F.col("component").alias("group"))


def _candidates(once: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges between nodes that share a shingle of their prefixes and may match."""
    keys = once.select("node", F.explode("keys").alias("key"))
    seen = once.where(F.pmod(F.xxhash64("node", F.lit("hot")), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("key"))
    hot = scratch.written(seen.groupBy("key").count().where(F.col("count") > MOST).orderBy(F.desc("count"), "key").limit(MOST_COMMON).select("key"), "hot")
    cold = keys if (none := hot.isEmpty()) else keys.join(F.broadcast(hot), "key", "left_anti")
    shards = cold.groupBy("key").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)
    shards = shards.groupBy(F.array_sort("nodes").alias("nodes")).agg(F.min("key").alias("key"))  # pairs share many keys
    full = shards.select("key", F.explode("nodes").alias("node")).join(once.select("node", "n", "bits").hint("merge"), "node")
    edges = _chains(full.groupBy("key").agg(F.collect_list(F.struct("node", "n", "bits")).alias("members")).select("members"))
    if none:
        return edges
    warm = keys.join(F.broadcast(hot), "key")
    heads = F.broadcast(warm.groupBy("key").agg(F.min("node").alias("head")))  # as many as ``hot``
    return edges.unionByName(warm.join(heads, "key").where("node <> head").select(F.col("head").alias("src"), F.col("node").alias("dst")))


def grouped_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_id, least)`` of each row: ``least`` is the struct of both of its group's first row, nulls first."""
    bound(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    told = scratch.written(_sketches(docs), "sketches")
    once = scratch.written(told.groupBy("node").agg(F.min(F.struct("doc_id", "text_id")).alias("first"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("bits").alias("bits"), F.min("fp").alias("fp")), "once")
    edges = scratch.written(_candidates(once, scratch).unionByName(_of_fingerprints(once.select("node", "fp"))).distinct(), "candidates")
    parts = once.select("node", "first", "n").join(connected_components(edges), "node")
    loads = parts.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("load"))
    of = parts.join(loads.select("component", _blocks("nodes", "load").alias("blocks")), "component").select("component", "node", "blocks", "first")
    # texts of the candidates alone are written; merged at every size, as their table grows with the documents
    texts = docs.select("doc_id", "text").join(of.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & text_id().eqNullSafe(F.col("first.text_id"))).select("component", "node", "blocks", "text")
    texts = scratch.written(texts, "texts", "zstd")
    split = texts.where("blocks <= 1").groupBy("component").applyInPandas(_split, "node long, group long")
    large = texts.where("blocks > 1")
    if not large.isEmpty():
        split = split.unionByName(_split_large(large.select("component", "node", "text"), large.select("component", "blocks").distinct(), scratch))
    named = once.select("node", "first").join(scratch.written(split, "split"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = named.groupBy("group").agg(F.min("first").alias("least"))
    names = named.join(least, "group").select("node", "least")
    rows = written(looked_up(told.select("doc_id", "text_id", "node"), names, "node", often(told, "node")).select("doc_id", "text_id", "least"), "groups")
    scratch.clear()
    return rows


def similar_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)``: the least doc_id that similar pairs lead to; a null one is below any other."""
    return grouped_rows(docs).select("doc_id", F.col("least.doc_id").alias("component_id"))
