"""SimHash fingerprints, linked within a Hamming radius through BK-trees.

Equal fingerprints are one node. Two fingerprints within three bits agree on two
of five blocks at least, so each of the ten block pairs deals all fingerprints
into shards. In every shard a BK-tree (children keyed by their integer distance
to the parent) is built and searched following only edges within the radius.
The trees stay with their shards: their total size follows the input, so it has
no bound that a broadcast could rest on. A shard above ``HOT`` fingerprints is
dealt anew by thirteen blocks, of which ten agree: 286 masks leave at most
fifteen bits open, so that such a shard holds 2**15 fingerprints at the most,
whatever the data; no group is dropped or capped. A shard emits a chain through
each of its classes, not all pairs; components come from those edges.

Defined cases: null or blank text has fingerprint 0, linked like any other; an
empty table gives an empty result; repeated rows are repeated in the result;
a null doc_id never names a component unless all of its rows are null; extra
columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import bound
from graphloom.operators.components import connected_components, looked_up, often
from graphloom.workspace import written

RADIUS, HOT, SEED = 3, 256, 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(blocks: int, apart: int) -> list[int]:
    """Masks over all but ``apart`` of ``blocks`` even blocks of 64 bits, signed."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:], strict=False)]
    return [_signed(sum(block[i] for i in range(blocks) if i not in out)) for out in combinations(range(blocks), apart)]


def hashes(text: str | None, words: int = 3) -> list[int]:
    """XXH64 of each run of ``words`` words; of the whole sequence if it is shorter."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return []
    line = b" ".join(w)
    if len(w) < words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    size = np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[: len(w) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(start, end[words - 1 :].tolist(), strict=True)]


def fingerprint(h: list[int]) -> int:
    """Bits set in over half of ``h``, unsigned."""
    if not h:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    a = np.array(h, dtype="<u8")
    for i in range(0, len(a), 32768):
        ones += np.unpackbits(a[i : i + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)``, fp as a signed 64-bit integer."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([_signed(fingerprint(hashes(t, words))) for t in pdf["text"]], dtype=np.int64)})

    bound(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.values.append(x)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            d = (self.values[at] ^ x).bit_count()
            if (nxt := self.children[at].get(d)) is None:
                self.children[at][d] = len(self.values) - 1
                return
            at = nxt

    def within(self, x: int, radius: int) -> list[int]:
        """Positions of values within the radius."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            stack += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return found


def chains(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that chain up each class of ``values`` linked within the radius."""
    values = sorted({v & (2**64 - 1) for v in values})
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in tree.within(x, radius):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        tree.add(x)
    last: dict[int, int] = {}
    edges = []
    for i, x in enumerate(values):
        if (r := top(i)) in last:
            edges.append((_signed(last[r]), _signed(x)))
        last[r] = x
    return edges


def _keyed(fps: DataFrame, of: list[int]) -> DataFrame:
    """``(key, fp)`` for each mask; the key tells the masks apart."""
    keys = F.transform(F.array(*[F.lit(m) for m in of]), lambda m, i: F.xxhash64(i, F.col("fp").bitwiseAND(m)))
    return fps.select(F.explode(keys).alias("key"), "fp")


def _edges(shards: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            e = [x for v in pdf["fps"] for x in chains([int(a) for a in v], radius)]
            yield pd.DataFrame({"src": np.array([a for a, _ in e], dtype=np.int64), "dst": np.array([b for _, b in e], dtype=np.int64)})

    return shards.mapInPandas(run, "src long, dst long")


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``fps(fp)``, each once → edges ``(src, dst)`` that span every class within the radius."""
    if radius != 3:
        raise ValueError("the block masks are made for a radius of 3")
    keyed = _keyed(fps, masks(5, 3))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keyed.join(sizes, "key")
    small = sized.where(F.col("n") <= hot).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    large = sized.where(F.col("n") > hot).select("fp").distinct()
    fine = _keyed(large, masks(13, 3)).groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return written(_edges(small.unionByName(fine), radius).distinct(), "links")


def near_groups(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)``: the least doc_id that can be reached."""
    fps = written(fingerprints(docs, words), "fingerprints")
    once = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = connected_components(links(once.select("fp"), radius))
    named = once.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    names = named.select("fp", "group").join(least, "group").select("fp", "component_id")
    return looked_up(fps, names, "fp", often(fps, "fp")).select("doc_id", "fp", "component_id")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
