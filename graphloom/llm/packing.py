"""Best-fit packing under conflicts.

Documents are dealt by a hash of their id into shards of bounded length; each
shard is packed on its own. Bins are kept by residual: for every source a bitmap
over residuals says where some open bin lacks that source, so the successor
search jumps straight to the next residual that can fit, and goes on from there
until the tightest bin whose source and duplicate-cluster bitmaps are both free
of the document's bits is found. Documents longer than the capacity are cut into
full pieces, which fill bins of their own, and a rest; nothing is dropped.

Defined cases: size 0 still takes a place in a bin; null source and null cluster
conflict with nothing; repeated rows get copy numbers and, having one cluster,
never share a bin; an empty table gives an empty result. Order within a shard is
size descending, then doc_id, so reruns agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.mixing import size_of

CAPACITY, SHARD_DOCS = 2048, 4096
OUT = "doc_id long, copy int, piece int, size long, bin_id string, bin_offset long, bin_used long, source string, cluster long"


def pack(items: list[tuple[int, int | None, int | None]], capacity: int) -> list[int]:
    """Bin number for each ``(size, source, cluster)``, taken in the given order."""
    residual: list[int] = []
    sources: list[int] = []
    clusters: list[int] = []
    at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # residual → its bins, oldest first
    n_src = 1 + max((s for _, s, _ in items if s is not None), default=-1)
    lacking = [[0] * (capacity + 1) for _ in range(n_src)]  # source → residual → bins without it
    free = [0] * n_src  # source → bitmap over residuals
    some = 0  # bitmap over residuals that have a bin

    def add(b: int, step: int) -> None:
        nonlocal some
        r, mask = residual[b], sources[b]
        if step > 0:
            at[r][b] = None
            some |= 1 << r
        else:
            del at[r][b]
            if not at[r]:
                some &= ~(1 << r)
        for s in range(n_src):
            if not mask >> s & 1:
                lacking[s][r] += step
                if lacking[s][r]:
                    free[s] |= 1 << r
                else:
                    free[s] &= ~(1 << r)

    out = []
    for size, source, cluster in items:
        s_bit = 0 if source is None else 1 << source
        c_bit = 0 if cluster is None else 1 << cluster
        open_at = (some if source is None else free[source]) >> size
        r, found = size, -1
        while open_at and found < 0:
            skip = (open_at & -open_at).bit_length() - 1
            r += skip
            found = next((b for b in at[r] if not sources[b] & s_bit and not clusters[b] & c_bit), -1)
            open_at >>= skip + 1
            r += 1
        if found < 0:
            found = len(residual)
            residual.append(capacity)
            sources.append(0)
            clusters.append(0)
            add(found, 1)
        add(found, -1)
        residual[found] -= size
        sources[found] |= s_bit
        clusters[found] |= c_bit
        add(found, 1)
        out.append(found)
    return out


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "doc_id", "source", "cluster"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    pdf["copy"] = pdf.groupby("doc_id", dropna=False).cumcount()
    shard = int(pdf["shard"].iloc[0])
    seen: dict = {}
    source_no = [None if pd.isna(s) else seen.setdefault(s, len(seen)) for s in pdf["source"]]
    twice = pdf["cluster"].notna() & pdf["cluster"].duplicated(keep=False)  # others can't conflict
    known: dict = {}
    cluster_no = [known.setdefault(c, len(known)) if t else None for c, t in zip(pdf["cluster"], twice, strict=True)]
    rows, full = [], 0
    for i, size in enumerate(pdf["size"]):
        for p in range(size // capacity):
            rows.append((i, p, capacity, f"{shard}:f{full}"))
            full += 1
    rest = []
    for i, size in enumerate(pdf["size"]):
        if size < capacity or size % capacity:
            rest.append((i, size // capacity, size % capacity))
    rest.sort(key=lambda x: -x[2])  # stable: ties stay in order
    bins = pack([(size, source_no[i], cluster_no[i]) for i, _, size in rest], capacity)
    rows += [(i, p, size, f"{shard}:{b}") for (i, p, size), b in zip(rest, bins, strict=True)]
    out = pdf.loc[[r[0] for r in rows], ["doc_id", "copy", "source", "cluster"]].reset_index(drop=True)
    out["piece"] = [r[1] for r in rows]
    out["size"] = [r[2] for r in rows]
    out["bin_id"] = [r[3] for r in rows]
    out["bin_offset"] = out.groupby("bin_id")["size"].cumsum() - out["size"]
    out["bin_used"] = out.groupby("bin_id")["size"].transform("sum")
    return out[["doc_id", "copy", "piece", "size", "bin_id", "bin_offset", "bin_used", "source", "cluster"]]


def cluster_of(text: str = "text"):
    """Copies that differ in letter case or white space only are one duplicate cluster."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(F.col(text)), r"\s+", " ")))


def best_fit(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, cluster: Column | None = None) -> DataFrame:
    """``docs(doc_id, source, text)`` → a row for each piece with its bin. ``cluster``: whole numbers of duplicate clusters."""
    n = docs.count()
    shards = max(1, -(-n // shard_docs))
    cluster = F.when(F.col("text").isNotNull(), cluster_of()) if cluster is None else cluster.cast("long")
    light = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), cluster.alias("cluster"), size_of().alias("size"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).alias("shard")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(pdf, capacity)

    return light.groupBy("shard").applyInPandas(run, OUT)


def op7(spark, sf_dir: str) -> DataFrame:
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
