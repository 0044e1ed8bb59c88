"""Context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it is one less than a
multiple of the block size; each chunk gives one letter of the signature. Block
sizes are three times a power of two; a fingerprint has the signatures for its
size and the next. Fingerprints of the same or neighbouring sizes are compared
by edit distance, if they share a run of letters at all.

Defined cases: null text is empty, and an empty text has empty signatures;
equal texts have equal fingerprints and likeness 1; ties of doc_id are ordered
by text; a lone document is its own neighbour; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import bound

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LEAST_BLOCK, LENGTH, MOST, COMMON = 7, 3, 64, 128, 4
CUTS, MOST_BUCKETS, BUCKET_DOCS = 256, 65_536, 128


def _rolling(a: np.ndarray) -> np.ndarray:
    """For each byte, a hash of the seven bytes up to it."""
    x = np.zeros(len(a) + WINDOW - 1, dtype=np.uint32)
    x[WINDOW - 1 :] = a
    n = len(a)
    plain, mixed = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)
    for j in range(WINDOW):
        part = x[WINDOW - 1 - j : WINDOW - 1 - j + n]
        plain += part * np.uint32(WINDOW + 1 - j)
        mixed ^= part << np.uint32(5 * j)
    return plain + mixed


def fingerprint(data: bytes) -> str:
    if not data:
        return f"{LEAST_BLOCK}::"
    after = _rolling(np.frombuffer(data, dtype=np.uint8)) + np.uint32(1)
    places = np.flatnonzero(after % LEAST_BLOCK == 0)
    values = after[places]

    def ends(k: int) -> np.ndarray:
        return places[values & np.uint32((1 << k) - 1) == 0]

    k = 0
    while (LEAST_BLOCK << k) * LENGTH < len(data):
        k += 1
    while k < 30 and len(ends(k)) > MOST:
        k += 1
    while k > 0 and len(ends(k)) < LENGTH // 2 and len(ends(k - 1)) <= MOST:
        k -= 1

    view, crc = memoryview(data), zlib.crc32

    def signature(k: int) -> str:
        cuts = [0, *(ends(k) + 1).tolist()]
        if cuts[-1] != len(data):
            cuts.append(len(data))
        return "".join([LETTERS[crc(view[a:b]) & 63] for a, b in zip(cuts, cuts[1:], strict=False)])

    return f"{LEAST_BLOCK << k}:{signature(k)}:{signature(k + 1)}"


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions, by Myers' bit vectors."""
    if not a or not b:
        return len(a) + len(b)
    m = len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for c in b:
        eq = at.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (~(xh | up) & full), up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        up, down = mh | (~(xv | ph) & full), ph & xv
    return score


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = min(COMMON, len(a), len(b))
    if n == 0 or {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 0 for block sizes that are neither equal nor neighbours."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        return max(_alike(x1, y1), _alike(x2, y2))
    if bx == 2 * by:
        return _alike(x1, y2)
    return _alike(x2, y1) if by == 2 * bx else 0.0


def edited(text: str, follower: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bucketed(docs: DataFrame) -> DataFrame:
    """With ``bucket``, which rises with doc_id: quantile cuts, and even parts between two cuts."""
    found = docs.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", [i / CUTS for i in range(CUTS + 1)], 10_000).alias("q")).first()
    cuts = sorted(set(found["q"] or [0]))
    parts = max(1, min(MOST_BUCKETS // CUTS, found["n"] // (CUTS * BUCKET_DOCS)))
    lows = F.array(*[F.lit(c).cast("long") for c in [*cuts, cuts[-1] + 1]])
    i = F.greatest(F.lit(1), F.size(F.filter(lows, lambda q: q <= F.col("doc_id"))))
    low, high = F.element_at(lows, F.col("i")), F.element_at(lows, F.least(F.col("i") + 1, F.lit(len(cuts) + 1)))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("doc_id") - low) / F.greatest(F.lit(1), high - low)))
    bucket = F.col("i") * parts + F.least(F.floor(share * parts), F.lit(parts - 1))
    return docs.withColumn("i", i).withColumn("bucket", F.coalesce(bucket, F.lit(-1)).cast("long")).drop("i")


def with_followers(docs: DataFrame) -> DataFrame:
    """Rows by bucket in order, each bucket ended by the first row of the next one (``head``)."""
    rows = _bucketed(docs.select(F.col("doc_id").cast("long"), "text"))
    firsts = sorted(rows.groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).collect())  # MOST_BUCKETS + CUTS rows at the most
    spark = docs.sparkSession
    heads = spark.createDataFrame([(b, int(x["bucket"]), x["doc_id"]) for b, x in zip([firsts[-1][0], *[y[0] for y in firsts]], firsts, strict=False)], "before long, bucket long, doc_id long") if firsts else None
    rows = rows.withColumn("head", F.lit(False))
    if heads is None:
        return rows
    first = rows.alias("r").join(F.broadcast(heads).alias("h"), F.expr("r.bucket = h.bucket and r.doc_id <=> h.doc_id"))
    rows = rows.unionByName(first.select(F.col("r.doc_id"), "text", F.col("h.before").alias("bucket"), F.lit(True).alias("head")))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "head", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and likenesses."""

    def run(batches):
        last = None  # (bucket, head, doc_id, text, fingerprint)
        for pdf in batches:
            rows = []
            for doc_id, text, bucket, head in zip(pdf["doc_id"], pdf["text"].fillna(""), pdf["bucket"], pdf["head"], strict=True):
                now = (bucket, head, doc_id, text, fingerprint(text.encode("utf-8", "surrogatepass")))
                if last is not None and last[0] == bucket and not last[1]:
                    new = edited(last[3], text).encode("utf-8", "surrogatepass")
                    f = fingerprint(new)
                    rows.append((last[2], len(last[3]), hashlib.sha256(new).hexdigest(), last[4], f, likeness(last[4], f), likeness(last[4], now[4])))
                last = now
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    bound(docs.sparkSession)
    return with_followers(docs).mapInPandas(run, OUT)


def op6(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
