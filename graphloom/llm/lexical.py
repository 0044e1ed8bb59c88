"""Ranked lexical search over document-sharded postings.

Tasks cut their documents into shards of about ``SHARD_BYTES`` of text. A shard
is one row: its documents in ascending order of doc_id, its terms in byte order,
and its postings in compressed sparse rows (``starts`` by term; ``places`` of
documents with a count each). Once the whole corpus is counted, the shards are
sealed: each posting's count becomes an integer impact, which needs the document's
length and the corpus' mean length only. A term's weight is integer as well, so
weight times impact is the exact score and is never rounded again. A shard has a row group
of its own (``ALONE``): Parquet else looks at its buffers after 100 rows only, so writers and
readers would hold all shards of a task at once. No statistics are kept: a writer holds those of all
row groups until its file ends, and for a shard they are copies of its columns.

A search takes its items in blocks of at most ``ITEMS`` items and
``ITEM_BYTES`` of text, so what goes to the tasks is bounded. Every shard answers
all items of a block, term by term, into a dense accumulator of its documents,
and keeps its ``k`` best: those above the k-th score, then the least doc_ids
among those equal to it. Shards' answers are merged by a window whose rows Spark
limits before the shuffle.

Defined cases: a null text has no term and isn't counted, like an empty one; a
null doc_id comes after the others among equal scores; repeated rows are
documents of their own, in any order; items that are null, empty or of unknown
terms have no row; repeated items are answered each; an empty table gives an
empty result; long texts are cut into terms piece by piece; other columns aren't
looked at.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.batches import bound
from graphloom.workspace import new_path, removed, written

SHARD_BYTES = 12 << 20
PIECE = 1 << 22
K = 10
ITEMS, ITEM_BYTES = 1000, 4 << 20

ALONE = {"parquet.block.size": "1048576", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}

RAW = "n_docs long, n_terms long, docs binary, unnamed binary, lengths binary, terms binary, starts binary, places binary, counts binary"
SEALED = "n_docs long, docs binary, unnamed binary, terms binary, starts binary, places binary, impacts binary"
ANSWERS = "query long, item_id long, doc_id long, score long"

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TO = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, in lists of about ``PIECE`` bytes."""
    data, at = data.translate(_TO), 0
    while at < len(data):
        stop = data.find(b" ", at + PIECE)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def terms_of(text: str | None) -> list[bytes]:
    return [t for p in pieces((text or "").encode("utf-8", "surrogatepass")) for t in p]


class Shard:
    """Documents of one task until they are a row."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.lengths, self.tokens, self.bytes = [], [], [], 0

    def add(self, doc_id, data: bytes) -> None:
        number, n = self.number, 0
        for found in pieces(data):
            for t in set(found).difference(number):
                number[t] = len(number)
            self.tokens.append(np.fromiter(map(number.__getitem__, found), dtype=np.int32, count=len(found)))
            n += len(found)
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
        self.bytes += len(data)

    def row(self) -> dict:
        unnamed = np.array([x is None for x in self.ids], dtype=bool)
        ids = np.array([0 if x is None else x for x in self.ids], dtype=np.int64)
        lengths = np.array(self.lengths, dtype=np.int64)
        by_id = np.lexsort((ids, unnamed))
        place = np.empty(len(ids), dtype=np.int64)
        place[by_id] = np.arange(len(ids))
        terms = sorted(self.number)
        rank = np.empty(len(terms), dtype=np.int64)
        rank[np.fromiter(map(self.number.__getitem__, terms), dtype=np.int64, count=len(terms))] = np.arange(len(terms))
        keys = rank[np.concatenate(self.tokens)] * len(ids) + np.repeat(place, lengths)
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        term, places = np.divmod(keys[first], len(ids))
        return {
            "n_docs": len(ids), "n_terms": int(lengths.sum()), "docs": ids[by_id].tobytes(), "unnamed": unnamed[by_id].tobytes(), "lengths": lengths[by_id].tobytes(), "terms": b"\n".join(terms),
            "starts": np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.int64).tobytes(), "places": places.astype(np.int32).tobytes(), "counts": np.diff(np.append(first, len(keys))).astype(np.int32).tobytes(),
        }


def _sharded(batches):
    shard = Shard()
    for pdf in batches:
        for doc_id, unnamed, data in zip(pdf["doc_id"].tolist(), pdf["unnamed"].tolist(), pdf["data"], strict=True):
            if data:
                shard.add(None if unnamed else doc_id, bytes(data))
            if shard.bytes >= SHARD_BYTES:
                if shard.ids:
                    yield pd.DataFrame([shard.row()])
                shard = Shard()
    if shard.ids:
        yield pd.DataFrame([shard.row()])


def _ints(data: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(data, dtype=kind)


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The integer share of a posting in a score, before the term's weight."""
    m = 100 - 75 + (75 * lengths * n_docs) // n_terms
    tf = counts.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _sealing(n_docs: int, n_terms: int):
    def run(batches):
        for pdf in batches:
            made = [impacts(_ints(c, np.int32), _ints(n)[_ints(p, np.int32)], n_docs, n_terms).astype(np.int32).tobytes() for c, n, p in zip(pdf["counts"], pdf["lengths"], pdf["places"], strict=True)]
            yield pdf.drop(columns=["n_terms", "lengths", "counts"]).assign(impacts=made)[[c.split()[0] for c in SEALED.split(", ")]]

    return run


class Index:
    """Sealed shards of a corpus in the shared folder, and its number of documents with a term."""

    def __init__(self, shards: DataFrame, n_docs: int) -> None:
        self.shards, self.n_docs = shards, n_docs

    @classmethod
    def of(cls, docs: DataFrame) -> Index:
        """Indexes every row of ``docs(doc_id, text)``."""
        spark = docs.sparkSession
        bound(spark)
        text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), F.col("text").cast("binary").alias("data"))
        path = new_path(spark, "postings")
        raw = written(text.mapInPandas(_sharded, RAW), "postings", "zstd", path, **ALONE)
        n_docs, n_terms = raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        shards = written(raw.mapInPandas(_sealing(n_docs, n_terms), SEALED), "impacts", "zstd", **ALONE)
        removed(spark, path)
        return cls(shards, n_docs)

    def weights(self, vocabulary: list[bytes]) -> dict[bytes, int]:
        """Integer weights of the terms that the corpus has; ``vocabulary`` is in byte order."""

        def run(batches):
            for pdf in batches:
                for terms, starts in zip(pdf["terms"], pdf["starts"], strict=True):
                    n = np.diff(_ints(starts))
                    found = _located(terms.split(b"\n"), vocabulary)
                    yield pd.DataFrame({"term": list(found), "df": [int(n[i]) for i in found.values()]})

        rows = self.shards.select("terms", "starts").mapInPandas(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        return {bytes(r.term): math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * r.df + 1))) for r in rows}

    def search(self, items: DataFrame, k: int = K) -> DataFrame:
        """``items(item_id, text)`` → ``(item_id, rank, doc_id, score)``, the ``k`` best of each row with a score above 0."""
        found = [self._ranked(block, k) for block in _blocks(items)]
        if not found:
            found = [items.sparkSession.createDataFrame([], ANSWERS)]
        best = found[0]
        for more in found[1:]:
            best = best.union(more)
        by = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

    def _ranked(self, block: list, k: int) -> DataFrame:
        weight = self.weights(sorted({t for _, _, terms in block for t in terms}))
        asked = [(q, item, [(t, n * weight[t]) for t, n in terms.items() if weight.get(t)]) for q, item, terms in block]
        vocabulary = sorted({t for _, _, terms in asked for t, _ in terms})

        def run(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    rows = _answered(r, asked, vocabulary, k)
                    yield pd.DataFrame({c: pd.array([x[i] for x in rows], dtype="Int64") for i, c in enumerate(("query", "item_id", "doc_id", "score"))})

        return self.shards.mapInPandas(run, ANSWERS)


def _located(terms: list[bytes], vocabulary: list[bytes]) -> dict[bytes, int]:
    """Places of the words of ``vocabulary`` in the sorted ``terms``."""
    found, at = {}, 0
    for t in vocabulary:
        at = bisect_left(terms, t, at)
        if at == len(terms):
            break
        if terms[at] == t:
            found[t] = at
    return found


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0, equal ones by place, best first."""
    hit = np.flatnonzero(scores > 0)
    if len(hit) > k:
        s = scores[hit]
        least = s[np.argpartition(s, len(s) - k)[len(s) - k]]
        above = hit[s > least]
        hit = np.concatenate([above, hit[s == least][: k - len(above)]])
    return hit[np.lexsort((hit, -scores[hit]))]


def _answered(r, asked: list, vocabulary: list[bytes], k: int) -> list[tuple]:
    starts, places, made = _ints(r.starts), _ints(r.places, np.int32), _ints(r.impacts, np.int32)
    docs, unnamed = _ints(r.docs), _ints(r.unnamed, bool)
    at = _located(r.terms.split(b"\n"), vocabulary)
    total, out = np.zeros(r.n_docs, dtype=np.int64), []
    for query, item, terms in asked:
        total.fill(0)
        for t, w in terms:
            if t in at:
                a, b = starts[at[t]], starts[at[t] + 1]
                total[places[a:b]] += made[a:b] * np.int64(w)
        out += [(query, item, None if unnamed[i] else int(docs[i]), int(total[i])) for i in top(total, k).tolist()]
    return out


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of ``items`` as ``(number, item_id, count of each term)``, one block at a time."""
    block, size = [], 0
    for q, (item, text) in enumerate(items.select("item_id", "text").toLocalIterator()):
        block.append((q, item, Counter(terms_of(text))))
        size += len(text or "")
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def op12(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return Index.of(docs).search(items)


OP12_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
items as (
  select row_number() over () as q, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
total as (select count(*)::bigint as n_docs, sum(len(terms))::bigint as n_terms from docs where len(terms) > 0),
tf as (
  select r, doc_id, n, term, count(*)::bigint as tf from (select r, doc_id, len(terms)::bigint as n, unnest(terms) as term from docs)
  where term in (select term from items) group by all),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term, n_docs),
scored as (
  select q, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::bigint as score
  from items join weights using (term) join tf using (term), total group by all),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
