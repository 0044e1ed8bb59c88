"""Removal of repeated byte strings through suffix arrays built in blocks.

Every string of ``WIDTH`` bytes is named by the least hash among its grams of
``GRAM`` bytes, a function of its content alone, so equal strings have equal
names wherever they stand. Three passes over documents dealt into groups of
about ``GROUP_BYTES``:

1. Each group tells its names, packed by bucket, and learns which of them stand
   in two documents or more. Only strings with such names can repeat.
2. Runs of strings with one such name go to the name's bucket, equal runs of a
   group once and with the least doc_id that has them.
3. A bucket is a block of suffixes. It is sorted one suffix bucket at a time (by
   the first two bytes, then to the depth of the cover's period); ties beyond
   are resolved by the ranks of a difference-cover sample, computed beforehand:
   for two positions there is a shift below the period that takes both to the
   sample. Memory is bounded by the block. Neighbours in suffix order that agree
   in all ``WIDTH`` bytes share the least doc_id, and what belongs to a smaller
   document is told back to the groups, which cover, cut and count.

No group of copies meets in one task: a common passage reaches its bucket once
for each group of documents.

Defined cases: null text is empty; a null doc_id counts as smaller than any
other; rows with one doc_id don't remove from each other; texts shorter than the
width stay whole; empty tables give empty results; extra columns of any name
come along in ``deduplicated`` and are not looked at otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.workspace import written

WIDTH, GRAM, GROUP_BYTES, CHUNK = 50, 20, 6_000_000, 1 << 20
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)  # every difference modulo 31 occurs
_MULT, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_NONE = np.iinfo(np.int64).min  # a doc_id that is null


def _grams(t: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position that has them, by doubling."""
    level, length, done, out = t.astype(np.uint64) + np.uint64(1), 1, 0, None
    while True:
        power = np.uint64(pow(_MULT, length, 1 << 64))
        if size & length:
            if out is None:
                out = level
            else:
                n = len(t) - done - length + 1
                out = out[:n] * power + level[done : done + n]
            done += length
        if done == size:
            break
        level = level[: len(level) - length] * power + level[length:]
        length *= 2
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(_MIX)
    return out ^ (out >> np.uint64(32))


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum over each ``n`` neighbours."""
    length = 1
    while 2 * length <= n:
        h = np.minimum(h[: len(h) - length], h[length:])
        length *= 2
    return np.minimum(h[: len(h) - (n - length)], h[n - length :]) if length < n else h


def names(t: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """A name for the string of ``width`` bytes from each position that has one."""
    n = len(t) - width + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        out[lo:hi] = _least(_grams(t[lo : hi + width - 1], gram), width - gram + 1)
    return out


class Group:
    """The documents of a group, by doc_id and text, as one array of bytes."""

    def __init__(self, pdf: pd.DataFrame, width: int = WIDTH) -> None:
        texts = pdf["text"].where(pdf["text"].notna(), "")
        ids = pdf["doc_id"].astype("Int64").fillna(_NONE).astype("int64")
        order = pd.DataFrame({"d": ids.to_numpy(), "t": texts.to_numpy()}).sort_values(["d", "t"], kind="stable").index
        self.order, self.width = order, width
        self.ids = ids.to_numpy()[order]
        data = [t.encode("utf-8", "surrogatepass") for t in texts.to_numpy()[order]]
        self.size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        self.start = np.cumsum(self.size) - self.size
        self.raw = b"".join(data)
        self.bytes = np.frombuffer(self.raw, dtype=np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of strings with one name inside one document: document, first position, count and name."""
        name = names(self.bytes, self.width)
        if not len(name):
            return tuple(np.zeros(0, dtype=x) for x in (np.int64, np.int64, np.int64, np.uint64))
        last = self.start + self.size - self.width  # of each document, its last string
        valid = np.zeros(len(name) + 1, dtype=np.int8)
        has = self.size >= self.width
        np.add.at(valid, self.start[has], 1)
        np.add.at(valid, last[has] + 1, -1)
        ok = np.cumsum(valid[:-1]) > 0
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (name[1:] != name[:-1])
        new[self.start[has]] = True
        first = np.flatnonzero(new)
        doc = np.searchsorted(self.start, first, side="right") - 1
        end = np.minimum(np.append(first[1:], len(name)), last[doc] + 1)
        return doc, first, end - first, name[first]


def _split(name: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 39 further bits of each name."""
    x = name * np.uint64(_MULT)
    x ^= x >> np.uint64(31)
    x *= np.uint64(_MIX)
    x ^= x >> np.uint64(30)
    return ((x >> np.uint64(39)) % np.uint64(buckets)).astype(np.int64), x & np.uint64((1 << 39) - 1)


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(x: np.ndarray) -> bytes:
    """Ascending numbers below 2**40: their differences, byte by byte, compressed."""
    delta = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return _zip(np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(b), dtype=np.uint8).reshape(5, -1)
    delta = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    delta[:, :5] = planes.T
    return np.cumsum(delta.view("<u8").ravel(), dtype=np.uint64)


def _by_bucket(bucket: np.ndarray):
    """Each bucket with the places of its entries."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), part


def tell_names(pdf: pd.DataFrame, buckets: int, width: int) -> pd.DataFrame:
    """Pass 1: the group's names by bucket, the lowest bit set for those in two of its documents."""
    g = Group(pdf, width)
    doc, _, _, name = g.runs()
    rows = []
    if len(name):
        order = np.argsort(name, kind="stable")
        name, ids = name[order], g.ids[doc[order]]
        at = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        twice = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
        bucket, key = _split(name[at], buckets)
        packed = key << np.uint64(1) | twice.astype(np.uint64)
        grp = int(pdf["grp"].iloc[0])
        rows = [(b, grp, _pack(np.sort(packed[part]))) for b, part in _by_bucket(bucket)]
    return pd.DataFrame(rows, columns=["bucket", "grp", "packed"])


def find_repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pass 1, in a bucket: for each group, those of its names that stand in two documents."""
    parts = [_unpack(b) for b in pdf["packed"]]
    grp = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    everything = np.concatenate(parts)
    key, twice = everything >> np.uint64(1), (everything & np.uint64(1)).astype(bool)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = (np.diff(np.append(at, len(key))) > 1) | np.logical_or.reduceat(twice[order], at)
    keep = np.repeat(many, np.diff(np.append(at, len(key))))
    key, grp = key[keep], grp[order][keep]
    b = int(pdf["bucket"].iloc[0])
    ids = pdf["grp"].to_numpy()
    return pd.DataFrame([(int(ids[g]), b, _pack(np.sort(key[part]))) for g, part in _by_bucket(grp)], columns=["grp", "bucket", "packed"])


RUNS = "kind int, key long, grp long, a binary, b binary, c binary, d binary"


def tell_runs(docs: pd.DataFrame, repeated: pd.DataFrame, buckets: int, width: int) -> pd.DataFrame:
    """Pass 2: distinct runs for their buckets (kind 0) and where they stand (kind 1)."""
    rows: list[tuple] = []
    if len(docs) and len(repeated):
        g = Group(docs, width)
        doc, first, count, name = g.runs()
        bucket, key = _split(name, buckets)
        whole = key | bucket.astype(np.uint64) << np.uint64(39)  # below 2**64 for 2**25 buckets
        wanted = np.sort(np.concatenate([_unpack(p) | np.uint64(b) << np.uint64(39) for b, p in zip(repeated["bucket"], repeated["packed"], strict=True)]))
        at = np.searchsorted(wanted, whole)
        at[at == len(wanted)] = 0
        hit = np.flatnonzero(wanted[at] == whole)
        raw, seen, number, where, least = g.raw, {}, [], [], []
        for p, n, i, b in zip(first[hit].tolist(), count[hit].tolist(), g.ids[doc[hit]].tolist(), bucket[hit].tolist(), strict=True):
            u = raw[p : p + n + width - 1]
            k = seen.setdefault(u, len(seen))
            if k == len(where):  # documents come in ascending order, so the first has the least id
                where.append(b)
                least.append(i)
            number.append(k)
        texts, grp = list(seen), int(docs["grp"].iloc[0])
        least_a = np.array(least, dtype="<i8")
        for b, part in _by_bucket(np.array(where, dtype=np.int64)) if where else ():
            us = [texts[i] for i in part]
            lens = np.fromiter(map(len, us), dtype="<i4", count=len(us))
            rows.append((0, b, grp, _zip(b"".join(us)), lens.tobytes(), least_a[part].tobytes(), part.astype("<i4").tobytes()))
        if number:
            no = np.array(number, dtype=np.int64)
            later = g.ids[doc[hit]] > least_a[no]
            rows.append((1, grp, grp, first[hit].astype("<i8").tobytes(), count[hit].astype("<i4").tobytes(), later.astype(np.uint8).tobytes(), no.astype("<i4").tobytes()))
    return pd.DataFrame(rows, columns=["kind", "key", "grp", "a", "b", "c", "d"])


def _words(t: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The ``8 n`` bytes from each position as ``n`` numbers that order like the bytes."""
    from_each = np.ndarray((len(t) - 7,), dtype=">u8", buffer=t, strides=(1,))
    return [from_each[at + 8 * k].astype(np.uint64) for k in range(n)]


def _classes(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``keys`` (the first counts most), and a flag where a new value starts."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    return order, new


class CoverSample:
    """Ranks, to a depth of ``8 * DEPTH`` bytes, of the positions whose residue is in the cover."""

    DEPTH = -(-WIDTH // 8)

    def __init__(self, t: np.ndarray, n: int, depth: int = DEPTH) -> None:
        shift = np.full((PERIOD, PERIOD), -1, dtype=np.int64)
        for a in COVER:
            for b in COVER:
                for x in range(PERIOD):  # positions x and x + (b - a): both reach the cover by the shift a - x
                    s, y = (a - x) % PERIOD, (b - (a - x)) % PERIOD
                    if shift[x, y] < 0 or s < shift[x, y]:
                        shift[x, y] = s
        self.shift = shift
        inside = np.zeros(PERIOD, dtype=bool)
        inside[list(COVER)] = True
        at = np.flatnonzero(inside[np.arange(n) % PERIOD])
        order, new = _classes(_words(t, at, depth))
        self.rank = np.zeros(n, dtype=np.int32)
        self.rank[at[order]] = np.cumsum(new)

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffixes that agree on the first ``PERIOD`` bytes."""
        s = self.shift[i % PERIOD, j % PERIOD]
        return np.sign(self.rank[i + s] - self.rank[j + s])


def sort_block(t: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the positions ``at``, and a class for each: equal for equal strings of ``width`` bytes.

    ``t`` ends in padding. Suffix buckets (first two bytes) are sorted one at a
    time; ties beyond the period are split around pivots by the sample's ranks.
    """
    n = len(t) - (PERIOD + 8 * CoverSample.DEPTH)
    sample = CoverSample(t, n + PERIOD, -(-width // 8))
    head = t[at].astype(np.int64) << 8 | t[at + 1]
    rest = [*range(PERIOD, width - 8, 8), width - 8]  # words that neighbours must share beyond the period
    orders, starts = [], []
    for _, part in _by_bucket(head):
        pos = at[part]
        order, new = _classes([*_words(t, pos, 3), *(w >> np.uint64(8) for w in _words(t, pos + 24, 1))])  # 31 bytes
        pos = pos[order]
        cls = np.cumsum(new) - 1
        todo = np.flatnonzero(np.bincount(cls)[cls] > 1)
        same = np.append(False, cls[1:] == cls[:-1])  # as its neighbour before, to the period
        while len(todo):
            c = cls[todo]
            cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            size = np.diff(np.append(cut, len(c)))
            pivot = pos[todo][np.repeat(cut + size // 2, size)]
            side = sample.compare(pos[todo], pivot)
            key = np.lexsort((side, c))
            pos[todo], side = pos[todo][key], side[key]  # c is sorted already
            fresh = np.append(True, (c[1:] != c[:-1]) | (side[1:] != side[:-1]))
            mark = np.zeros(len(pos), dtype=bool)
            mark[0] = True
            mark[1:] = cls[1:] != cls[:-1]
            mark[todo[fresh]] = True
            cls = np.cumsum(mark) - 1
            todo = todo[(side != 0) & (np.bincount(cls)[cls[todo]] > 1)]
        for s in rest:
            w = _words(t, pos + s, 1)[0]
            same[1:] &= w[1:] == w[:-1]
        orders.append(pos)
        starts.append(~same)
    return np.concatenate(orders), np.cumsum(np.concatenate(starts)) - 1


def _shared_names(t: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """A flag for each run of which the name is another run's too."""
    out = np.zeros(len(start), dtype=bool)
    if len(start):
        name = np.concatenate([names(t[start[lo : lo + 20_000, None] + np.arange(width)].ravel(), width)[::width] for lo in range(0, len(start), 20_000)])
        _, which, n = np.unique(name, return_inverse=True, return_counts=True)
        out = n[which] > 1
    return out


ANSWERS = "grp long, packed binary"


def answer_runs(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Pass 3: for each group the parts of its runs that a smaller document has too: run, first and end."""
    seen: dict[bytes, int] = {}
    row, run, no, least = [], [], [], []
    for r, (a, b, c, d) in enumerate(zip(pdf["a"], pdf["b"], pdf["c"], pdf["d"], strict=True)):
        at, a = 0, _unzip(a)
        for n in np.frombuffer(b, dtype="<i4").tolist():
            no.append(seen.setdefault(a[at : at + n], len(seen)))
            at += n
        k = len(b) // 4
        row.append(np.full(k, r))
        run.append(np.frombuffer(d, dtype="<i4"))
        least.append(np.frombuffer(c, dtype="<i8"))
    row, run, least, no = np.concatenate(row), np.concatenate(run), np.concatenate(least), np.array(no, dtype=np.int64)
    owner = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(owner, no, least)
    texts = list(seen)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    start = np.cumsum(lens) - lens
    t = np.frombuffer(b"".join(texts) + bytes(2 * PERIOD + 8 * CoverSample.DEPTH), dtype=np.uint8)
    count = lens - width + 1
    low = np.zeros(len(t), dtype=bool)  # strings that a document smaller than their run's owner has
    many = np.flatnonzero(_shared_names(t, start, width))  # a run alone with its name holds no other run's strings
    if len(many):
        n = count[many]
        at = np.repeat(start[many] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        order, cls = sort_block(t, at, width)
        text_of = np.searchsorted(start, order, side="right") - 1
        cut = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        first = np.minimum.reduceat(owner[text_of], cut)
        low[order] = first[cls] < owner[text_of]
    edge = np.diff(low.astype(np.int8), prepend=0, append=0)  # what is low never goes beyond a run's own strings
    first, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    of = np.searchsorted(start, first, side="right") - 1
    whole, lo = least > owner[no], np.searchsorted(of, no, side="left")
    n = np.where(whole, 1, np.searchsorted(of, no, side="right") - lo)
    k = np.repeat(np.arange(len(no)), n)
    part = np.where(whole[k], len(first), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(k)))
    u = no[k]
    a = np.where(whole[k], 0, np.append(first, 0)[part] - start[u])
    b = np.where(whole[k], count[u], np.append(end, 0)[part] - start[u])
    told = np.stack([run[k], a, b], axis=1).astype("<i4")
    cut = np.searchsorted(row[k], np.arange(len(pdf) + 1))
    out = [(int(g), told[cut[r] : cut[r + 1]].tobytes()) for r, g in enumerate(pdf["grp"]) if cut[r] < cut[r + 1]]
    return pd.DataFrame(out, columns=["grp", "packed"])


def covered(g: Group, told: pd.DataFrame, width: int) -> np.ndarray:
    """A flag for each byte of the group that has to go."""
    delta = np.zeros(len(g.raw) + 1, dtype=np.int32)
    where, answers = told[told["kind"] == 1], told[told["kind"] == 2]
    for a, b, c, d in zip(where["a"], where["b"], where["c"], where["d"], strict=True):  # one row for a group
        first, count = np.frombuffer(a, dtype="<i8"), np.frombuffer(b, dtype="<i4").astype(np.int64)
        later, no = np.frombuffer(c, dtype=np.uint8).astype(bool), np.frombuffer(d, dtype="<i4")
        np.add.at(delta, first[later], 1)
        np.add.at(delta, first[later] + count[later] + width - 1, -1)
        if len(answers):
            said = np.concatenate([np.frombuffer(p, dtype="<i4") for p in answers["a"]]).reshape(-1, 3).astype(np.int64)
            said = said[np.argsort(said[:, 0], kind="stable")]
            stands = np.flatnonzero(~later)
            stands = stands[np.argsort(no[stands], kind="stable")]
            lo = np.searchsorted(said[:, 0], no[stands], side="left")
            hi = np.searchsorted(said[:, 0], no[stands], side="right")
            n = hi - lo
            k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            p = np.repeat(first[stands], n)
            np.add.at(delta, p + said[k, 1], 1)
            np.add.at(delta, p + said[k, 2] + width - 1, -1)
    return np.cumsum(delta[:-1]) > 0


def _grouped(docs: DataFrame, columns: list, groups: int) -> DataFrame:
    grp = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(groups))
    return docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def _cut(docs: DataFrame, columns: list, schema: T.StructType | str, make, width: int, group_bytes: int) -> DataFrame:
    """``make(group, covered, pdf)`` gives the rows of a group."""
    if width < PERIOD + 8:
        raise ValueError(f"width must be {PERIOD + 8} at least")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(1, min(1 << 25, -(-size // group_bytes)))
    light = _grouped(docs, [], groups)
    told = light.groupBy("grp").applyInPandas(lambda pdf: tell_names(pdf, groups, width), "bucket long, grp long, packed binary")
    repeated = told.groupBy("bucket").applyInPandas(find_repeated, "grp long, bucket long, packed binary")
    runs = light.groupBy("grp").cogroup(repeated.groupBy("grp")).applyInPandas(lambda d, r: tell_runs(d, r, groups, width), RUNS)
    runs = written(runs, "suffix-runs", "zstd")
    answers = runs.where("kind = 0").groupBy("key").applyInPandas(lambda pdf: answer_runs(pdf, width), ANSWERS)
    nothing = F.lit(None).cast("binary")
    back = runs.where("kind = 1").select("grp", "kind", "a", "b", "c", "d").unionByName(
        answers.select("grp", F.lit(2).alias("kind"), F.col("packed").alias("a"), nothing.alias("b"), nothing.alias("c"), nothing.alias("d"))
    )

    def finish(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        g = Group(pdf, width)
        return make(g, covered(g, told, width), pdf)

    return _grouped(docs, columns, groups).groupBy("grp").cogroup(back.groupBy("grp")).applyInPandas(finish, schema)


def digests(docs: DataFrame, width: int = WIDTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """For each document the bytes before and removed, the removed spans and a digest of the rest."""

    def make(g: Group, gone: np.ndarray, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, (d, a, n) in enumerate(zip(g.ids.tolist(), g.start.tolist(), g.size.tolist(), strict=True)):
            part = gone[a : a + n]
            removed = int(part.sum())
            spans = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum()) if removed else 0
            kept = g.bytes[a : a + n][~part].tobytes() if removed else g.raw[a : a + n]
            rows.append((None if d == _NONE else d, n, removed, spans, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _cut(docs, [], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make, width, group_bytes)


def deduplicated(docs: DataFrame, width: int = WIDTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with what is left of each text (a cut letter goes too), and n_chars to match; all rows stay."""
    fields = docs.schema.fields
    others = [F.col(f"`{f.name}`").alias(f"x{i}") for i, f in enumerate(fields) if f.name not in ("doc_id", "text")]

    def make(g: Group, gone: np.ndarray, pdf: pd.DataFrame) -> pd.DataFrame:
        out, texts = pdf.iloc[g.order].reset_index(drop=True), []
        for i, (a, n) in enumerate(zip(g.start.tolist(), g.size.tolist(), strict=True)):
            part = gone[a : a + n]
            texts.append(g.bytes[a : a + n][~part].tobytes().decode("utf-8", "ignore") if part.any() else out["text"].iloc[i])
        result = {}
        for i, f in enumerate(fields):
            name = f.name if f.name in ("doc_id", "text") else f"x{i}"
            counted = [0 if t is None else len(t) for t in texts] if f.name == "n_chars" else None
            result[f"x{i}"] = texts if name == "text" else counted or out[name]
        return pd.DataFrame(result)

    rows = _cut(docs, others, T.StructType([T.StructField(f"x{i}", f.dataType, True) for i, f in enumerate(fields)]), make, width, group_bytes)
    return rows.toDF(*[f.name for f in fields])


def op1(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
