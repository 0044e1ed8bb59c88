"""Token ids in sorted-string-table shards.

A shard holds the documents of one range of identifiers in ascending order:
blocks of entries whose keys share prefixes with the key before, a sparse index
(last key of each block, offset, length), a Bloom filter over keys and a footer.
A lookup asks the filter, bisects the index and scans one block. Documents are
dealt by ranges of doc_id, so that the shards' order is the identifiers' order.

Defined cases: null or empty text is the end id alone; a null doc_id sorts
first; repeated doc_ids keep all their entries; empty tables give no shard and
an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.batches import bound
from graphloom.llm.files import NewFile, Ranges
from graphloom.llm.words import Known, code_points
from graphloom.workspace import new_path, written

MAGIC, FOOTER = b"LOOMSST1", "<QQQQQQIB8s"
BLOCK, BLOOM_BITS, BLOOM_HASHES = 64 * 1024, 10, 7
VOCABULARY, END_ID = "byte_bpe_50k.json", 2


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", int(doc_id) + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = (h >> 32) | 1
    return [(h + i * step) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Entries must come in ascending order of their keys."""

    def __init__(self, folder: str, stem: str, width: int) -> None:
        self.file, self.width = NewFile(folder, stem, ".sst"), width
        self.block, self.keys, self.index, self.last = bytearray(), [], [], b""
        self.tokens, self.zip = 0, zstandard.ZstdCompressor(level=1)
        self.file.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key, shared = key_of(doc_id), 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids) // self.width
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.index.append((self.last, self.file.write(data), len(data)))
            self.block = bytearray()

    def close(self) -> str:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        at_index = self.file.write(index)
        at_bloom = self.file.write(bytes(bloom))
        self.file.write(struct.pack(FOOTER, at_index, len(index), at_bloom, bits, len(self.keys), self.tokens, len(self.index), self.width, MAGIC))
        return self.file.close()


class Table:
    """Reads a shard: whole in order, or by key."""

    def __init__(self, uri: str) -> None:
        self.file, n = Ranges(uri), struct.calcsize(FOOTER)
        at_index, index_len, self.at_bloom, self.bits, self.count, self.tokens, blocks, self.width, magic = struct.unpack(
            FOOTER, self.file.read(self.file.size - n, n)
        )
        if magic != MAGIC or self.file.read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        raw, at, self.index = self.file.read(at_index, index_len), 0, []
        for _ in range(blocks):
            k, at = _read_varint(raw, at)
            key, at = raw[at : at + k], at + k
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, offset, length))
        self.bloom, self.zip = None, zstandard.ZstdDecompressor()

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length = self.index[i]
        b, at, key = self.zip.decompress(self.file.read(offset, length)), 0, b""
        while at < len(b):
            shared, at = _read_varint(b, at)
            own, at = _read_varint(b, at)
            size, at = _read_varint(b, at)
            key = key[:shared] + b[at : at + own]
            at += own
            yield key, b[at : at + size]
            at += size

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, raw in self._block(i):
                yield id_of(key), self.ids(raw)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first entry of a document."""
        key = key_of(doc_id)
        if self.bloom is None:
            self.bloom = self.file.read(self.at_bloom, (self.bits + 7) // 8)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return None
        i = bisect.bisect_left(self.index, key, key=lambda x: x[0])
        return next((self.ids(raw) for k, raw in self._block(i) if k == key), None) if i < len(self.index) else None


CHUNK, KEEP_WORDS, KEEP_LETTERS = 1 << 20, 1_500_000, 1 << 24
OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)
_CUT = re.compile(r"(?<=\S)[ \n\t]|(?<=[^\W\d_])(?=[^\w\s'])|(?<=[^\W\d_])(?=[0-9])")


def _class_of(cp: int, data) -> int:
    kind = data.category(chr(cp))
    if kind[0] == "Z" or 9 <= cp <= 13 or cp == 0x85:
        return SPACE
    return LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER


def classes() -> np.ndarray:
    """What the pre-tokenizer's pattern sees in each code point; ``UNSURE`` where versions of Unicode differ."""
    out = np.full(0x110000, UNSURE, dtype=np.uint8)
    for cp in range(0x30000):
        now = _class_of(cp, unicodedata)
        out[cp] = now if now == _class_of(cp, unicodedata.ucd_3_2_0) else UNSURE
    return out


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_BYTES = _byte_letters()


def _letters(words: list[str]) -> list[str]:
    """Each word in the letters that stand for its bytes."""
    if any("\n" in w for w in words):
        return [w.encode().decode("latin-1").translate(_BYTES) for w in words]
    return "\n".join(words).encode().decode("latin-1").translate(_BYTES | {10: 10}).split("\n")


def starts_of_words(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer of byte-level BPE starts a word. ``first``: flags of the texts' beginnings.

    A word is a run of letters, of numbers or of other characters with a space
    before it, an ending after an apostrophe, or white space; the last of
    several white space characters before something else stands apart.
    """
    n = len(cp)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    start[:-1] |= white[:-1] & ~white[1:] & ~first[1:]
    start[1:] &= ~((cp[:-1] == 32) & ~white[1:] & ~first[1:])  # the space belongs to what follows it
    for q in np.flatnonzero((cp == 39) & start).tolist():
        if q + 1 < n and not first[q + 1]:
            a, b = int(cp[q + 1]), int(cp[q + 2]) if q + 2 < n and not first[q + 2] else 0
            size = 2 if a in (115, 116, 109, 100) else 3 if (a, b) in ((114, 101), (118, 101), (108, 108)) else 0  # s t m d, re ve ll
            if size:
                start[q + 1] = False
                if q + size < n:
                    start[q + size] = True
    return start


class Encoder:
    """A tokenizer that meets every distinct word once.

    Texts are cut into the pre-tokenizer's words and the words hashed as arrays;
    the library's model encodes those that are new, and the ids of a text are
    gathered from what it said. Tokenizers with another pre-tokenizer, texts
    with added tokens and texts with letters of newer versions of Unicode are
    left to the library as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words = self.model.model.tokenize
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        spec = json.loads(self.model.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_words = (
            spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        )
        self.kinds = classes() if self.by_words else None
        self.forget()

    def forget(self) -> None:
        self.known, self.offset, self.count = Known(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def raw(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Has the library's model encode new words, which it wants in the letters that stand for bytes."""
        said = list(map(self.words, _letters(words)))
        size = np.fromiter(map(len, said), dtype=np.int64, count=len(said))
        self.offset = np.concatenate([self.offset, len(self.flat) + np.cumsum(size) - size])
        self.count = np.concatenate([self.count, size])
        self.flat = np.concatenate([self.flat, np.array([t.id for found in said for t in found], dtype=self.dtype)])

    def _encode_words(self, texts: list[str]) -> list[np.ndarray]:
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        joined = "".join(texts)
        cp = code_points(joined)
        n = len(cp)
        if not n:
            return [np.zeros(0, self.dtype)] * len(texts)
        kind = self.kinds[cp]
        if (kind == UNSURE).any() or any(a in joined for a in self.added):
            odd = [any(a in t for a in self.added) or bool((self.kinds[code_points(t)] == UNSURE).any()) for t in texts]
            one, other = iter(self.library([t for t, o in zip(texts, odd, strict=True) if o])), iter(self._encode_words([t for t, o in zip(texts, odd, strict=True) if not o]))
            return [next(one if o else other) for o in odd]
        first = np.zeros(n, dtype=bool)
        end = np.cumsum(size)
        first[(end - size)[size > 0]] = True
        at = np.flatnonzero(starts_of_words(cp, kind, first))
        stop = np.append(at[1:], n)
        word, new = self.known.numbers(cp, at, stop)
        if len(new):
            self._learn([joined[a:b] for a, b in zip(at[new].tolist(), stop[new].tolist(), strict=True)])
        count = self.count[word]
        upto = np.cumsum(count)
        ids = self.flat[np.repeat(self.offset[word] - (upto - count), count) + np.arange(upto[-1])]
        words_before = np.searchsorted(at, end, side="left")
        ends = np.where(words_before > 0, upto[words_before - 1], 0).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_words:
            return self.library(texts)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        part: list[tuple[int, str]] = []
        held = 0

        def flush() -> None:
            nonlocal part, held
            if len(self.known) > KEEP_WORDS or self.known.used > KEEP_LETTERS:
                self.forget()
            for (i, _), ids in zip(part, self._encode_words([t for _, t in part]), strict=True):
                out[i].append(ids)
            part, held = [], 0

        for i, text in enumerate(texts):
            lo = 0
            if len(text) > CHUNK and any(a in text for a in self.added):
                out[i] += self.library([text])
                continue
            while lo < len(text):
                cut = _CUT.search(text, lo + CHUNK) if len(text) - lo > CHUNK else None
                hi = cut.start() if cut else len(text)
                part.append((i, text[lo:hi]))
                held += hi - lo
                lo = hi
                if held >= CHUNK:
                    flush()
        flush()
        return [o[0] if len(o) == 1 else np.concatenate([np.zeros(0, self.dtype), *o]) for o in out]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the shards; returns ``(shard, uri, docs, tokens)``, in the order of their identifiers."""

    def run(batches):
        path = vocabulary or vocabulary_path()
        enc, out = encoder(path), None
        end = enc.raw([end_id])
        shard = TaskContext.get().partitionId()
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            for doc_id, ids in zip(pdf["doc_id"].tolist(), enc.encode(texts), strict=True):
                out = out or Writer(folder, f"shard-{shard:06d}", enc.width)
                out.add(None if pd.isna(doc_id) else int(doc_id), ids.tobytes() + end)
        if out is not None:
            yield pd.DataFrame({"shard": [shard], "uri": [out.close()], "docs": [len(out.keys)], "tokens": [out.tokens]})

    bound(docs.sparkSession)
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ranged.mapInPandas(run, "shard int, uri string, docs long, tokens long"), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files."""

    def run(batches):
        for pdf in batches:
            for uri, base in zip(pdf["uri"], pdf["base"], strict=True):
                rows, table = [], Table(uri)
                for doc_id, ids in table:
                    rows.append((doc_id, base, len(ids), zlib.crc32(ids.tobytes())))
                    base += len(ids)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    along = W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)  # a row for each shard
    based = manifest.withColumn("base", F.sum("tokens").over(along) - F.col("tokens"))
    return based.repartition(max(1, manifest.count())).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_shards(write_shards(docs, new_path(spark, "tokens")))
