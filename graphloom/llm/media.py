"""Content-addressed media in tar shards.

A payload becomes a grey PNG image, 576 samples a row, named by the digest of
the stored form. Each task writes one tar shard with every distinct image of its
rows once; a row carries digest, shard, offset and length. So copies cost one
image for each shard at most, and no payload is shuffled. Reading takes the 33
header bytes by a range read for the metadata columns, and the whole range only
where samples are asked for.

Defined cases: null or empty text is one row of padding; repeated rows share an
image; an empty table writes no shard; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphloom.llm.batches import bound
from graphloom.llm.files import NewFile, Ranges
from graphloom.workspace import new_path, written

ROW, PAD = 576, b"\xff"
HEAD = 33  # signature and IHDR of a PNG file
SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "doc_id long, n_bytes long, media_sha256 string, shard string, offset long, length long"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string"


def padded(data: bytes) -> bytes:
    return data + PAD * (-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), dtype=np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int]:
    """Width and height from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    return struct.unpack(">II", head[16:24])


def from_png(data: bytes) -> bytes:
    width, height = png_size(data[:HEAD])
    at, body = 8, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and a histogram of sixteen grey levels, in hexadecimal per mille."""
    a = np.frombuffer(samples, dtype=np.uint8)
    levels = np.bincount(a >> 4, minlength=16) * 1000 // len(a)
    return f"mean={a.mean():.3f} std={a.std():.3f} hist=" + "".join(f"{x:03x}" for x in levels)


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the shards; a row for each document with digest, shard, offset and length."""

    def run(batches):
        out, seen = None, {}
        rows: list[tuple] = []
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                key = hashlib.sha256(data).digest()
                if key not in seen:
                    media = to_png(padded(data))
                    digest = hashlib.sha256(media).hexdigest()
                    out = out or NewFile(folder, f"media-{TaskContext.get().partitionId():06d}", ".tar")
                    info = tarfile.TarInfo(digest + ".png")
                    info.size = len(media)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT))
                    seen[key] = (digest, out.write(media), len(media))
                    out.write(bytes(-len(media) % 512))
                rows.append((doc_id, len(data), *seen[key]))
        if out is not None:
            out.write(bytes(1024))
            uri = out.close()
            for lo in range(0, len(rows), 10_000):
                pdf = pd.DataFrame(rows[lo : lo + 10_000], columns=["doc_id", "n_bytes", "media_sha256", "offset", "length"])
                pdf["shard"] = uri
                yield pdf[["doc_id", "n_bytes", "media_sha256", "shard", "offset", "length"]]

    bound(docs.sparkSession)
    return written(docs.select("doc_id", "text").mapInPandas(run, INDEX), "media-index")


def load(index: DataFrame) -> DataFrame:
    """Metadata from header ranges, and features from the samples read back."""

    def run(batches):
        for pdf in batches:
            rows = [None] * len(pdf)
            for shard, part in pdf.groupby("shard", sort=False):
                file, seen = Ranges(shard), {}
                for i in part.index:
                    offset, length = int(pdf.at[i, "offset"]), int(pdf.at[i, "length"])
                    if offset not in seen:
                        width, height = png_size(file.read(offset, HEAD))
                        media = file.read(offset, length)
                        p = from_png(media)
                        seen[offset] = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), length, hashlib.sha256(media).hexdigest(), width, height, feature(p))
                    rows[i] = (pdf.at[i, "doc_id"], pdf.at[i, "n_bytes"], *seen[offset])
                file.close()
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return index.mapInPandas(run, FEATURES)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return load(store(docs, new_path(spark, "media")))
