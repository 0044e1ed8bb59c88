"""A folder as a table of its files, and as a stream of their changes.

``spark.read.format("folder")`` plans partitions of about ``PART_BYTES`` from a
walk that opens no folder of noise but does open ``.planning``; filters on path
and length are asked before a file is read. ``spark.readStream.format("folder")``
has snapshots of the folder as offsets: what differs between two of them are the
files that were added, changed or deleted. Snapshots are kept in the folder named
by the option ``state``, so that a stream goes on where it stopped; those that no
restart can need are removed.

Options: ``root``; ``state`` for streams; ``content`` (true unless it says false).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from graphloom.sources.files import SKIP_DIRS, SKIP_ENDS

PART_BYTES, PART_FILES = 32 << 20, 1000
SCHEMA = "path string, change string, length long, modified long, content binary"

Listing = dict[str, list[int]]  # path → length, modified in nanoseconds


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def is_noise(folder: str) -> bool:
    """Whether a folder of this name is never opened."""
    return folder in SKIP_DIRS or folder.endswith(SKIP_ENDS) or (folder.startswith(".") and folder != ".planning")


def listing(root: str) -> Listing:
    """All files below ``root``, without opening folders of noise."""
    system, base = place(root.rstrip("/"))
    out, todo = {}, [base]
    while todo:
        for f in system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
            if f.type == fs.FileType.Directory and not is_noise(f.base_name):
                todo.append(f.path)
            elif f.type == fs.FileType.File:
                out[f.path[len(base) + 1 :]] = [f.size, f.mtime_ns or 0]
    return out


def differences(old: Listing, new: Listing) -> list[tuple[str, str, int, int]]:
    """``(path, change, length, modified)`` in order of paths."""
    out = []
    for path in sorted(old.keys() | new.keys()):
        if path not in new:
            out.append((path, "deleted", 0, 0))
        elif old.get(path) != new[path]:
            out.append((path, "changed" if path in old else "added", *new[path]))
    return out


@dataclass
class Part(InputPartition):
    """Files that one task reads."""

    files: list[tuple[str, str, int, int]]


def parts(files: list[tuple[str, str, int, int]]) -> list[Part]:
    out: list[Part] = []
    size = 0
    for f in files:
        if not out or size + f[2] > PART_BYTES or len(out[-1].files) >= PART_FILES:
            out.append(Part([]))
            size = 0
        out[-1].files.append(f)
        size += f[2]
    return out


def rows(root: str, part: Part | None, content: bool) -> Iterator[tuple]:
    """A part's files; one that is gone meanwhile is deleted. Without any file Spark asks for no part."""
    if part is None:
        return
    system, base = place(root.rstrip("/"))
    for path, change, length, modified in part.files:
        data = None
        if content and change != "deleted":
            try:
                with system.open_input_stream(f"{base}/{path}") as f:
                    data = f.read()
            except FileNotFoundError:
                change, length = "deleted", 0
        yield path, change, length if data is None else len(data), modified, data


class Folder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FolderStream(self.options)


def _content(options) -> bool:
    return options.get("content", "true").lower() != "false"


class FolderReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root, self.content = options["root"], _content(options)
        self.asked: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        tests = {
            EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
            StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
        }
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if type(f) in tests and column in ("path", "length", "modified"):
                self.asked.append(({"path": 0, "length": 2, "modified": 3}[column], tests[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        files = differences({}, listing(self.root))
        return parts([f for f in files if all(test(f[i], v) for i, test, v in self.asked)])

    def read(self, partition: Part) -> Iterator[tuple]:
        return rows(self.root, partition, self.content)


class FolderStream(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.root, self.state, self.content = options["root"], options["state"].rstrip("/"), _content(options)

    def _kept(self) -> list[str]:
        system, base = place(self.state)
        return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.endswith(".snapshot"))

    def _load(self, name: str) -> Listing:
        if not name:
            return {}
        system, base = place(self.state)
        with system.open_input_stream(f"{base}/{name}") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:  # noqa: N802
        return {"snapshot": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        text = json.dumps(listing(self.root), sort_keys=True).encode()
        digest, kept = hashlib.sha256(text).hexdigest()[:32], self._kept()
        if kept and kept[-1][9:-9] == digest:
            return {"snapshot": kept[-1]}
        name = f"{int(kept[-1][:8]) + 1 if kept else 1:08d}-{digest}.snapshot"
        write_whole(self.state, name, text)
        return {"snapshot": name}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts(differences(self._load(start["snapshot"]), self._load(end["snapshot"])))

    def read(self, partition: Part) -> Iterator[tuple]:
        return rows(self.root, partition, self.content)

    def commit(self, end: dict) -> None:
        system, base = place(self.state)
        for name in self._kept():
            if name < end["snapshot"]:
                system.delete_file(f"{base}/{name}")


def write_whole(folder: str, name: str, data: bytes) -> None:
    """A file that appears under its name with all its content, or not at all."""
    system, base = place(folder)
    system.create_dir(base, recursive=True)
    part = f"{base}/.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, f"{base}/{name}")


def files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """``(path, change, length, modified, content)`` of a folder's files."""
    spark.dataSource.register(Folder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("folder").option("root", root).option("content", str(content)).load()


def changes(spark: SparkSession, root: str, state: str) -> DataFrame:
    """The stream of a folder's changes; ``state`` is where its snapshots are kept."""
    spark.dataSource.register(Folder)
    return spark.readStream.format("folder").option("root", root).option("state", state).load()
