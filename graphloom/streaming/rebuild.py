"""A graph of a watched folder of code, kept up to date batch by batch.

Each batch of changes parses the files whose content is new, puts their rows in
place of the old ones and derives the graph from the rows of all files. A version
is written beside the last one and counts once its commit file is there, which
appears whole or not at all; a batch that comes again after a restart is known by
its number. Deriving sorts by file and place, never by time, so a graph that grew
by changes equals one that is built at once.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import KG
from graphloom.operators import analyze, build, code, community, imports
from graphloom.sources import folder
from graphloom.sources.files import classify, in_noise, is_sensitive, readable
from graphloom.streaming.watch import DEBOUNCE, is_ignored
from graphloom.workspace import removed, written

KEEP = 2
FILES = "path string, sha256 string"
TABLES = ("files", "rows_nodes", "rows_edges", "nodes", "edges", "gods")


class Store:
    """Versions of tables in a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _commits(self) -> list[str]:
        system, base = folder.place(self.root)
        return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.endswith(".commit"))

    def current(self) -> dict:
        """The commit that counts: version, batch, folder and facts; version 0 if there is none."""
        names = self._commits()
        if not names:
            return {"version": 0, "batch": -1, "facts": {}}
        system, base = folder.place(self.root)
        with system.open_input_stream(f"{base}/{names[-1]}") as f:
            return json.loads(f.read())

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        """A table of the current version; with ``schema``, an empty one if there is no version."""
        now = self.current()
        if not now["version"]:
            if schema is None:
                raise ValueError(f"{self.root} holds no version")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{now['folder']}/{table}")

    def commit(self, batch: int, tables: dict[str, DataFrame], facts: dict) -> int:
        """Writes a version whole; earlier ones but the last are removed."""
        version = self.current()["version"] + 1
        at = f"v{version:08d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{at}/{name}")
        said = {"version": version, "batch": batch, "folder": at, "facts": facts}
        folder.write_whole(self.root, f"{version:08d}.commit", json.dumps(said).encode())
        self._sweep(version)
        return version

    def _sweep(self, version: int) -> None:
        """Removes versions that no reader of the last ``KEEP`` has open, and what broken batches left."""
        system, base = folder.place(self.root)
        names = self._commits()
        for name in names[:-KEEP]:
            system.delete_file(f"{base}/{name}")
        live = set()
        for name in names[-KEEP:]:
            with system.open_input_stream(f"{base}/{name}") as f:
                live.add(json.loads(f.read())["folder"])
        for f in system.get_file_info(fs.FileSelector(base)):
            if f.type == fs.FileType.Directory and f.base_name.startswith("v") and f.base_name not in live and int(f.base_name[1:9]) <= version:
                removed(self.spark, f"{self.root}/{f.base_name}")

    def graph(self) -> KG:
        return KG(self.read("nodes"), self.read("edges"))


def is_code(path: str = "path"):
    """What is parsed: code that is no noise, no secret and not ignored by the watch."""
    return (classify(path) == "code") & ~in_noise(path) & ~is_sensitive(path) & ~is_ignored(path)


def derive(nodes: DataFrame, edges: DataFrame) -> tuple[KG, DataFrame]:
    """The graph with its communities, and its most connected nodes, from the rows of all files."""
    order = F.shiftrightunsigned(F.xxhash64("source_file"), 21) * F.lit(1 << 20)  # files in an order that is always the same
    nodes = nodes.withColumn("node_seq", order + F.col("node_seq"))
    edges = edges.withColumn("edge_seq", order + F.col("edge_seq"))
    resolved = written(imports.resolve_labels(nodes, edges), "resolved")
    crossed = imports.resolve_cross_file(nodes, resolved).withColumn("edge_seq", order)
    kg = build.build(nodes, resolved.unionByName(crossed.select(*resolved.columns)))
    kg = KG(written(kg.nodes, "nodes"), written(kg.edges, "edges"))
    kg = kg.clustered(community.cluster(kg))
    return kg, analyze.god_nodes(kg)


def rebuild(store: Store, changes: DataFrame, batch: int) -> None:
    """Takes ``changes(path, change, content)`` into the store's next version."""
    if store.current()["batch"] >= batch:
        return  # this batch was committed before a restart
    told = changes.where(is_code()).select("path", "change", readable(F.col("content")).alias("text"), F.sha2("content", 256).alias("sha256"))
    told = written(told, "changes", "zstd")
    old = store.read("files", FILES)
    known = told.where("change <> 'deleted'").join(old, ["path", "sha256"], "left_semi").select("path")
    fresh = told.where("change <> 'deleted'").join(known, "path", "left_anti")
    gone = told.join(known, "path", "left_anti").select("path")
    nodes, edges = code.extract(fresh.select("path", "text"))
    left = gone.withColumnRenamed("path", "source_file")
    rows_nodes = store.read("rows_nodes", code.NODE).join(left, "source_file", "left_anti").unionByName(nodes)
    rows_edges = store.read("rows_edges", code.EDGE).join(left, "source_file", "left_anti").unionByName(edges)
    rows_nodes, rows_edges = written(rows_nodes, "rows-nodes"), written(rows_edges, "rows-edges")
    now = old.join(gone, "path", "left_anti").unionByName(fresh.select("path", "sha256"))
    kg, gods = derive(rows_nodes, rows_edges)
    tables = dict(zip(TABLES, (now, rows_nodes, rows_edges, kg.nodes, kg.edges, gods), strict=True))
    store.commit(batch, tables, {"parsed": fresh.count(), "changed": gone.count()})


def full(spark: SparkSession, root: str) -> KG:
    """The graph of a folder as it is, built at once."""
    read = folder.files(spark, root).where(is_code()).select("path", readable(F.col("content")).alias("text"))
    return derive(*code.extract(read))[0]


def watched(spark: SparkSession, root: str, store: str, checkpoint: str, once: bool = False):
    """Keeps ``store`` up to date with the code below ``root``; a burst of changes within the debounce is one batch."""
    at = Store(spark, store)
    writer = folder.changes(spark, root, f"{checkpoint.rstrip('/')}-snapshots").writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: rebuild(at, df, i))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()
