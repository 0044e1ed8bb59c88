"""Places that driver and executors share, and ways to cut lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one is set where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy", path: str | None = None, **options: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet in the shared folder and read back; ``options`` are the writer's."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.options(compression=compression, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing will read again; a missing one is no fault."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables of one piece of work, which go together when it is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(new_path(self.spark, name))
        return self.paths[-1]

    def written(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        return written(df, name, compression, self.path(name))

    def renewed(self, df: DataFrame, name: str) -> DataFrame:
        """Like ``written``; the table of this name before it goes, as its rows are in the new one."""
        old = [p for p in self.paths if p.rsplit("/", 1)[-1].rsplit("-", 1)[0] == name]
        fresh = self.written(df, name)
        for p in old:
            removed(self.spark, p)
            self.paths.remove(p)
        return fresh

    def clear(self) -> None:
        while self.paths:
            removed(self.spark, self.paths.pop())


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession):
    """The shuffles of what is written meanwhile go as soon as it is."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: survives lost executors and ends the lineage.

    A checkpoint would keep the plan's estimated size, which a join multiplies: in a
    loop that joins its state with itself the estimate squares in every round, and
    planning with it. A table's size is what its files have. The shuffles that made it go at once,
    so a loop's disk doesn't grow with its rounds.
    """
    with shuffles_go(df.sparkSession):
        return written(df, "cut")


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``i``, their places in order of ``by`` from 0, without a sort in one task."""
    parts = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33)))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"))  # a row for each partition
    return parts.join(F.broadcast(before), "part").withColumn("i", F.coalesce("before", F.lit(0)) + F.col("at")).drop("part", "at", "before")
