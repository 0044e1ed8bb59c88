"""Changes as streams: debounced batches, incremental rebuilds, and a state that expires."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEBOUNCE, TTL_SECONDS, IDLE_SECONDS = "3 seconds", 300, 900
# Parts of a path that make a change uninteresting.
IGNORED_PARTS = (".git", "node_modules", "__pycache__", ".pyc", "target", ".DS_Store")


def is_ignored(path: str = "path") -> Column:
    out = F.lit(False)
    for p in IGNORED_PARTS:
        out = out | F.col(path).contains(p)
    return out


def debounced(events: DataFrame, gap: str = DEBOUNCE, late: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``events(ts, ...)`` as bursts that a gap of quiet ends; ``late`` sets the watermark for streams."""
    if late:
        events = events.withWatermark("ts", late)
    burst = events.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return burst.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def upsert(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of changed files go, fresh ones come; ``changed(source_file)``."""
    keep_n, keep_e = nodes.join(changed, "source_file", "left_anti"), edges.join(changed, "source_file", "left_anti")
    return keep_n.unionByName(new_nodes, allowMissingColumns=True), keep_e.unionByName(new_edges, allowMissingColumns=True)


def watch(spark, folder: str, rebuild: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Runs ``rebuild(changed files, batch)`` for each batch of new files below a folder."""
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    changed = stream.where(~is_ignored())
    writer = changed.writeStream.foreachBatch(lambda df, i: None if df.isEmpty() else rebuild(df, i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def freshness(requests: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``requests(key, ts)`` as a stream → ``(key, ts, rebuild)``: true if the state is missing or older than the time to live."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for t in rows["ts"]:
            at = int(t.timestamp())
            stale = last is None or at - last > ttl_seconds
            last = at if stale else last
            out.append((key[0], t, stale))
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "ts", "rebuild"])

    return requests.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, rebuild boolean", "built long", "append", GroupStateTimeout.NoTimeout)


def idle(connections: DataFrame, seconds: int = IDLE_SECONDS) -> DataFrame:
    """``connections(key, change)`` as a stream, 1 for an opened and -1 for a closed one → ``(key, active, idle)``.

    A service that has no open connection is told idle after so many seconds of
    silence; the timer runs on processing time and fires without any input.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "active": [0], "idle": [True]})
            return
        active = max(0, (state.get[0] if state.exists else 0) + sum(int(b["change"].sum()) for b in batches))
        state.update((active,))
        if not active:
            state.setTimeoutDuration(1000 * seconds)
        yield pd.DataFrame({"key": [key[0]], "active": [active], "idle": [False]})

    return connections.groupBy("key").applyInPandasWithState(step, "key string, active long, idle boolean", "active long", "update", GroupStateTimeout.ProcessingTimeTimeout)
