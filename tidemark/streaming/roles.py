"""Structured Streaming: running sums of each user and role, windowed rates with late data, resumable raw ingestion.

Keyed state needs a state store that holds it on disk: set `spark.sql.streaming.stateStore.providerClass` to
`ROCKSDB`, as Spark's `transformWithState` asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, late: str) -> DataFrame:
    """Events of each key in windows of a size; rows later than the watermark are left out."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


class Totals(StatefulProcessor):
    """Sums of a key as one value, and its kinds as a map of which a batch only reads the entries that it has."""

    def __init__(self, key: str, kind: str, value: str, time: str | None, idle: int):
        self.key, self.kind, self.value, self.time, self.idle = key, kind, value, time, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, kinds long, total double, last long")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, kinds, total, last = self.sums.get() if self.sums.exists() else (0, 0, 0.0, None)
        before = last
        for part in rows:
            n, total = n + len(part), total + float(part[self.value].sum())
            for kind, count in part[self.kind].value_counts().items():
                old = self.kinds.getValue((kind,)) if self.kinds.containsKey((kind,)) else (0,)
                kinds += old[0] == 0
                self.kinds.updateValue((kind,), (old[0] + int(count),))
            if self.time:
                newest = int(part[self.time].max().timestamp() * 1000)
                last = newest if last is None else max(last, newest)
        self.sums.update((n, kinds, total, last))
        if self.time and last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.idle)
            self.handle.registerTimer(last + self.idle)
        yield self._row(key, n, kinds, total, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, kinds, total, _ = self.sums.get()
        self.sums.clear()
        self.kinds.clear()
        yield self._row(key, n, kinds, total, True)

    def _row(self, key: tuple, n: int, kinds: int, total: float, done: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "events": [n], "kinds": [kinds], "total": [total], "done": [done]})


def running_totals(events: DataFrame, key: str, kind: str, value: str, time: str | None = None, late: str = "0 seconds", idle_seconds: int = 0) -> DataFrame:
    """(key, events, kinds, total, done) of each key after each batch in which it has events; null kinds and values count as none.

    With a time, rows later than the watermark are left out, and a key whose newest event is idle_seconds behind the watermark gives a last row
    with done and is forgotten; events after that start anew. Without one nothing is ever forgotten.
    """
    t = events.schema[key].dataType.simpleString()
    out = f"`{key}` {t}, events long, kinds long, total double, done boolean"
    rows = events.select(key, kind, value, *([F.col(time).cast("timestamp").alias(time)] if time else []))
    if time:
        rows = rows.where(F.col(time).isNotNull()).withWatermark(time, late)
    return rows.groupBy(key).transformWithStateInPandas(Totals(key, kind, value, time, idle_seconds * 1000), out, "Update", "EventTime" if time else "None")


def append_new(stream: DataFrame, path: str, key: str, time: str, late: str, checkpoint: str) -> StreamingQuery:
    """Appends the first row of each key. Keys are remembered while a row of them may still come, which `late` bounds; later rows are left out.

    A batch is a folder of the table at path, and one that runs again replaces its folder, so nothing that was written is read again.
    Another checkpoint writes to folders of its own.
    """
    run = zlib.crc32(checkpoint.encode())

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    first = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
