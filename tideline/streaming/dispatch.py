"""Dispatch as Structured Streaming: new files of pending events are published as they come, and each micro-batch drains what is due.

A micro-batch that runs again publishes nothing twice: the commit that published it holds its number, also when its events are finished and
gone. It finalizes nothing twice: the guard on id, version and worker no longer matches. There is no watermark: an event whose run_at lies ahead
waits in the hot table, however late.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import transitions as X
from ..schema import PENDING


def _utc() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def pending_stream(engine: Engine, folder: str, max_files: int = 100) -> DataFrame:
    return engine.spark.readStream.schema(PENDING).option("maxFilesPerTrigger", max_files).parquet(folder)


def dispatcher(engine: Engine, stream: DataFrame, checkpoint: str, clock: Callable[[], datetime] = _utc, trigger: dict | None = None, name: str = "pending"):
    """Starts the query; `name` tells the streams into one engine apart. By default it takes all files that are there and stops (availableNow)."""

    def batch(df: DataFrame, number: int) -> None:
        now = clock()

        def step(store, base):
            change = X.publish(store.read("events", base), df.dropDuplicates(["id"]), now)
            return ({}, {"events": change.returned}, None) if change.returned.head(1) else ({}, {}, None)

        engine.store.transact(step, batch=(name, number))
        for event_type in engine.handlers:
            engine.drain(event_type, now)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def meters(facts: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts by window, callback and type over a stream (or table) of facts with a timestamp `ts`."""
    f = facts.withWatermark("ts", late) if facts.isStreaming else facts
    return f.groupBy(F.window("ts", window), "callback", "event_type").agg(F.count("*").alias("n"))
