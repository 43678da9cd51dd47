"""Workloads to try an engine with: eight presets, and the events, keys and failures that they assign to sequence numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import golden_bucket


@dataclass(frozen=True)
class Scenario:
    name: str
    events: int
    types: int = 1
    workers: int = 3
    batch: int = 10
    lock_keys: int = 0
    dedup_keys: int = 0
    work_ms: int = 0
    failure_rate: float = 0.0
    backlog: bool = False
    kill_workers: int = 0
    restart_at: float = 0.0

    def assignment(self, spark: SparkSession) -> DataFrame:
        """(seq, event_type, lock_key, dedup_key, fails): what each sequence number is; fails is of the first attempt."""
        seq = F.col("id")
        key = lambda prefix, n: F.concat(F.lit(prefix), (seq % n).cast("string")) if n else F.lit(None).cast("string")
        fails = golden_bucket(seq, 1, 20) < int(1000 * self.failure_rate)
        return spark.range(self.events).select(seq.alias("seq"), key("type-", self.types).alias("event_type"), key("key-", self.lock_keys).alias("lock_key"), key("dedup-", self.dedup_keys).alias("dedup_key"), fails.alias("fails"))


# The presets.
PRESETS = {
    s.name: s
    for s in (
        Scenario("smoke", 200, workers=2, lock_keys=16),
        Scenario("throughput", 20_000, types=4, batch=50),
        Scenario("hot-key", 5_000, lock_keys=8, work_ms=5),
        Scenario("failures", 5_000, failure_rate=0.10),
        Scenario("backlog", 20_000, batch=50, backlog=True),
        Scenario("crash", 5_000, lock_keys=32, work_ms=2, backlog=True, kill_workers=2),
        Scenario("pg-restart", 5_000, lock_keys=32, work_ms=2, backlog=True, restart_at=0.4),
        Scenario("dedup-burst", 20_000, batch=50, dedup_keys=64, work_ms=2),
    )
}
