"""Workers and leases: upserts, heartbeats, acquisition, release, sweeps. Pure functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transitions import Change, _now


def worker_upsert(workers: DataFrame, new: DataFrame, now) -> Change:
    """Registers rows (worker_id, host, …): heartbeat is now, no graceful stop; other columns are replaced."""
    row = new.withColumn("last_heartbeat", _now(now)).withColumn("graceful_stop", F.lit(False))
    for name, kind in workers.dtypes:
        row = row.withColumn(name, (F.col(name) if name in row.columns else F.lit(None)).cast(kind))
    row = row.select(*workers.columns)
    return Change(workers.join(row.select("worker_id"), "worker_id", "left_anti").select(*workers.columns).unionByName(row), row)


def _touch(workers: DataFrame, worker: str, column: str, value) -> Change:
    hit = F.col("worker_id") == worker
    out = workers.withColumn(column, F.when(hit, value).otherwise(F.col(column)))
    return Change(out, out.where(hit))


def heartbeat(workers: DataFrame, worker: str, now) -> Change:
    """`returned` is empty if the worker isn't registered any more and must register again."""
    return _touch(workers, worker, "last_heartbeat", _now(now))


def mark_graceful_stop(workers: DataFrame, worker: str) -> Change:
    return _touch(workers, worker, "graceful_stop", F.lit(True))


def deregister(workers: DataFrame, worker: str) -> Change:
    return Change(workers.where(F.col("worker_id") != worker), workers.where(F.col("worker_id") == worker))


def dead_workers(workers: DataFrame, now, seconds: int = 30, limit: int = 50) -> DataFrame:
    old = F.col("last_heartbeat") < _now(now) - F.make_dt_interval(secs=F.lit(seconds))
    return workers.where(old | F.col("graceful_stop")).orderBy("last_heartbeat", "worker_id").limit(limit)


def lease_acquire(locks: DataFrame, wanted: DataFrame, now, ttl_seconds: int = 600) -> Change:
    """wanted: (lock_key, owner_token, owner_worker). A free key, or one whose lease has run out (expires_at <= now), is taken.

    Of several requests for one key in a batch, the one of least token gets it. `returned`: the leases acquired.
    """
    one = wanted.groupBy("lock_key").agg(F.min(F.struct("owner_token", "owner_worker")).alias("o")).select("lock_key", "o.owner_token", "o.owner_worker")
    live = locks.where(F.col("expires_at") > _now(now)).select("lock_key")
    got = one.join(live, "lock_key", "left_anti").withColumn("acquired_at", _now(now)).withColumn("expires_at", _now(now) + F.make_dt_interval(secs=F.lit(ttl_seconds))).select(*locks.columns)
    return Change(locks.join(got.select("lock_key"), "lock_key", "left_anti").select(*locks.columns).unionByName(got), got)


def lease_release(locks: DataFrame, tokens: DataFrame) -> Change:
    """tokens: (lock_key, owner_token). A wrong token, or none, changes nothing."""
    keys = ["lock_key", "owner_token"]
    return Change(locks.join(tokens.select(*keys), keys, "left_anti").select(*locks.columns), locks.join(tokens.select(*keys), keys, "left_semi").select(*locks.columns))


def lease_sweep(locks: DataFrame, now) -> Change:
    out = F.col("expires_at") <= _now(now)
    return Change(locks.where(~out), locks.where(out))
