"""The engine: publish, tick (claim, dispatch, finalize), maintenance, admin. State is in a SnapshotStore; time is given."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .handlers import Codecs, EventHandler, run_handlers
from .operators import registry as R
from .operators import transitions as X
from .policy import FailurePolicy, route
from .store import SnapshotStore


@dataclass
class EngineConfig:
    batch: int = 1000
    worker: str = "w-0"
    archive: bool = False
    unknown: str = "SKIP"
    unknown_delay_ms: int = 60_000
    dead_seconds: int = 30
    stale_seconds: int = 600
    sweep_limit: int = 1000
    max_runtime_seconds: int = 300
    lock_seconds: int = 600
    lock_busy_ms: int = 1000
    retention_batch: int = 1000
    retention_batches: int = 16
    policies: dict[str, FailurePolicy] = field(default_factory=dict)
    default_policy: FailurePolicy = field(default_factory=FailurePolicy)


class Engine:
    """All methods take `now`, so runs can be repeated; each commits at most once and is tried again if another writer was first."""

    def __init__(self, spark: SparkSession, root: str, handlers: list[EventHandler] = (), config: EngineConfig | None = None, codecs: Codecs | None = None):
        self.spark, self.store, self.config, self.codecs = spark, SnapshotStore(spark, root), config or EngineConfig(), codecs or Codecs()
        self.handlers = {h.event_type: h for h in handlers}
        self._metrics: tuple | None = None

    def publish(self, pending: DataFrame, now: datetime) -> int:
        """Inserts all or nothing: an id that exists, or comes twice, raises."""

        def step(store, base):
            change = X.publish(store.read("events", base), pending, now)
            clash = change.archive.select("id").union(pending.groupBy("id").count().where("count > 1").select("id")).head(1)
            if clash:
                raise ValueError(f"event {clash[0]['id']} exists")
            return {}, {"events": change.returned}, change.returned.count()

        return self.store.transact(step)

    def claim(self, event_type: str, now: datetime, limit: int | None = None) -> DataFrame:
        """Claims and commits; returns the claimed rows as committed, with `coalesced`."""
        stamp = F.lit(now).cast("timestamp_ntz")

        def step(store, base):
            hot = store.read("events", base)
            change = X.claim(hot, event_type, limit or self.config.batch, self.config.worker, now, archive=self.config.archive)
            if not X.due(hot, event_type, now).head(1):
                return {}, {}, None
            return {"events": change.hot}, {"event_archive": change.archive} if change.archive is not None else {}, base

        base = self.store.transact(step)
        live = self.store.read("events").where((F.col("status") == "PROCESSING") & (F.col("claimed_by") == self.config.worker) & (F.col("claimed_at") == stamp) & (F.col("event_type") == event_type))
        if base is None:
            return live.limit(0).withColumn("coalesced", F.array().cast("array<struct<id:string,trace:string>>"))
        # the same choice again from the state it was made on, which is kept: nothing is cached
        returned = X.claim(self.store.read("events", base), event_type, limit or self.config.batch, self.config.worker, now).returned
        return live.join(returned.select("id", "coalesced"), "id").select(*live.columns, "coalesced").orderBy(*X.claim_order())

    def finalize(self, outcomes: DataFrame, now: datetime) -> dict[str, int]:
        """Routes outcomes and commits all of a batch at once. A row that was lost meanwhile changes nothing."""
        o = self.route(outcomes, now).persist()
        try:

            def step(store, base):
                done = X.settle(store.read("events", base), o, now, self.config.worker if self.config.archive else None)
                seen = o.select(
                    F.lit(None).cast("long").alias("seq"), "event_type", (F.col("attempts") + 1).alias("attempt"), F.col("claimed_by").alias("worker_id"), "thread", F.lit(None).cast("string").alias("lock_key"), F.col("id").alias("dedup_key"),
                    F.timestamp_micros("started_us").cast("timestamp_ntz").alias("started_at"), F.timestamp_micros("finished_us").cast("timestamp_ntz").alias("finished_at"), F.col("kind").alias("outcome"),
                )
                more = {"handled": seen} | ({"event_archive": done.archive} if done.archive is not None else {})
                return {"events": done.hot}, more, {r["route"]: r["count"] for r in o.groupBy("route").count().collect()}

            return self.store.transact(step)
        finally:
            o.unpersist()

    def route(self, outcomes: DataFrame, now: datetime) -> DataFrame:
        """Adds route, reason and next_run (`policy.route`)."""
        c = self.config
        return route(outcomes, now, c.default_policy, c.policies, c.unknown, c.unknown_delay_ms)

    def _lock(self, claimed: DataFrame, key: str, now: datetime) -> DataFrame:
        """Adds held: whether the row's key is leased to it. Of several rows of one key the first in claim order asks; rows without a key need no lease."""
        token = F.concat_ws(":", F.lit(self.config.worker), F.col("id"), F.col("version").cast("string"))
        rows = claimed.withColumn("_token", token)
        first = rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*X.claim_order()))).where("_n = 1")
        wanted = first.select(F.col(key).alias("lock_key"), F.col("_token").alias("owner_token"), F.lit(self.config.worker).alias("owner_worker"))

        def step(store, base):
            change = R.lease_acquire(store.read("entity_locks", base), wanted, now, self.config.lock_seconds)
            return {"entity_locks": change.hot}, {}, None

        self.store.transact(step)
        mine = self.store.read("entity_locks").where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz")).select(F.col("owner_token").alias("_token"), F.lit(True).alias("_got"))
        return rows.join(mine, "_token", "left").withColumn("held", F.col(key).isNull() | F.coalesce("_got", F.lit(False))).drop("_got")

    def _unlock(self, claimed: DataFrame, key: str) -> None:
        tokens = claimed.select(F.col(key).alias("lock_key"), F.concat_ws(":", F.lit(self.config.worker), F.col("id"), F.col("version").cast("string")).alias("owner_token"))
        self.store.transact(lambda s, v: ({"entity_locks": R.lease_release(s.read("entity_locks", v), tokens).hot}, {}, None))

    def owned(self, claimed: DataFrame) -> DataFrame:
        """The claimed rows that still are this worker's in the newest state: a claim that was swept or reclaimed meanwhile isn't handled."""
        now = self.store.read("events").where("status = 'PROCESSING'").select("id", "version", "claimed_by")
        return claimed.join(now, ["id", "version", "claimed_by"], "left_semi").select(*claimed.columns)

    def tick(self, event_type: str, now: datetime, limit: int | None = None, lock_key: str | None = None, entity_locks: bool = False) -> dict[str, int]:
        """One round: claim, recheck ownership, run the handlers, finalize. Returns how many rows went each way.

        `lock_key` names a column: its rows run in one task one after the other. With `entity_locks` each key is leased first, also against other
        workers; a row whose key is taken goes back, due a second later, without an attempt counted.
        """
        claimed = self.claim(event_type, now, limit)
        if not claimed.head(1):
            return {}
        ours = self.owned(claimed)
        if not (lock_key and entity_locks):
            return self.finalize(run_handlers(ours, self.handlers, self.codecs, lock_key=lock_key), now)
        asked = self._lock(ours, lock_key, now)
        try:
            ran = run_handlers(asked.where("held").select(*ours.columns), self.handlers, self.codecs, lock_key=lock_key)
            busy = asked.where("not held").select(*[F.col(c) for c in ("id", "version", "claimed_by", "event_type", "attempts")], F.lit("LOCK_BUSY").alias("kind"), F.concat(F.lit("lock busy: "), F.col(lock_key)).alias("reason"), *[F.lit(x).cast("long").alias(n) for n, x in (("delay_ms", self.config.lock_busy_ms), ("started_us", None), ("finished_us", None))], F.lit(None).cast("string").alias("thread"))
            return self.finalize(ran.union(busy.select(*ran.columns)), now)
        finally:
            self._unlock(asked.where("held"), lock_key)

    def drain(self, event_type: str, now: datetime, limit: int | None = None) -> int:
        """Ticks until nothing is due; returns the rounds taken. Ends: each tick claims due rows, and at `now` none of them comes back due unless a policy asks for no delay."""
        n = 0
        while self.tick(event_type, now, limit):
            n += 1
        return n

    def _rewrite(self, make, table: str = "events") -> int:
        def step(store, base):
            change = make(store, base)
            n = change.returned.count()
            return ({table: change.hot} if n else {}), {}, n

        return self.store.transact(step)

    def sweep_stale(self, now: datetime) -> int:
        return self._rewrite(lambda s, v: X.sweep_stale(s.read("events", v), now, self.config.stale_seconds, self.config.sweep_limit))

    def recover_orphans(self, now: datetime, limit: int = 50) -> int:
        """Frees what dead workers hold and removes them, in one commit."""

        def step(store, base):
            workers = store.read("workers", base)
            dead = R.dead_workers(workers, now, self.config.dead_seconds, limit)
            if not dead.head(1):
                return {}, {}, 0
            change = X.reclaim_orphans(store.read("events", base), dead, now)
            return {"events": change.hot, "workers": workers.join(dead.select("worker_id"), "worker_id", "left_anti")}, {}, change.returned.count()

        return self.store.transact(step)

    def register(self, workers: DataFrame, now: datetime) -> None:
        self.store.transact(lambda s, v: ({"workers": R.worker_upsert(s.read("workers", v), workers, now).hot}, {}, None))

    def heartbeat(self, now: datetime) -> bool:
        def step(store, base):
            change = R.heartbeat(store.read("workers", base), self.config.worker, now)
            found = bool(change.returned.head(1))
            return ({"workers": change.hot} if found else {}), {}, found

        return self.store.transact(step)

    def stop(self, now: datetime) -> int:
        """Graceful stop: claimed rows are released, then the worker goes."""
        n = self._rewrite(lambda s, v: X.release_claimed(s.read("events", v), self.config.worker, now))
        self.store.transact(lambda s, v: ({"workers": R.deregister(s.read("workers", v), self.config.worker).hot}, {}, None))
        return n

    def sweep_owned(self, now: datetime, working: DataFrame | None = None) -> int:
        """Gives back this worker's stale claims, without the ids in `working` (id) that it still handles."""
        none = self.store.read("events").select("id").limit(0)
        return self._rewrite(lambda s, v: X.sweep_owned(s.read("events", v), now, self.config.stale_seconds, self.config.sweep_limit, self.config.worker, working or none))

    def watchdog(self, now: datetime, runtimes: dict[str, int] | None = None) -> int:
        """Takes back what runs longer than its type may (seconds by type, else the configuration's); the guard on version makes a late outcome void."""
        most = F.lit(self.config.max_runtime_seconds)
        for event_type, seconds in (runtimes or {}).items():
            most = F.when(F.col("event_type") == event_type, F.lit(seconds)).otherwise(most)

        def make(store, base):
            hot = store.read("events", base)
            stuck = hot.where((F.col("status") == "PROCESSING") & (F.col("claimed_at") + F.make_dt_interval(secs=most) < F.lit(now).cast("timestamp_ntz")))
            return X.force_reclaim(hot, stuck.select("id", "version", "claimed_by"), now)

        return self._rewrite(make)

    def retention(self, now: datetime, archive_days: int | None = None, disabled_days: int | None = None) -> dict[str, int]:
        """Purges in batches until a batch comes back short, the archive first; a failure there doesn't keep the other from running and is raised at the end."""
        out, failed = {"archive": 0, "disabled": 0}, None
        for kind, days, purge in (("archive", archive_days, self.purge_archive), ("disabled", disabled_days, self.purge_disabled)):
            try:
                for _ in range(self.config.retention_batches if days is not None else 0):
                    n = purge(now - timedelta(days=days), self.config.retention_batch)
                    out[kind] += n
                    if n < self.config.retention_batch:
                        break
            except Exception as e:
                failed = failed or e
        if failed:
            raise failed
        return out

    # What an operator asks for

    def find(self, event_id: str) -> DataFrame:
        return self.store.read("events").where(F.col("id") == event_id)

    def find_in_archive(self, event_id: str) -> DataFrame:
        return self.store.read("event_archive").where(F.col("id") == event_id)

    def find_by_status(self, status: str, event_type: str | None = None, limit: int = 50, after: tuple | None = None) -> tuple[DataFrame, tuple | None]:
        """A page, newest first, past the cursor (created_at, id), and the next page's cursor, None where this one isn't full."""
        if limit <= 0:
            raise ValueError("limit must be positive")
        rows = self.store.read("events").where(F.col("status") == status)
        rows = rows.where(F.col("event_type") == event_type) if event_type else rows
        page = X.page_before(rows, limit, after)
        last = page.select("created_at", "id").orderBy("created_at", "id").limit(1).crossJoin(page.agg(F.count("*").alias("n"))).head(1)
        return page, (last[0]["created_at"], last[0]["id"]) if last and last[0]["n"] >= limit else None

    def reenable(self, event_id: str, now: datetime) -> bool:
        """True if the event was disabled and is due again."""

        def make(store, base):
            return X.reenable_all(store.read("events", base), None, now, 1, event_id=event_id)

        return self._rewrite(make) > 0

    def reenable_all(self, event_type: str, now: datetime, limit: int, created_before=None) -> int:
        return self._rewrite(lambda s, v: X.reenable_all(s.read("events", v), event_type, now, limit, created_before))

    def purge_disabled(self, older_than: datetime, limit: int, event_type: str | None = None) -> int:
        return self._rewrite(lambda s, v: X.purge_disabled(s.read("events", v), older_than, limit, event_type))

    def purge_archive(self, before: datetime, limit: int) -> int:
        return self._rewrite(lambda s, v: X.purge_archive(s.read("event_archive", v), before, limit), "event_archive")

    def replay_one(self, event_id: str, now: datetime) -> str:
        """REPLAYED, ID_IN_USE or NOT_FOUND."""

        def step(store, base):
            one = store.read("event_archive", base).where(F.col("id") == event_id)
            r = X.replay(store.read("events", base), one, None, now, 1)
            got = r.counts().first()
            if not got["replayed"]:
                return {}, {}, "ID_IN_USE" if got["id_in_use"] else "NOT_FOUND"
            rest = store.read("event_archive", base).where(F.col("id") != event_id)
            return {"events": r.hot, "event_archive": rest}, {}, "REPLAYED"

        return self.store.transact(step)

    def await_done(self, event_id: str, timeout: float, poll: float = 0.2) -> str:
        """COMPLETED once the event is gone from the hot table, DISABLED, or TIMED_OUT:<state>; reads the newest commit every `poll` seconds."""
        if timeout <= 0 or poll <= 0:
            raise ValueError("timeout and poll must be positive")
        end = time.monotonic() + timeout
        while True:
            state = self.state(event_id)
            if state in ("ARCHIVED", "ABSENT"):
                return "COMPLETED"
            if state == "DISABLED":
                return "DISABLED"
            left = end - time.monotonic()
            if left <= 0:
                return f"TIMED_OUT:{state}"
            time.sleep(min(poll, left))

    def metrics(self, refresh_seconds: float = 0.0) -> list:
        """Rows by type and status with the oldest due and claimed time; a snapshot younger than `refresh_seconds` is given again."""
        if not self._metrics or time.monotonic() - self._metrics[0] >= refresh_seconds:
            hot = self.store.read("events")
            rows = hot.groupBy("event_type", "status").agg(F.count("*").alias("n"), F.min("run_at").alias("oldest_run_at"), F.min("claimed_at").alias("oldest_claimed_at")).collect()  # a row for each type and status
            self._metrics = time.monotonic(), rows
        return self._metrics[1]

    def replay(self, event_type: str | None, now: datetime, limit: int, after=None, before=None, cursor=None) -> dict:
        """One page of the archive becomes due again; `next` is the cursor to go on with, None at the end."""

        def step(store, base):
            r = X.replay(store.read("events", base), store.read("event_archive", base), event_type, now, limit, after, before, cursor)
            got = r.counts().first()
            full = got["replayed"] + got["id_in_use"] >= limit
            result = {"replayed": got["replayed"], "id_in_use": got["id_in_use"], "next": (got["next_at"], got["next_id"]) if full else None}
            return ({"events": r.hot, "event_archive": r.archive} if got["replayed"] else {}), {}, result

        return self.store.transact(step)

    def state(self, event_id: str) -> str:
        """PENDING, PROCESSING, DISABLED, ARCHIVED or ABSENT."""
        version = self.store.version()
        hot = self.store.read("events", version).where(F.col("id") == event_id).select("status").head(1)
        if hot:
            return hot[0]["status"]
        return "ARCHIVED" if self.store.read("event_archive", version).where(F.col("id") == event_id).head(1) else "ABSENT"
