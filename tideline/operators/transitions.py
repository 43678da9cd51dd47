"""State transitions of the hot table: pure functions of DataFrames and a given time.

Each returns a `Change`: the hot table afterwards, the rows changed (as they are afterwards, or as
they were if deleted) and rows for the archive. Nothing is collected; a bounded choice is a top-k, ordered in
full so that it is the same on every run. Guards are joins on (id, version, claimed_by), so a lost race
changes nothing. Functions use the columns they need and carry all others through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COALESCED = "coalesced at claim"


@dataclass
class Change:
    hot: DataFrame
    returned: DataFrame
    archive: DataFrame | None = None


def _now(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")


def _set(rows: DataFrame, **new: Column | str | int | None) -> DataFrame:
    types = dict(rows.dtypes)
    made = {k: (v if isinstance(v, Column) else F.lit(v)) for k, v in new.items()}
    return rows.withColumns({k: v.cast(types[k]) if k in types else v for k, v in made.items()})


def _rewrite(hot: DataFrame, picked: DataFrame, extra: list[str] | None = None, **new) -> Change:
    """Rows of `hot` whose id is in `picked` (unique) get new values, which may use `picked`'s extra columns."""
    changed = _set(hot.join(picked.select("id", *(extra or [])), "id"), **new).select(*hot.columns)
    return Change(hot.join(picked.select("id"), "id", "left_anti").select(*hot.columns).unionByName(changed), changed)


def _delete(hot: DataFrame, ids: DataFrame) -> Change:
    return Change(hot.join(ids.select("id"), "id", "left_anti").select(*hot.columns), hot.join(ids.select("id"), "id", "left_semi").select(*hot.columns))


def due(hot: DataFrame, event_type: str, now) -> DataFrame:
    return hot.where((F.col("event_type") == event_type) & (F.col("status") == "PENDING") & (F.col("run_at") <= _now(now)))


def claim_order() -> list[Column]:
    return [F.desc("priority"), F.asc("run_at"), F.asc("id")]


def keep_first(picked: DataFrame) -> DataFrame:
    """The representative of each dedup key; rows without a key are not in it."""
    rank = F.row_number().over(W.partitionBy("dedup_key").orderBy(*claim_order()))
    return picked.where("dedup_key is not null").withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def duplicates(ready: DataFrame, keep: DataFrame, cap: int | None = 1000) -> DataFrame:
    """Due rows of the representatives' keys, within the batch or beyond it, without the representatives; the `cap` of least id."""
    k = keep.select(F.col("id").alias("_kept"), "dedup_key")
    out = ready.join(k, "dedup_key").where("id <> _kept").drop("_kept").select(*ready.columns)
    return out.orderBy("id").limit(cap) if cap else out


def swept_by_key(dup: DataFrame) -> DataFrame:
    """(dedup_key, coalesced): ids and trace contexts of what was swept, ordered by id. At most `cap` rows reach it."""
    trace = F.col("trace_context") if "trace_context" in dup.columns else F.lit(None).cast("map<string,string>")
    return dup.groupBy("dedup_key").agg(F.array_sort(F.collect_list(F.struct("id", F.to_json(trace).alias("trace")))).alias("coalesced"))


def claim(hot: DataFrame, event_type: str, limit: int, worker: str, now, cap: int = 1000, archive: bool = False) -> Change:
    """Claims up to `limit` due rows by priority, then time, and sweeps due duplicates of their keys.

    A batch's picks come from one top-k; duplicates that the cap left are claimed as rows of their own and carry
    the same coalesced list. Rows come back in claim order.
    """
    ready = due(hot, event_type, now)
    picked = ready.orderBy(*claim_order()).limit(limit)
    dup = duplicates(ready, keep_first(picked), cap)
    gone = dup.select("id")
    took = picked.join(gone, "id", "left_anti").select(*hot.columns)
    returned = _set(took, status="PROCESSING", claimed_by=worker, claimed_at=_now(now), version=F.col("version") + 1)
    after = hot.join(gone.union(took.select("id")), "id", "left_anti").select(*hot.columns).unionByName(returned)
    with_swept = returned.join(swept_by_key(dup), "dedup_key", "left").select(*hot.columns, "coalesced").orderBy(*claim_order())
    return Change(after, with_swept, archived(dup, now, worker, COALESCED) if archive else None)


def archived(rows: DataFrame, now, worker: str, reason: str | None = None) -> DataFrame:
    out = rows.drop("status", "version", "claimed_by", "claimed_at").withColumn("archived_at", _now(now)).withColumn("archived_by", F.lit(worker))
    return out.withColumn("last_fail_reason", F.lit(reason)) if reason else out


def guarded(hot: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks (id, version, claimed_by, …) that still own their row."""
    own = hot.where("status = 'PROCESSING'").select("id", "version", "claimed_by")
    return marks.join(own, ["id", "version", "claimed_by"], "left_semi").dropDuplicates(["id"])


def mark_processed(hot: DataFrame, marks: DataFrame, now=None, worker: str | None = None) -> Change:
    """Deletes owned rows; with a worker, also moves them to the archive."""
    out = _delete(hot, guarded(hot, marks))
    if worker is not None:
        out.archive = archived(out.returned, now, worker)
    return out


_FREE = {"status": "PENDING", "claimed_by": None, "claimed_at": None}
_MAX_REASON = 10_000


def _bump() -> dict:
    return {"version": F.col("version") + 1}


def mark_retry(hot: DataFrame, marks: DataFrame) -> Change:
    """marks also have reason and next_run: a failed attempt, tried again then."""
    m = guarded(hot, marks)
    return _rewrite(hot, m, ["reason", "next_run"], **_FREE, attempts=F.col("attempts") + 1, **_bump(), run_at=F.col("next_run"), last_fail_reason=F.substring("reason", 1, _MAX_REASON))


def release(hot: DataFrame, marks: DataFrame) -> Change:
    """Like mark_retry, but no attempt is counted."""
    m = guarded(hot, marks)
    return _rewrite(hot, m, ["reason", "next_run"], **_FREE, **_bump(), run_at=F.col("next_run"), last_fail_reason=F.substring("reason", 1, _MAX_REASON))


def release_claimed(hot: DataFrame, worker: str, now) -> Change:
    rows = hot.where((F.col("status") == "PROCESSING") & (F.col("claimed_by") == worker))
    return _rewrite(hot, rows, **_FREE, **_bump(), run_at=_now(now), last_fail_reason="released: worker shutdown")


def mark_disabled(hot: DataFrame, marks: DataFrame) -> Change:
    m = guarded(hot, marks)
    return _rewrite(hot, m, ["reason"], **(_FREE | {"status": "DISABLED"}), **_bump(), last_fail_reason=F.substring("reason", 1, _MAX_REASON))


ROUTES = ("delete", "retry", "release", "disable")


def settle(hot: DataFrame, marks: DataFrame, now=None, worker: str | None = None) -> Change:
    """mark_processed, mark_retry, release and mark_disabled at once, by the marks' `route`: one join with `hot`.

    Of several marks for one claim the first route in ROUTES counts. Marks that no longer own their row change
    nothing; a null owner owns nothing. `returned` has the deleted rows as they were.
    """
    rank = F.array_position(F.array(*map(F.lit, ROUTES)), F.col("route"))
    one = marks.where(F.col("route").isin(*ROUTES)).groupBy("id", "version", "claimed_by").agg(F.min(F.struct(rank.alias("rank"), "route", F.substring("reason", 1, _MAX_REASON).alias("reason"), "next_run")).alias("_mark"))
    m = one.select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("claimed_by").alias("_by"), "_mark")
    owned = (F.col("id") == F.col("_id")) & (F.col("version") == F.col("_version")) & (F.col("claimed_by") == F.col("_by")) & (F.col("status") == "PROCESSING")
    route, marked, again = F.col("_mark.route"), F.col("_mark").isNotNull(), F.col("_mark.route").isin("retry", "release")
    new = {
        "status": F.when(route == "disable", "DISABLED").when(again, "PENDING").otherwise(F.col("status")),
        "claimed_by": F.when(~marked, F.col("claimed_by")), "claimed_at": F.when(~marked, F.col("claimed_at")),
        "version": F.when(marked, F.col("version") + 1).otherwise(F.col("version")), "attempts": F.when(route == "retry", F.col("attempts") + 1).otherwise(F.col("attempts")),
        "run_at": F.when(again, F.col("_mark.next_run")).otherwise(F.col("run_at")), "last_fail_reason": F.when(marked, F.col("_mark.reason")).otherwise(F.col("last_fail_reason")),
    }
    after = _set(hot.join(m, owned, "left").where(F.coalesce(route != "delete", F.lit(True))), **new).select(*hot.columns)
    gone = hot.join(m.where(route == "delete"), owned, "left_semi").select(*hot.columns)
    return Change(after, gone, archived(gone, now, worker) if worker is not None else None)


def force_reclaim(hot: DataFrame, marks: DataFrame, now) -> Change:
    return _rewrite(hot, guarded(hot, marks), **_FREE, attempts=F.col("attempts") + 1, **_bump(), run_at=_now(now), last_fail_reason="stuck: handler exceeded handlerMaxRuntime")


def _stale(hot: DataFrame, now, seconds: int) -> DataFrame:
    return hot.where((F.col("status") == "PROCESSING") & (F.col("claimed_at") < _now(now) - F.make_dt_interval(secs=F.lit(seconds))))


def sweep_stale(hot: DataFrame, now, seconds: int, limit: int, reason: str = "swept: stale PROCESSING claim") -> Change:
    return _rewrite(hot, _stale(hot, now, seconds).orderBy("id").limit(limit), **_FREE, attempts=F.col("attempts") + 1, **_bump(), run_at=_now(now), last_fail_reason=reason)


def sweep_owned(hot: DataFrame, now, seconds: int, limit: int, worker: str, protected: DataFrame, reason: str = "swept: abandoned local claim") -> Change:
    """Stale rows of one worker, oldest first, without ids it still works on."""
    rows = _stale(hot, now, seconds).where(F.col("claimed_by") == worker).join(protected.select("id"), "id", "left_anti").select(*hot.columns).orderBy("claimed_at", "id").limit(limit)
    return _rewrite(hot, rows, **_FREE, attempts=F.col("attempts") + 1, **_bump(), run_at=_now(now), last_fail_reason=reason)


def reclaim_orphans(hot: DataFrame, dead: DataFrame, now) -> Change:
    """Rows that dead workers (worker_id) hold become due again."""
    rows = hot.where("status = 'PROCESSING'").join(dead.select(F.col("worker_id").alias("claimed_by")), "claimed_by", "left_semi")
    reason = F.concat(F.lit("orphan-recovered: worker "), F.col("claimed_by"), F.lit(" was stale"))
    out = _rewrite(hot, rows.select("id", reason.alias("_why")), ["_why"], **_FREE, attempts=F.col("attempts") + 1, **_bump(), run_at=_now(now), last_fail_reason=F.col("_why"))
    return out


def publish(hot: DataFrame, pending: DataFrame, now) -> Change:
    """Inserts; ids that exist already are left out and come back in `archive` as conflicts. Publishing in `store` raises on them."""
    fresh = pending.join(hot.select("id"), "id", "left_anti").select(*pending.columns)
    row = fresh.withColumns({"status": F.lit("PENDING"), "attempts": F.lit(0), "version": F.lit(0).cast("long"), "created_at": _now(now), "run_at": F.coalesce("run_at", _now(now))})
    for name, kind in hot.dtypes:
        row = row.withColumn(name, (F.col(name) if name in row.columns else F.lit(None)).cast(kind))
    row = row.select(*hot.columns)
    return Change(hot.unionByName(row), row, pending.join(hot.select("id"), "id", "left_semi"))


def page_before(rows: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """The newest `limit` rows past the cursor (created_at, id), newest first."""
    if after:
        rows = rows.where(F.struct("created_at", "id") < F.struct(_now(after[0]).alias("created_at"), F.lit(after[1]).alias("id")))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def reenable_all(hot: DataFrame, event_type: str | None, now, limit: int, created_before=None, event_id=None) -> Change:
    rows = hot.where("status = 'DISABLED'")
    rows = rows.where(F.col("id") == event_id) if event_id is not None else rows
    rows = rows.where(F.col("event_type") == event_type) if event_type else rows
    rows = rows.where(F.col("created_at") < _now(created_before)) if created_before is not None else rows
    return _rewrite(hot, rows.orderBy("id").limit(limit), status="PENDING", attempts=0, **_bump(), run_at=_now(now), last_fail_reason="reenabled by operator")


def purge_disabled(hot: DataFrame, older_than, limit: int, event_type: str | None = None) -> Change:
    rows = hot.where((F.col("status") == "DISABLED") & (F.col("created_at") < _now(older_than)))
    rows = rows.where(F.col("event_type") == event_type) if event_type else rows
    return _delete(hot, rows.orderBy("id").limit(limit))


def purge_archive(archive: DataFrame, before, limit: int) -> Change:
    return _delete(archive, archive.where(F.col("archived_at") < _now(before)).orderBy("id").limit(limit))


@dataclass
class Replay:
    hot: DataFrame
    archive: DataFrame
    inserted: DataFrame
    blocked: DataFrame
    considered: DataFrame

    def counts(self) -> DataFrame:
        """One row: replayed, id_in_use, next_at, next_id (the cursor: the last row considered)."""
        tagged = self.considered.join(self.blocked.select("id", F.lit(1).alias("_b")), "id", "left")
        last = F.max(F.struct("archived_at", "id"))
        return tagged.agg(F.count(F.when(F.col("_b").isNull(), 1)).alias("replayed"), F.count("_b").alias("id_in_use"), last["archived_at"].alias("next_at"), last["id"].alias("next_id"))


def replay(hot: DataFrame, archive: DataFrame, event_type: str | None, now, limit: int, after=None, before=None, cursor: tuple | None = None) -> Replay:
    """Archived rows in the open window, by (archived_at, id) past the cursor, become new events; rows whose id is live stay archived."""
    if after is not None and before is not None and str(after) >= str(before):
        raise ValueError("after must be before before")
    rows = archive
    rows = rows.where(F.col("event_type") == event_type) if event_type else rows
    rows = rows.where(F.col("archived_at") > _now(after)) if after is not None else rows
    rows = rows.where(F.col("archived_at") < _now(before)) if before is not None else rows
    if cursor:
        rows = rows.where(F.struct("archived_at", "id") > F.struct(_now(cursor[0]).alias("archived_at"), F.lit(cursor[1]).alias("id")))
    src = rows.orderBy("archived_at", "id").limit(limit)
    blocked = src.join(hot.select("id"), "id", "left_semi").select(*archive.columns)
    moved = src.join(hot.select("id"), "id", "left_anti").select(*archive.columns)
    fresh = moved.drop("archived_at", "archived_by").withColumns({"status": F.lit("PENDING"), "attempts": F.lit(0), "version": F.lit(0).cast("long"), "created_at": _now(now), "run_at": _now(now), "last_fail_reason": F.lit(None).cast("string")})
    for name, kind in hot.dtypes:
        fresh = fresh.withColumn(name, (F.col(name) if name in fresh.columns else F.lit(None)).cast(kind))
    fresh = fresh.select(*hot.columns)
    return Replay(hot.unionByName(fresh), archive.join(moved.select("id"), "id", "left_anti").select(*archive.columns), fresh, blocked, src)
