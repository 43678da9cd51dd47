"""Queries of state transitions: Spark runs the engine's functions, the oracle an SQL text of what they should change."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fixture
from ..functions import scalar
from ..operators import registry as R
from ..operators import reports
from ..operators import transitions as X
from ..policy import FailurePolicy, route
from .reads import _HASH
from .scenarios import PRESETS

NOW = datetime(2024, 1, 20)
COLS = ["id", "status", "attempts", "version", "run_at", "claimed_by", "last_fail_reason"]
_CLAIM = """WITH picked AS (SELECT * FROM obx_events WHERE event_type = 'click' AND status = 'PENDING' AND run_at <= {NOW} ORDER BY priority DESC, run_at, id LIMIT 50),
keep AS (SELECT id, dedup_key FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY priority DESC, run_at, id) AS rn FROM picked WHERE dedup_key IS NOT NULL) k WHERE rn = 1),
dup AS (SELECT d.* FROM obx_events d JOIN keep k ON d.dedup_key = k.dedup_key AND d.id <> k.id WHERE d.event_type = 'click' AND d.status = 'PENDING' AND d.run_at <= {NOW} ORDER BY d.id LIMIT 1000),
swept AS (SELECT dedup_key, count(*) AS n, JOIN[id|id] AS ids FROM dup GROUP BY dedup_key),
took AS (SELECT p.*, s.n, s.ids FROM picked p LEFT JOIN swept s ON p.dedup_key = s.dedup_key WHERE p.id NOT IN (SELECT id FROM dup)) """
_OUT = "SELECT {x} FROM obx_events WHERE {w}"
_OWN = "marks m JOIN obx_events e ON e.id = m.id AND e.version = m.version AND e.claimed_by = m.claimed_by AND e.status = 'PROCESSING'"
_REPLAY = """WITH src AS (SELECT * FROM obx_archive WHERE event_type = 'purchase' AND archived_at > CAST('1995-01-01' AS DATE) AND archived_at < CAST('1997-01-01' AS DATE) ORDER BY archived_at, id LIMIT 100) """


def _hot(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "obx_events").withColumn("last_fail_reason", F.lit(None).cast("string"))


def _claim(spark, d, **more):
    return X.claim(_hot(spark, d), "click", 50, "w-0", NOW, **more)


def _replay(spark, d):
    return X.replay(_hot(spark, d), fixture(spark, d, "obx_archive"), "purchase", NOW, 100, datetime(1995, 1, 1), datetime(1997, 1, 1))


def _freed(where: str, reason: str, attempts: str = "attempts + 1", tail: str = "") -> str:
    return f"SELECT id, 'PENDING' AS status, {attempts} AS attempts, version + 1 AS version, {{NOW}} AS run_at, CAST(NULL AS STRING) AS claimed_by, {reason} AS last_fail_reason FROM obx_events WHERE {where} {tail}"


def _marked(status: str, attempts: str, run_at: str, reason: str) -> str:
    return f"SELECT e.id, '{status}' AS status, {attempts} AS attempts, e.version + 1 AS version, {run_at} AS run_at, CAST(NULL AS STRING) AS claimed_by, {reason} AS last_fail_reason FROM {_OWN}"


def _ready(spark, d):
    return X.due(_hot(spark, d), "click", NOW)


def _picked(spark, d):
    return _ready(spark, d).orderBy(*X.claim_order()).limit(50)


def _dups(spark, d):
    return X.duplicates(_ready(spark, d), X.keep_first(_picked(spark, d)))


def _ids(column="coalesced"):
    return F.array_join(F.transform(column, lambda s: s["id"].cast("string")), ",")


def _new_rows(spark, d):
    return spark.sql("SELECT id, CAST(id % 3 AS INT) AS priority, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'other' END AS event_type, CAST(NULL AS TIMESTAMP_NTZ) AS run_at FROM (SELECT explode(sequence(9990L, 1000090L, 100L)) AS id)")


def _workers_new(spark):
    return spark.sql("SELECT 'w-' || CAST(i AS STRING) AS worker_id, 'host-' || CAST(i AS STRING) AS host FROM (SELECT explode(sequence(20, 30)) AS i)")


def _wanted(spark, d):
    return fixture(spark, d, "obx_locks").where("substr(lock_key, length(lock_key)) in ('0', '5')").select("lock_key", F.lit("t-new").alias("owner_token"), F.lit("w-9").alias("owner_worker"))


def _tokens(spark, d):
    last = F.expr("substr(lock_key, length(lock_key))")
    return fixture(spark, d, "obx_locks").where(last.isin("1", "2")).select("lock_key", F.when(last == "1", F.col("owner_token")).otherwise(F.lit("t-wrong")).alias("owner_token"))


def _marks(spark, d):
    return fixture(spark, d, "marks")


def _peak(spark: SparkSession, d: str) -> DataFrame:
    """Peak of open intervals, by buckets of ten seconds: each bucket's own running sum over what the ones before it left open, so no task sees all rows."""
    from pyspark.sql import Window as W

    led = fixture(spark, d, "ledger")
    moves = led.select(F.col("started_at").alias("at"), F.lit(1).alias("d")).unionAll(led.select("finished_at", F.lit(-1)))
    moves = moves.groupBy("at").agg(F.sum("d").alias("net"), F.sum(F.least("d", F.lit(0))).alias("ends")).withColumn("b", F.date_trunc("minute", "at"))
    net = moves.groupBy("b").agg(F.sum("net").alias("n"))
    carry = net.select("b", (F.sum("n").over(W.orderBy("b")) - F.col("n")).alias("carry"))
    # ends of a moment come before its starts, so the highest point of a moment is after all its moves
    return moves.withColumn("run", F.sum("net").over(W.partitionBy("b").orderBy("at"))).join(carry, "b").agg(F.max(F.col("run") + F.col("carry")).alias("peak"))


_STATEMENTS = (
    "WITH  picked AS (SELECT 1)", "INSERT INTO s.events  VALUES (1)", "DELETE FROM s.events e USING (VALUES (1)) v", "DELETE   FROM s.events WHERE id = $1",
    "UPDATE s.events SET status = $1,  attempts = attempts + 1, run_at = $2", "UPDATE s.events e SET status = $1, run_at = $2", "UPDATE s.events SET status = $1, last_fail_reason = $2",
    "UPDATE s.events SET status = $1, attempts = attempts + 1 WHERE id IN (SELECT id FROM s.events)", "WITH d AS (DELETE FROM s.events) INSERT INTO s.event_archive SELECT 1", "  with d as (select 1) insert into s.event_archive values (1)", "UPDATE s.workers SET x = 1", "SELECT 1",
)
_KINDS = ("claim", "insert", "finalizeBatch", "finalizeSingle", "retry", "release", "disabled", "other", "finalizeSingle", "finalizeBatch", "other", "other")


def _carriers(spark, d):
    """(id, carrier, deferred): a carrier for every other event, marked where the event is due a minute after it was made."""
    rows = fixture(spark, d, "obx_events").select("id", (F.timestamp_diff("MICROSECOND", "created_at", "run_at") > 60_000_000).alias("deferred"))
    empty = F.create_map().cast("map<string,string>")
    carrier = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("trace"), F.concat(F.lit("u-"), (F.col("id") % 100).cast("string")))).otherwise(empty)
    return rows.withColumn("carrier", F.when(F.col("deferred"), scalar.mark_trace(carrier)).otherwise(carrier))


def _text(m):
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


_PLAIN = "CASE WHEN id % 2 = 0 THEN 'trace=u-' || CAST(id % 100 AS STRING) ELSE '' END"
_LINKED = "US[created_at|run_at] > 60000000 AND id % 2 = 0"


def _outcomes(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("SUCCESS", "SKIP", "RETRY", "FAIL", "UNKNOWN", "LOCK_BUSY"))), (F.col("id") % 6 + 1).cast("int"))
    rows = fixture(spark, d, "obx_events").where("status = 'PROCESSING'")
    return rows.select("id", "event_type", "attempts", kind.alias("kind"), F.lit("why").alias("reason"), F.when(F.col("id") % 9 == 0, 1500).cast("long").alias("delay_ms"))


def _decided(spark, d):
    decision, delay = FailurePolicy(jitter=0).decide(F.col("attempts"), F.col("delay_ms"))
    return _outcomes(spark, d).select("id", decision.alias("decision"), delay.alias("delay_ms"))


def _statements(spark, d):
    n = len(_STATEMENTS)
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.element_at(F.array(*map(F.lit, _STATEMENTS)), (F.col("event_id") % n + 1).cast("int")).alias("q"), (F.col("event_id") % 10).alias("calls"), (F.col("event_id") % 30).alias("n_rows"), (F.col("event_id") % 7).alias("ms"))
    sums = rows.groupBy(scalar.statement_kind(F.col("q"), "s.events").alias("kind")).agg(F.count("*").alias("statements"), *[F.sum(c).cast("long").alias(c) for c in ("calls", "n_rows", "ms")])
    return sums.select("kind", "statements", "calls", "n_rows", "ms", scalar.rate(F.col("ms"), F.col("calls")).alias("mean_ms"), scalar.rate(F.col("n_rows"), F.col("calls")).alias("rows_per_call"))


def _writes(spark, d):
    """Counters of two moments and what was written between them."""
    rows = fixture(spark, d, "obx_events")
    at = lambda when: rows.where(F.col("created_at") <= F.lit(when).cast("timestamp_ntz")).agg(F.count("*").alias("inserts"), F.coalesce(F.sum("version"), F.lit(0)).cast("long").alias("updates"), F.count(F.when(F.col("status") == "DISABLED", 1)).alias("deletes"))
    return reports.deltas(at(datetime(2024, 1, 10)), at(NOW), ["inserts", "updates", "deletes"])


def _ratios(spark, d):
    led, pub = fixture(spark, d, "ledger"), fixture(spark, d, "publishes")
    return reports.ratios(led, pub)


S = lambda change: change.returned.select(*COLS)
STALE = "status = 'PROCESSING' AND claimed_at < {NOW} - INTERVAL '10' DAY"
DEAD = "SELECT worker_id, last_heartbeat FROM obx_workers WHERE last_heartbeat < {NOW} - INTERVAL '30' SECOND OR graceful_stop ORDER BY last_heartbeat, worker_id LIMIT 50"
_FATE = "CASE WHEN attempts + 1 >= 10 THEN 'DISABLE' ELSE 'RETRY' END"
_BACKOFF = "CAST(least(5000 * pow(2.0, attempts), 3600000) AS BIGINT)"
_OUTCOMES = "(SELECT id, attempts, CASE id % 6 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'SKIP' WHEN 2 THEN 'RETRY' WHEN 3 THEN 'FAIL' WHEN 4 THEN 'UNKNOWN' ELSE 'LOCK_BUSY' END AS kind, CASE WHEN id % 9 = 0 THEN 1500 END AS own FROM obx_events WHERE status = 'PROCESSING') o"
_KIND_OF = "CASE event_id % " + str(len(_KINDS)) + " " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_COUNTS = "SELECT count(*) AS i, coalesce(CAST(sum(version) AS BIGINT), 0) AS u, count(*) FILTER (WHERE status = 'DISABLED') AS x FROM obx_events"
#: name: (Spark, SQL)
MUTATIONS = {
    "span_attributes": (
        lambda s, d: _carriers(s, d).select("id", scalar.propagation(F.col("carrier")).alias("relation"), F.lit("CONSUMER").alias("kind")),
        f"SELECT id, CASE WHEN {_LINKED} THEN 'link' ELSE 'child' END AS relation, 'CONSUMER' AS kind FROM obx_events",
    ),
    "trace_marker": (
        lambda s, d: _carriers(s, d).select("id", _text(F.col("carrier")).alias("marked"), _text(scalar.strip_trace(F.col("carrier"))).alias("stripped")),
        f"SELECT id, CASE WHEN {_LINKED} THEN 'event_outboxer.propagation=link,' ELSE '' END || {_PLAIN} AS marked, {_PLAIN} AS stripped FROM obx_events",
    ),
    "advisory_hash": (
        lambda s, d: fixture(s, d, "obx_locks").select("lock_key", scalar.advisory_hash(F.col("lock_key")).alias("hash")),
        "SELECT lock_key, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash FROM (SELECT lock_key, HEX8[substr(sha256(lock_key), 1, 16)] AS h FROM obx_locks) x",
    ),
    "statement_stats": (
        _statements,
        f"SELECT kind, count(*) AS statements, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(ms) AS BIGINT) AS ms, CASE WHEN sum(calls) > 0 THEN sum(ms) / sum(calls) ELSE 0.0 END AS mean_ms, CASE WHEN sum(calls) > 0 THEN sum(n_rows) / sum(calls) ELSE 0.0 END AS rows_per_call FROM (SELECT {_KIND_OF} AS kind, event_id % 10 AS calls, event_id % 30 AS n_rows, event_id % 7 AS ms FROM events) s GROUP BY kind",
    ),
    "failure_decisions": (_decided, f"SELECT id, {_FATE} AS decision, CASE WHEN attempts + 1 < 10 THEN coalesce(own, {_BACKOFF}) END AS delay_ms FROM {_OUTCOMES}"),
    "route_outcomes": (
        lambda s, d: route(_outcomes(s, d), NOW, FailurePolicy(jitter=0), unknown="FAIL").select("id", "kind", "route", "next_run"),
        f"SELECT id, kind, CASE WHEN kind IN ('SUCCESS', 'SKIP') THEN 'delete' WHEN kind = 'FAIL' THEN 'disable' WHEN kind = 'LOCK_BUSY' THEN 'release' WHEN kind = 'UNKNOWN' THEN 'leave' WHEN {_FATE} = 'RETRY' THEN 'retry' ELSE 'disable' END AS route,"
        f" {{NOW}} + INTERVAL '0.001' SECOND * CAST(CASE WHEN kind = 'UNKNOWN' THEN 60000 WHEN kind = 'LOCK_BUSY' THEN own WHEN attempts + 1 < 10 THEN coalesce(own, {_BACKOFF}) ELSE 0 END AS INT) AS next_run FROM {_OUTCOMES}",
    ),
    "write_counter_deltas": (_writes, f"SELECT b.i - a.i AS inserts, b.u - a.u AS updates, b.x - a.x AS deletes, b.i + b.u + b.x - a.i - a.u - a.x AS total FROM ({_COUNTS} WHERE created_at <= CAST('2024-01-10' AS DATE)) a CROSS JOIN ({_COUNTS}) b"),
    "run_ratios": (
        _ratios,
        "SELECT handled, published, CASE WHEN span > 0 THEN handled / span ELSE 0.0 END AS handled_per_s, CASE WHEN published > 0 THEN runs / published ELSE 0.0 END AS runs_per_event, CASE WHEN published > 0 THEN (published - handled) / published ELSE 0.0 END AS coalesced_share FROM"
        " (SELECT count(DISTINCT CASE WHEN outcome = 'SUCCESS' THEN seq END) AS handled, CAST(count(*) AS DOUBLE) AS runs, US[min(started_at)|max(finished_at)] / 1000000.0 AS span FROM ledger) l CROSS JOIN (SELECT count(*) AS published FROM publishes) p",
    ),
    "run_report": (
        lambda s, d: reports.latency(fixture(s, d, "ledger"), fixture(s, d, "publishes")),
        "SELECT count(*) AS n, floor(DISC[0.5|us] + 0.5) / 1000 AS p50_ms, floor(DISC[0.95|us] + 0.5) / 1000 AS p95_ms, floor(DISC[0.99|us] + 0.5) / 1000 AS p99_ms, floor(max(us) + 0.5) / 1000 AS max_ms FROM"
        " (SELECT greatest(0, US[p.published_at|f.first_at]) AS us FROM publishes p JOIN (SELECT seq, min(finished_at) AS first_at FROM ledger WHERE outcome = 'SUCCESS' GROUP BY seq) f ON p.seq = f.seq) l",
    ),
    "scenario_dedup_burst": (
        lambda s, d: PRESETS["dedup-burst"].assignment(s).groupBy("dedup_key").agg(F.count("*").alias("n")),
        "SELECT 'dedup-' || CAST(i % 64 AS STRING) AS dedup_key, count(*) AS n FROM (SELECT unnest(range(20000)) AS i) r GROUP BY 1",
    ),
    "scenario_failures": (
        lambda s, d: PRESETS["failures"].assignment(s).where("fails").select("seq", "event_type"),
        f"SELECT seq, 'type-0' AS event_type FROM (SELECT unnest(range(5000)) AS seq) r WHERE {_HASH.format(1, 1048576)} % 1000 < 100",
    ),
    "invariant_samples": (lambda s, d: reports.samples(fixture(s, d, "ledger").where("attempt > 1"), ["seq", "attempt"]), "SELECT seq, attempt FROM ledger WHERE attempt > 1 ORDER BY seq, attempt LIMIT 20"),
    "in_flight_by_type": (
        lambda s, d: reports.in_flight(fixture(s, d, "obx_events"), NOW, 864000),
        "SELECT event_type, count(*) AS in_flight, count(*) FILTER (WHERE claimed_at + INTERVAL '10' DAY < {NOW}) AS abandoned FROM obx_events WHERE status = 'PROCESSING' GROUP BY event_type",
    ),
    "find_by_status": (lambda s, d: X.page_before(_hot(s, d).where("status = 'DISABLED' and event_type = 'click'"), 15, (datetime(2024, 1, 15), 0)).select("id", "created_at"), "SELECT id, created_at FROM obx_events WHERE status = 'DISABLED' AND event_type = 'click' AND created_at < CAST('2024-01-15' AS DATE) ORDER BY created_at DESC, id DESC LIMIT 15"),
    "claim_keep": (lambda s, d: X.keep_first(_picked(s, d)).select("id", "dedup_key"), _CLAIM + "SELECT id, dedup_key FROM keep"),
    "claim_dups": (lambda s, d: _dups(s, d).select("id", "dedup_key"), _CLAIM + "SELECT id, dedup_key FROM dup"),
    "claim_swept": (lambda s, d: X.swept_by_key(_dups(s, d)).select("dedup_key", F.size("coalesced").cast("long").alias("n"), _ids().alias("ids")), _CLAIM + "SELECT dedup_key, n, ids FROM swept"),
    "claim_result": (
        lambda s, d: _claim(s, d).returned.select("id", "priority", "dedup_key", "status", "claimed_by", "version", F.coalesce(F.size("coalesced"), F.lit(0)).cast("long").alias("n_coalesced"), _ids().alias("coalesced_ids")),
        _CLAIM + "SELECT id, priority, dedup_key, 'PROCESSING' AS status, 'w-0' AS claimed_by, version + 1 AS version, coalesce(n, 0) AS n_coalesced, ids AS coalesced_ids FROM took",
    ),
    "claim_post_state": (
        lambda s, d: _claim(s, d).hot.select("id", "status", "version", "claimed_by"),
        _CLAIM + "SELECT id, status, version, claimed_by FROM obx_events WHERE id NOT IN (SELECT id FROM dup) AND id NOT IN (SELECT id FROM took) UNION ALL SELECT id, 'PROCESSING', version + 1, 'w-0' FROM took",
    ),
    "claim_archived": (lambda s, d: _claim(s, d, archive=True).archive.select("id", "archived_at", "archived_by", "last_fail_reason"), _CLAIM + "SELECT id, {NOW} AS archived_at, 'w-0' AS archived_by, 'coalesced at claim' AS last_fail_reason FROM dup"),
    "mark_processed": (lambda s, d: X.mark_processed(_hot(s, d), _marks(s, d)).hot.select("id", "status", "version"), f"SELECT id, status, version FROM obx_events WHERE id NOT IN (SELECT e.id FROM {_OWN})"),
    "mark_processed_archive": (lambda s, d: X.mark_processed(_hot(s, d), _marks(s, d), NOW, "w-0").archive.select("id", "attempts", "archived_at", "archived_by"), f"SELECT e.id, e.attempts, {{NOW}} AS archived_at, 'w-0' AS archived_by FROM {_OWN}"),
    "finalize_batch": (lambda s, d: X.guarded(_hot(s, d), _marks(s, d)).select("id", "version"), f"SELECT e.id, e.version FROM {_OWN}"),
    "mark_retry": (lambda s, d: S(X.mark_retry(_hot(s, d), _marks(s, d).where("id % 20 = 7"))), _marked("PENDING", "e.attempts + 1", "m.next_run", "m.reason") + " WHERE m.id % 20 = 7"),
    "retry_batch": (lambda s, d: S(X.mark_retry(_hot(s, d), _marks(s, d))), _marked("PENDING", "e.attempts + 1", "m.next_run", "m.reason")),
    "release": (lambda s, d: S(X.release(_hot(s, d), _marks(s, d))), _marked("PENDING", "e.attempts", "m.next_run", "m.reason")),
    "release_claimed": (lambda s, d: S(X.release_claimed(_hot(s, d), "w-3", NOW)), _freed("status = 'PROCESSING' AND claimed_by = 'w-3'", "'released: worker shutdown'", "attempts")),
    "mark_disabled": (lambda s, d: S(X.mark_disabled(_hot(s, d), _marks(s, d))), _marked("DISABLED", "e.attempts", "e.run_at", "m.reason")),
    "force_reclaim": (lambda s, d: S(X.force_reclaim(_hot(s, d), _marks(s, d), NOW)), _marked("PENDING", "e.attempts + 1", "{NOW}", "'stuck: handler exceeded handlerMaxRuntime'")),
    "sweep_stale": (lambda s, d: S(X.sweep_stale(_hot(s, d), NOW, 864000, 200)), _freed(STALE, "'swept: stale PROCESSING claim'", tail="ORDER BY id LIMIT 200")),
    "sweep_owned": (
        lambda s, d: S(X.sweep_owned(_hot(s, d), NOW, 864000, 50, "w-3", _hot(s, d).where("id % 7 = 0"))),
        _freed(STALE + " AND claimed_by = 'w-3' AND id % 7 <> 0", "'swept: abandoned local claim'", tail="ORDER BY claimed_at, id LIMIT 50"),
    ),
    "dead_workers": (lambda s, d: R.dead_workers(fixture(s, d, "obx_workers"), NOW).select("worker_id", "last_heartbeat"), DEAD),
    "reclaim_orphans": (
        lambda s, d: S(X.reclaim_orphans(_hot(s, d), R.dead_workers(fixture(s, d, "obx_workers"), NOW), NOW)),
        _freed(f"status = 'PROCESSING' AND claimed_by IN (SELECT worker_id FROM ({DEAD}) w)", "'orphan-recovered: worker ' || claimed_by || ' was stale'"),
    ),
    "publish_insert": (
        lambda s, d: X.publish(_hot(s, d), _new_rows(s, d), NOW).returned.select("id", "event_type", "priority", "status", "attempts", "version", "created_at", "run_at"),
        "SELECT n.id, CASE WHEN n.id % 2 = 0 THEN 'new' ELSE 'other' END AS event_type, CAST(n.id % 3 AS INT) AS priority, 'PENDING' AS status, 0 AS attempts, CAST(0 AS BIGINT) AS version, {NOW} AS created_at, {NOW} AS run_at FROM (SELECT CAST(unnest(range(9990, 1000091, 100)) AS BIGINT) AS id) n WHERE n.id NOT IN (SELECT id FROM obx_events)",
    ),
    "worker_upsert": (
        lambda s, d: R.worker_upsert(fixture(s, d, "obx_workers"), _workers_new(s), NOW).hot,
        "SELECT worker_id, host, last_heartbeat, graceful_stop FROM obx_workers WHERE CAST(substr(worker_id, 3) AS INT) < 20 UNION ALL SELECT 'w-' || CAST(i AS STRING), 'host-' || CAST(i AS STRING), {NOW}, FALSE FROM (SELECT unnest(range(20, 31)) AS i) n",
    ),
    "lease_acquire": (
        lambda s, d: R.lease_acquire(fixture(s, d, "obx_locks"), _wanted(s, d), NOW).returned,
        "SELECT lock_key, 't-new' AS owner_token, 'w-9' AS owner_worker, {NOW} AS acquired_at, {NOW} + INTERVAL '10' MINUTE AS expires_at FROM obx_locks WHERE expires_at <= {NOW} AND substr(lock_key, length(lock_key)) IN ('0', '5')",
    ),
    "lease_release": (lambda s, d: R.lease_release(fixture(s, d, "obx_locks"), _tokens(s, d)).hot.select("lock_key", "owner_token"), "SELECT lock_key, owner_token FROM obx_locks WHERE substr(lock_key, length(lock_key)) <> '1'"),
    "lease_sweep": (lambda s, d: R.lease_sweep(fixture(s, d, "obx_locks"), NOW).hot.select("lock_key", "expires_at"), "SELECT lock_key, expires_at FROM obx_locks WHERE expires_at > {NOW}"),
    "reenable_all": (lambda s, d: X.reenable_all(_hot(s, d), "click", NOW, 60).returned.select("id", "status", "attempts", "version", "run_at", "last_fail_reason"), "SELECT id, 'PENDING' AS status, 0 AS attempts, version + 1 AS version, {NOW} AS run_at, 'reenabled by operator' AS last_fail_reason FROM obx_events WHERE status = 'DISABLED' AND event_type = 'click' ORDER BY id LIMIT 60"),
    "purge_disabled": (lambda s, d: X.purge_disabled(_hot(s, d), datetime(2024, 1, 10), 100).returned.select("id", "created_at"), "SELECT id, created_at FROM obx_events WHERE status = 'DISABLED' AND created_at < CAST('2024-01-10' AS DATE) ORDER BY id LIMIT 100"),
    "purge_archive": (lambda s, d: X.purge_archive(fixture(s, d, "obx_archive"), datetime(1998, 1, 1), 500).returned.select("id", "archived_at"), "SELECT id, archived_at FROM obx_archive WHERE archived_at < CAST('1998-01-01' AS DATE) ORDER BY id LIMIT 500"),
    "replay_blocked": (lambda s, d: _replay(s, d).blocked.select("id", "archived_at"), _REPLAY + "SELECT id, archived_at FROM src WHERE id IN (SELECT id FROM obx_events)"),
    "replay_inserted": (lambda s, d: _replay(s, d).inserted.select("id", "event_type", "priority", "status", "attempts", "version", "created_at"), _REPLAY + "SELECT id, event_type, priority, 'PENDING' AS status, 0 AS attempts, CAST(0 AS BIGINT) AS version, {NOW} AS created_at FROM src WHERE id NOT IN (SELECT id FROM obx_events)"),
    "replay_counts": (
        lambda s, d: _replay(s, d).counts(),
        _REPLAY + "SELECT count(*) FILTER (WHERE id NOT IN (SELECT id FROM obx_events)) AS replayed, count(*) FILTER (WHERE id IN (SELECT id FROM obx_events)) AS id_in_use, max(archived_at) AS next_at, (SELECT id FROM src ORDER BY archived_at DESC, id DESC LIMIT 1) AS next_id FROM src",
    ),
    "replay_post_hot": (lambda s, d: _replay(s, d).hot.select("id", "status", "version"), _REPLAY + "SELECT id, status, version FROM obx_events UNION ALL SELECT id, 'PENDING', CAST(0 AS BIGINT) FROM src WHERE id NOT IN (SELECT id FROM obx_events)"),
    "replay_post_archive": (lambda s, d: _replay(s, d).archive.select("id", "archived_at"), _REPLAY + "SELECT id, archived_at FROM obx_archive WHERE id NOT IN (SELECT id FROM src WHERE id NOT IN (SELECT id FROM obx_events))"),
    "replay_outcomes": (
        lambda s, d: fixture(s, d, "obx_events").select(F.col("id").alias("_live")).join(
            s.sql("SELECT explode(sequence(3L, 3000L, 3L)) AS id"), F.col("_live") == F.col("id"), "right").join(fixture(s, d, "obx_archive").select(F.col("id").alias("_arch")), F.col("_arch") == F.col("id"), "left")
        .select("id", F.when(F.col("_arch").isNull(), "NOT_FOUND").when(F.col("_live").isNotNull(), "ID_IN_USE").otherwise("REPLAYED").alias("outcome")),
        "SELECT w.id, CASE WHEN a.id IS NULL THEN 'NOT_FOUND' WHEN e.id IS NOT NULL THEN 'ID_IN_USE' ELSE 'REPLAYED' END AS outcome FROM (SELECT CAST(unnest(range(3, 3001, 3)) AS BIGINT) AS id) w LEFT JOIN obx_archive a ON a.id = w.id LEFT JOIN obx_events e ON e.id = w.id",
    ),
    "peak_in_flight": (_peak, "SELECT max(open) AS peak FROM (SELECT sum(d) OVER (ORDER BY moment, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM (SELECT started_at AS moment, 1 AS d FROM ledger UNION ALL SELECT finished_at AS moment, -1 AS d FROM ledger) s) o"),
}
