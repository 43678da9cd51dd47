"""Queries that only read: one declarative text each, run by Spark on the tables and by an SQL oracle on the same ones."""

from __future__ import annotations

_RANKED = "SELECT id, priority, run_at, dedup_key FROM obx_events WHERE event_type = 'click' AND status = 'PENDING' AND run_at <= {NOW} ORDER BY priority DESC, run_at, id LIMIT 50"
_FIRST = "SELECT seq, min(finished_at) AS first_at FROM ledger WHERE outcome = 'SUCCESS' GROUP BY seq"
_LAT = f"SELECT p.seq, greatest(0, US[p.published_at|f.first_at]) AS us FROM publishes p JOIN ({_FIRST}) f ON p.seq = f.seq"
_N = "(SELECT max(seq) + 1 FROM publishes)"
_OVER = """SELECT *, max(finished_at) OVER (PARTITION BY lock_key ORDER BY started_at, finished_at, seq, attempt, worker_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
 FROM ledger WHERE lock_key IS NOT NULL"""
_DUP = "SELECT seq, count(*) AS n FROM ledger WHERE outcome = 'SUCCESS' GROUP BY seq HAVING count(*) > 1"
_EXPLAIN = """SELECT DISTINCT l.seq FROM ledger l JOIN chaos c ON (c.kind = 'WORKER_KILLED' AND c.worker_id = l.worker_id AND abs(US[c.at|l.finished_at]) <= 10000000)
 OR (c.kind = 'POSTGRES_RESTARTED' AND abs(US[c.at|l.finished_at]) <= 10000000) WHERE l.outcome = 'SUCCESS'"""
_STALE = f"""SELECT k.dedup_key, k.commit_at, s.start_at FROM (SELECT dedup_key, max(committed_at) AS commit_at FROM publishes WHERE dedup_key IS NOT NULL GROUP BY dedup_key) k
 LEFT JOIN (SELECT dedup_key, max(started_at) AS start_at FROM ledger WHERE outcome = 'SUCCESS' AND dedup_key IS NOT NULL GROUP BY dedup_key) s ON k.dedup_key = s.dedup_key"""
_REPLAY = "SELECT * FROM obx_archive WHERE event_type = 'purchase' AND archived_at > CAST('1995-01-01' AS DATE) AND archived_at < CAST('1997-01-01' AS DATE) ORDER BY archived_at, id LIMIT 100"
# 64-bit wrapping product and unsigned shift: an exact product, taken modulo 2^64
_HASH = "floor(CAST((CAST(seq + {0} AS DECIMAL(38,0)) * CAST(11400714819323198485 AS DECIMAL(20,0))) % CAST(18446744073709551616 AS DECIMAL(20,0)) AS DECIMAL(38,0)) / {1})"
_SLO = "SELECT CAST(b AS BIGINT) AS le_ms FROM (VALUES (50), (100), (250), (500), (1000), (2500), (5000), (10000)) v(b)"

READS: dict[str, str] = {
    "find_by_id": "SELECT id, event_type, payload, payload_format, priority, attempts, status, created_at, run_at, claimed_by, version, dedup_key FROM obx_events WHERE id = 10",
    "find_in_archive": "SELECT id, event_type, priority, attempts, archived_at, archived_by, dedup_key FROM obx_archive WHERE id = 300",
    "lookup_coalesced": """SELECT w.id, coalesce(e.place, a.place, 'none') AS place, coalesce(e.event_type, a.event_type) AS event_type FROM (SELECT DISTINCT CAST(n_nationkey * 3 AS BIGINT) AS id FROM nation) w
 LEFT JOIN (SELECT id, event_type, 'hot' AS place FROM obx_events) e ON w.id = e.id LEFT JOIN (SELECT id, event_type, 'archive' AS place FROM obx_archive) a ON w.id = a.id""",
    "tracked_state": """SELECT w.id, coalesce(e.status, CASE WHEN a.id IS NOT NULL THEN 'ARCHIVED' ELSE 'ABSENT' END) AS state FROM (SELECT event_id * 2 AS id FROM events) w
 LEFT JOIN obx_events e ON w.id = e.id LEFT JOIN obx_archive a ON w.id = a.id""",
    "due_events": "SELECT id, priority, run_at FROM obx_events WHERE event_type = 'click' AND status = 'PENDING' AND run_at <= {NOW}",
    "owns_claim": "SELECT m.id, e.id IS NOT NULL AS owns FROM marks m LEFT JOIN (SELECT * FROM obx_events WHERE status = 'PROCESSING') e ON e.id = m.id AND e.version = m.version AND e.claimed_by = m.claimed_by",
    "payload_lane_check": "SELECT count(*) AS bad FROM obx_events WHERE (payload IS NULL) = (payload_binary_text IS NULL)",
    "payload_route": "SELECT CASE payload_format WHEN 'json' THEN 'json' WHEN 'protobuf' THEN 'protobuf' ELSE 'unknown' END AS route, count(*) AS n FROM obx_events GROUP BY 1",
    "payload_base64": "SELECT id, {B64} AS body FROM obx_events WHERE payload_binary_text IS NOT NULL",
    "stale_claims": "SELECT id, claimed_by, claimed_at FROM obx_events WHERE status = 'PROCESSING' AND claimed_at < {NOW} - INTERVAL '10' DAY",
    "watchdog_candidates": "SELECT id, event_type, claimed_by, US[claimed_at|{NOW}] AS running_us FROM obx_events WHERE status = 'PROCESSING' AND US[claimed_at|{NOW}] > 300000000",
    "admin_page_1": "SELECT id, event_type, created_at, attempts FROM obx_events WHERE status = 'DISABLED' ORDER BY created_at DESC, id DESC LIMIT 20",
    "admin_page_2": """WITH p AS (SELECT id, created_at FROM obx_events WHERE status = 'DISABLED' ORDER BY created_at DESC, id DESC LIMIT 20), c AS (SELECT id AS cid, created_at AS cat FROM p ORDER BY created_at, id LIMIT 1)
SELECT id, event_type, created_at, attempts FROM obx_events JOIN c ON created_at < cat OR (created_at = cat AND id < cid) WHERE status = 'DISABLED' ORDER BY created_at DESC, id DESC LIMIT 20""",
    "archive_window": "SELECT id, event_type, archived_at FROM obx_archive WHERE archived_at > CAST('1995-01-01' AS DATE) AND archived_at < CAST('1997-01-01' AS DATE)",
    "replay_page": f"SELECT id, archived_at, archived_by FROM ({_REPLAY}) r",
    "oldest_pending": "SELECT id, event_type, run_at FROM obx_events WHERE status = 'PENDING' ORDER BY run_at, id LIMIT 20",
    "live_workers": "SELECT worker_id, host, last_heartbeat FROM obx_workers WHERE last_heartbeat >= {NOW} - INTERVAL '30' SECOND AND NOT graceful_stop",
    "workers_in_flight": "SELECT w.worker_id, w.host, count(e.id) AS in_flight FROM obx_workers w LEFT JOIN (SELECT * FROM obx_events WHERE status = 'PROCESSING') e ON e.claimed_by = w.worker_id GROUP BY w.worker_id, w.host",
    "live_leases": "SELECT count(*) AS live FROM obx_locks WHERE expires_at > {NOW} AND owner_worker NOT IN ('w-1', 'w-2')",
    "storage_state": "SELECT count(*) AS n_rows, count(*) = 0 AS clean FROM obx_events",
    "backlog_by_type": "SELECT event_type, status, count(*) AS n FROM obx_events GROUP BY event_type, status ORDER BY n DESC, event_type, status",
    "metrics_by_type_status": "SELECT event_type, status, count(*) AS n, min(run_at) FILTER (WHERE status = 'PENDING') AS oldest_run_at, min(claimed_at) FILTER (WHERE status = 'PROCESSING') AS oldest_claimed_at FROM obx_events GROUP BY event_type, status",
    "metrics_per_type": """SELECT event_type, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'PROCESSING') AS processing, count(*) FILTER (WHERE status = 'DISABLED') AS disabled,
 min(run_at) FILTER (WHERE status = 'PENDING') AS oldest_pending FROM obx_events GROUP BY event_type""",
    "metrics_totals": """SELECT count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'PROCESSING') AS processing, count(*) FILTER (WHERE status = 'DISABLED') AS disabled,
 min(run_at) FILTER (WHERE status = 'PENDING') AS oldest_pending, min(claimed_at) FILTER (WHERE status = 'PROCESSING') AS oldest_claimed FROM obx_events""",
    "backlog_gauge": "SELECT event_type, status, max(n) AS backlog FROM (SELECT event_type, status, count(*) AS n FROM obx_events GROUP BY event_type, status) g GROUP BY event_type, status",
    "oldest_pending_age": "SELECT event_type, greatest(0, CAST(floor(US[m|{NOW}] / 1000000.0) AS BIGINT)) AS age_s FROM (SELECT event_type, min(run_at) AS m FROM obx_events WHERE status = 'PENDING' GROUP BY event_type) o",
    "queue_time": "SELECT id, greatest(0, US[created_at|claimed_at]) AS queue_us FROM obx_events WHERE claimed_at IS NOT NULL",
    "deferred_links": "SELECT id, US[created_at|run_at] > 60000000 AS deferred FROM obx_events",
    "unknown_types": "SELECT id, event_type, 'SKIP' AS policy, {NOW} + INTERVAL '1' MINUTE AS next_run FROM obx_events WHERE status = 'PROCESSING' AND event_type NOT IN ('click', 'view', 'purchase')",
    "ledger_total": "SELECT count(*) AS n FROM ledger",
    "ledger_distinct_success": "SELECT count(DISTINCT seq) AS n FROM ledger WHERE outcome = 'SUCCESS'",
    "first_success": _FIRST,
    "distinct_threads": "SELECT count(DISTINCT worker_id || '/' || thread) AS threads FROM ledger",
    "duplicate_counts": f"SELECT count(*) AS duplicated, coalesce(CAST(sum(n - 1) AS BIGINT), 0) AS extra FROM ({_DUP}) d",
    "dup_attribution": f"SELECT d.seq, d.n, e.seq IS NOT NULL AS attributable FROM ({_DUP}) d LEFT JOIN ({_EXPLAIN}) e ON d.seq = e.seq",
    "invariant_counts": f"""SELECT {_N} AS published, count(DISTINCT CASE WHEN outcome = 'SUCCESS' THEN seq END) AS succeeded,
 {_N} - count(DISTINCT CASE WHEN outcome = 'SUCCESS' AND seq >= 0 AND seq < {_N} THEN seq END) AS lost, count(*) FILTER (WHERE seq < 0 OR seq >= {_N}) AS unexpected,
 count(*) FILTER (WHERE attempt > 1) AS retries, count(*) FILTER (WHERE outcome <> 'SUCCESS') AS failed FROM ledger""",
    "coalesced_publishes": f"SELECT {_N} - count(DISTINCT CASE WHEN outcome = 'SUCCESS' THEN seq END) AS coalesced FROM ledger",
    "lock_overlaps": f"SELECT lock_key, count(*) AS overlaps FROM ({_OVER}) o WHERE started_at < top GROUP BY lock_key",
    "lock_overlap_pairs": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lock_key ORDER BY started_at, finished_at, seq, attempt, worker_id) AS rn FROM ledger WHERE lock_key IS NOT NULL),
 t AS (SELECT *, max(CAST(US[{{T0}}|finished_at] AS DECIMAL(38,0)) * 1000000000000 - rn) OVER (PARTITION BY lock_key ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r)
SELECT a.lock_key, a.seq, a.worker_id, b.seq AS holder_seq, b.worker_id AS holder_worker FROM t a JOIN r b ON a.lock_key = b.lock_key AND CAST(US[{{T0}}|b.finished_at] AS DECIMAL(38,0)) * 1000000000000 - b.rn = a.m WHERE a.started_at < b.finished_at""",
    "freshness": f"SELECT dedup_key, commit_at, start_at, start_at IS NULL OR start_at < commit_at AS stale FROM ({_STALE}) s",
    "invariant_verdict": f"""SELECT lost = 0 AND unexplained = 0 AND unexpected = 0 AND n_overlaps = 0 AND stale = 0 AS passed, lost, unexplained, unexpected, n_overlaps, stale FROM
 (SELECT {_N} - count(DISTINCT CASE WHEN outcome = 'SUCCESS' AND seq >= 0 AND seq < {_N} THEN seq END) AS lost, count(*) FILTER (WHERE seq < 0 OR seq >= {_N}) AS unexpected FROM ledger) a CROSS JOIN
 (SELECT count(*) AS unexplained FROM ({_DUP}) d LEFT JOIN ({_EXPLAIN}) e ON d.seq = e.seq WHERE e.seq IS NULL) b CROSS JOIN (SELECT count(*) AS n_overlaps FROM ({_OVER}) o WHERE started_at < top) c CROSS JOIN
 (SELECT count(*) AS stale FROM ({_STALE}) s WHERE start_at IS NULL OR start_at < commit_at) f""",
    "e2e_latency": f"SELECT seq, us FROM ({_LAT}) l",
    "latency_stats": f"""SELECT count(*) AS n, floor(DISC[0.5|us] / 1000.0 * 1000 + 0.5) / 1000 AS p50_ms, floor(DISC[0.95|us] / 1000.0 * 1000 + 0.5) / 1000 AS p95_ms, floor(DISC[0.99|us] / 1000.0 * 1000 + 0.5) / 1000 AS p99_ms,
 floor(max(us) / 1000.0 * 1000 + 0.5) / 1000 AS max_ms, floor(CAST(sum(us) AS DOUBLE) / count(*) / 1000.0 * 1000 + 0.5) / 1000 AS mean_ms FROM ({_LAT}) l""",
    "slo_histogram": f"SELECT le_ms, count(*) FILTER (WHERE us <= le_ms * 1000) AS n FROM ({_LAT}) l CROSS JOIN ({_SLO}) b GROUP BY le_ms",
    "peak_per_worker": """SELECT worker_id, max(open) AS peak FROM (SELECT worker_id, sum(d) OVER (PARTITION BY worker_id ORDER BY moment, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM
 (SELECT worker_id, started_at AS moment, 1 AS d FROM ledger UNION ALL SELECT worker_id, finished_at AS moment, -1 AS d FROM ledger) s) o GROUP BY worker_id""",
    "meter_counters": "SELECT callback, event_type, count(*) AS n FROM facts GROUP BY callback, event_type",
    "meter_timers": "SELECT event_type, count(*) AS n, CAST(sum(run_us) AS BIGINT) AS sum_us, max(run_us) AS max_us FROM facts WHERE callback = 'processed' GROUP BY event_type",
    "meter_attempts": "SELECT event_type, callback, count(*) AS n, CAST(sum(attempt) AS BIGINT) AS attempts, max(attempt) AS most FROM facts WHERE callback <> 'retry' GROUP BY event_type, callback",
    "lock_wait_exhausted": "SELECT event_type, floor(1000000.0 * count(*) FILTER (WHERE lock_result = 'busy') / count(*) + 0.5) / 1000000 AS share FROM facts WHERE lock_result <> 'none' GROUP BY event_type",
    "relay_dedup_key": "SELECT id, {SHA2} AS relay_key FROM obx_events WHERE dedup_key IS NOT NULL",
    "relay_envelope": """SELECT id, 'bind-' || event_type AS binding, dedup_key AS message_key, CAST(id AS STRING) AS header_event_id, CASE payload_format WHEN 'json' THEN 'application/json' ELSE 'application/octet-stream' END AS content_type,
 coalesce(payload, payload_binary_text) AS body FROM obx_events WHERE status = 'PROCESSING'""",
    "scenario_assignment": "SELECT seq, 'type-' || CAST(seq % 4 AS STRING) AS event_type, 'key-' || CAST(seq % 64 AS STRING) AS lock_key, 'dedup-' || CAST(seq % 16 AS STRING) AS dedup_key FROM publishes",
    "slow_key_bucket": f"SELECT seq, CASE WHEN {_HASH.format(7, 16777216)} % 1000 < 20 THEN 'key-slow' ELSE 'key-' || CAST(seq % 64 AS STRING) END AS lock_key FROM publishes",
    "fail_bucket": f"SELECT seq, attempt, attempt = 1 AND {_HASH.format(1, 1048576)} % 1000 < 100 AS fails FROM ledger",
    "backoff_schedule": "SELECT attempt, CAST(least(5000 * pow(2.0, attempt - 1), 3600000) AS BIGINT) AS delay_ms FROM (SELECT DISTINCT n_nationkey + 1 AS attempt FROM nation) a",
    "claim_picked": _RANKED,
    "claim_picked_all_types": """SELECT event_type, id, rn FROM (SELECT event_type, id, row_number() OVER (PARTITION BY event_type ORDER BY priority DESC, run_at, id) AS rn FROM obx_events WHERE status = 'PENDING' AND run_at <= {NOW}) r WHERE rn <= 50""",
}
#: Texts whose functions differ: (Spark, DuckDB).
DIALECT = {
    "{B64}": ("base64(encode(payload_binary_text, 'UTF-8'))", "to_base64(encode(payload_binary_text))"),
    "{SHA2}": ("sha2(CAST(length('bind-' || event_type) AS STRING) || ':' || 'bind-' || event_type || dedup_key, 256)", "sha256(CAST(length('bind-' || event_type) AS VARCHAR) || ':' || 'bind-' || event_type || dedup_key)"),
}
