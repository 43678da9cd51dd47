"""The state tables as projections of the driver's tables, in SQL that Spark and DuckDB both run.

`render` fills in what differs: {NOW} and {T0}, the tables, and a few notations:
US[a|b] microseconds from a to b; JOIN[x|k] the texts x of a group, comma-joined in order of k; DISC[p|x] the
nearest-rank percentile; MAXBY[x|k] the x of the greatest k; HEX8[x] a hex text of 16 digits as an unsigned number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
FIXTURES = {
    "obx_events": """
SELECT event_id AS id, event_type,
       CASE WHEN event_id % 5 <> 0 THEN props END AS payload,
       CASE WHEN event_id % 5 = 0 THEN props END AS payload_binary_text,
       CASE WHEN event_id % 5 = 0 THEN 'binary' ELSE 'json' END AS payload_format,
       CAST(event_id % 3 - 1 AS INT) AS priority,
       CAST(event_id % 12 AS INT) AS attempts,
       CASE WHEN event_id % 10 = 9 THEN 'DISABLED' WHEN event_id % 10 >= 7 THEN 'PROCESSING' ELSE 'PENDING' END AS status,
       ts AS created_at,
       ts + INTERVAL '1' DAY * CAST(event_id % 4 AS INT) AS run_at,
       CASE WHEN event_id % 10 IN (7, 8) THEN 'w-' || CAST(user_id % 25 AS STRING) END AS claimed_by,
       CASE WHEN event_id % 10 IN (7, 8) THEN ts + INTERVAL '1' SECOND * CAST(event_id % 300 AS INT) END AS claimed_at,
       event_id % 12 + 1 AS version,
       CASE WHEN event_id % 2 = 0 THEN 'u-' || CAST(user_id AS STRING) END AS dedup_key
FROM events WHERE ts <= {NOW}
""",
    "obx_archive": """
SELECT o_orderkey * 3 AS id,
       CASE o_orderkey % 5 WHEN 0 THEN 'signup' WHEN 1 THEN 'purchase' WHEN 2 THEN 'error' WHEN 3 THEN 'view' ELSE 'click' END AS event_type,
       CAST(o_orderkey % 3 - 1 AS INT) AS priority, CAST(o_orderkey % 4 AS INT) AS attempts,
       o_orderdate AS archived_at, 'w-' || CAST(o_custkey % 25 AS STRING) AS archived_by,
       CASE WHEN o_orderkey % 2 = 0 THEN 'u-' || CAST(o_custkey AS STRING) END AS dedup_key
FROM orders
""",
    "obx_workers": """
SELECT 'w-' || CAST(n_nationkey AS STRING) AS worker_id, n_name AS host,
       {NOW} - INTERVAL '1' SECOND * (n_nationkey * 3) AS last_heartbeat,
       n_nationkey % 11 = 5 AS graceful_stop
FROM nation
""",
    "obx_locks": """
SELECT 'key-' || CAST(c_custkey AS STRING) AS lock_key, 't-' || CAST(c_custkey * 7 AS STRING) AS owner_token,
       'w-' || CAST(c_nationkey AS STRING) AS owner_worker,
       {NOW} - INTERVAL '1' SECOND * CAST(c_custkey % 600 AS INT) AS acquired_at,
       {NOW} - INTERVAL '1' SECOND * CAST(c_custkey % 600 - 300 AS INT) AS expires_at
FROM customer
""",
    "ledger": """
WITH k AS (
  SELECT event_id AS seq, event_type,
         'w-' || CAST(event_id % 4 AS STRING) AS worker_id, 't-' || CAST(event_id % 3 AS STRING) AS thread,
         CASE WHEN event_id % 6 <> 0 THEN 'key-' || CAST(event_id % 64 AS STRING) END AS lock_key,
         CASE WHEN event_id % 2 = 0 THEN 'u-' || CAST(user_id AS STRING) END AS dedup_key,
         {T0} + INTERVAL '0.001' SECOND * CAST(event_id * 10 + (event_id * 7919) % 50 AS INT) AS s0,
         CAST(1 + (event_id * 104729) % 800 AS INT) AS dur
  FROM events WHERE event_id % 101 <> 5),
r AS (
  SELECT seq, event_type, 1 AS attempt, worker_id, thread, lock_key, dedup_key, s0 AS started_at, dur,
         CASE WHEN seq % 10 = 3 THEN 'RETRY' ELSE 'SUCCESS' END AS outcome FROM k
  UNION ALL
  SELECT seq, event_type, 2, worker_id, thread, lock_key, dedup_key, s0 + INTERVAL '2' SECOND, dur, 'SUCCESS'
  FROM k WHERE seq % 10 = 3
  UNION ALL
  SELECT seq, event_type, 1, 'w-' || CAST((seq + 1) % 4 AS STRING), thread, lock_key, dedup_key, s0 + INTERVAL '1' SECOND, dur, 'SUCCESS'
  FROM k WHERE seq % 97 = 0
  UNION ALL
  SELECT seq + 1000000000, event_type, 1, worker_id, thread, lock_key, dedup_key, s0, dur, 'SUCCESS'
  FROM k WHERE seq % 499 = 1)
SELECT seq, event_type, attempt, worker_id, thread, lock_key, dedup_key, started_at,
       started_at + INTERVAL '0.001' SECOND * dur AS finished_at, outcome
FROM r
""",
    "publishes": """
SELECT event_id AS seq, {T0} + INTERVAL '0.001' SECOND * CAST(event_id * 10 AS INT) AS published_at,
       {T0} + INTERVAL '0.001' SECOND * CAST(event_id * 10 + event_id % 60 AS INT) AS committed_at,
       CASE WHEN event_id % 2 = 0 THEN 'u-' || CAST(user_id AS STRING) END AS dedup_key
FROM events
""",
    "chaos": """
SELECT 'WORKER_KILLED' AS kind, {T0} + INTERVAL '20' SECOND AS at, 'w-1' AS worker_id
UNION ALL SELECT 'WORKER_SPAWNED', {T0} + INTERVAL '30' SECOND, 'w-9'
UNION ALL SELECT 'POSTGRES_RESTARTED', {T0} + INTERVAL '60' SECOND, CAST(NULL AS STRING)
""",
    "marks": """
SELECT id, CASE WHEN id % 3 = 0 THEN version - 1 ELSE version END AS version, claimed_by,
       'reason ' || CAST(id AS STRING) AS reason, {NOW} + INTERVAL '1' SECOND * CAST(id % 7 AS INT) AS next_run
FROM obx_events WHERE status = 'PROCESSING' AND id % 20 IN (7, 8)
""",
    "facts": """
SELECT seq, started_at AS ts, event_type, worker_id, attempt, outcome, US[started_at|finished_at] AS run_us,
       CASE WHEN outcome = 'SUCCESS' THEN 'processed' WHEN attempt >= 2 THEN 'disabled' ELSE 'retry' END AS callback,
       CASE WHEN lock_key IS NULL THEN 'none' WHEN seq % 8 = 0 THEN 'busy' ELSE 'acquired' END AS lock_result
FROM ledger
""",
}
#: What a fixture reads among the others.
NEEDS = {"marks": ("obx_events",), "facts": ("ledger",)}
_SPARK = {
    "US": "timestampdiff(MICROSECOND, {0}, {1})",
    "JOIN": "array_join(transform(array_sort(collect_list(named_struct('k', {1}, 'x', CAST({0} AS STRING)))), s -> s.x), ',')",
    "DISC": "percentile_disc({0}) WITHIN GROUP (ORDER BY {1})",
    "MAXBY": "max_by({0}, {1})",
    "HEX8": "CAST(conv({0}, 16, 10) AS DECIMAL(38,0))",
}
_DUCK = {
    "US": "(epoch_us({1}) - epoch_us({0}))",
    "JOIN": "string_agg(CAST({0} AS VARCHAR), ',' ORDER BY {1})",
    "DISC": "percentile_disc({0}) WITHIN GROUP (ORDER BY {1})",
    "MAXBY": "arg_max({0}, {1})",
    "HEX8": "CAST(('0x' || {0})::UBIGINT AS DECIMAL(38,0))",
}


def _fill(sql: str, forms: dict[str, str], stamp: str) -> str:
    sql = sql.replace("{NOW}", f"CAST('2024-01-20 00:00:00' AS {stamp})").replace("{T0}", f"CAST('2024-02-01 00:00:00' AS {stamp})")
    for name, form in forms.items():
        while True:  # notations don't nest in themselves
            m = re.search(rf"\b{name}\[([^\[\]]*)\]", sql)
            if not m:
                break
            sql = sql[: m.start()] + form.format(*[x.strip() for x in m[1].split("|") if x.strip()] if "||" not in m[1] else [x.strip() for x in re.split(r"(?<!\|)\|(?!\|)", m[1])]) + sql[m.end() :]
    return sql


def _with(sql: str) -> str:
    used: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, ()):
            add(x)
        if name not in used:
            used.append(name)

    for name in FIXTURES:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    ctes = ", ".join(f"{n} AS ({FIXTURES[n].strip()})" for n in used)
    body = sql.strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def duck(sql: str) -> str:
    return _fill(_with(sql), _DUCK, "TIMESTAMP").replace("[[", "[").replace("]]", "]")


def spark_text(sql: str, sf_dir: str) -> str:
    sql = _fill(_with(sql), _SPARK, "TIMESTAMP_NTZ").replace("[[", "[").replace("]]", "]")
    for t in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", sql)
    return sql


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(spark_text(sql, sf_dir))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, f"SELECT * FROM {name}")
