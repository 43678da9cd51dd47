"""Tables of the engine: Spark schemas and column lists that statements share."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _T, _B = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampNTZType(), T.BinaryType()
_M = T.MapType(T.StringType(), T.StringType())


def _struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


#: What publishing fixes for good.
IMMUTABLE = ("id", "event_type", "payload", "payload_binary", "payload_format", "payload_class", "priority", "created_at", "trace_context", "dedup_key")
EVENT = _struct(
    id=_S, event_type=_S, payload=_S, payload_binary=_B, payload_format=_S, payload_class=_S, priority=T.ShortType(), attempts=_I, status=_S, created_at=_T,
    run_at=_T, claimed_by=_S, claimed_at=_T, last_fail_reason=_S, trace_context=_M, version=_L, dedup_key=_S,
)
PENDING = _struct(id=_S, event_type=_S, payload=_S, payload_binary=_B, payload_format=_S, payload_class=_S, priority=T.ShortType(), run_at=_T, trace_context=_M, dedup_key=_S)
ARCHIVE = _struct(
    id=_S, event_type=_S, payload=_S, payload_binary=_B, payload_format=_S, payload_class=_S, priority=T.ShortType(), attempts=_I, created_at=_T, run_at=_T,
    last_fail_reason=_S, trace_context=_M, dedup_key=_S, archived_at=_T, archived_by=_S,
)
WORKER = _struct(worker_id=_S, host=_S, pid=_I, started_at=_T, last_heartbeat=_T, graceful_stop=T.BooleanType(), metadata=_M)
LOCK = _struct(lock_key=_S, owner_token=_S, owner_worker=_S, acquired_at=_T, expires_at=_T)
HANDLING = _struct(seq=_L, event_type=_S, attempt=_I, worker_id=_S, thread=_S, lock_key=_S, dedup_key=_S, started_at=_T, finished_at=_T, outcome=_S)
FACT = _struct(ts=_T, callback=_S, event_id=_S, event_type=_S, worker_id=_S, attrs=_M)
TABLES = {"events": EVENT, "event_archive": ARCHIVE, "workers": WORKER, "entity_locks": LOCK, "handled": HANDLING, "facts": FACT}
PENDING_STATUS, PROCESSING, DISABLED = "PENDING", "PROCESSING", "DISABLED"
