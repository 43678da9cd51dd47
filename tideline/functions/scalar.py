"""Scalar functions of the engine, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WRAP = 1 << 64
#: Fixed value: the multiplier of golden-ratio hashing.
GOLDEN = 0x9E3779B97F4A7C15


def golden_bucket(seq: Column, add: int, shift: int, buckets: int = 1000) -> Column:
    """((seq + add) * GOLDEN, wrapped to 64 bits) >>> shift, modulo buckets."""
    whole = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    product = ((seq + add).cast("decimal(18,0)") * whole(GOLDEN)) % whole(_WRAP)
    return (((product - product % whole(1 << shift)) / whole(1 << shift)).cast("decimal(20,0)") % buckets).cast("int")


def advisory_hash(key: Column) -> Column:
    """The first 8 bytes of SHA-256 as a signed number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, -10).cast("long")


def relay_dedup_key(binding: Column, key: Column) -> Column:
    return F.sha2(F.concat(F.length(binding).cast("string"), F.lit(":"), binding, key), 256)


def round_ms(us: Column) -> Column:
    """Microseconds as milliseconds with three places, half up."""
    return F.floor(us / 1000.0 * 1000 + 0.5) / 1000


def age_seconds(since: Column, now: Column) -> Column:
    """Whole seconds, rounded down; null and negative are 0."""
    return F.coalesce(F.greatest(F.lit(0), F.floor(F.timestamp_diff("MICROSECOND", since, now) / 1_000_000)), F.lit(0)).cast("long")


#: The carrier's marker of a deferred event.
TRACE_MARK, TRACE_LINK = "event_outboxer.propagation", "link"


def mark_trace(trace: Column) -> Column:
    """The carrier with the marker; an empty one (or null) stays as it is: there is nothing to link to."""
    return F.when(F.size(trace) > 0, F.map_concat(strip_trace(trace), F.create_map(F.lit(TRACE_MARK), F.lit(TRACE_LINK)))).otherwise(trace)


def strip_trace(trace: Column) -> Column:
    return F.map_filter(trace, lambda k, _: k != TRACE_MARK)


def propagation(trace: Column) -> Column:
    """link if the carrier has the marker, else child."""
    return F.when(F.element_at(trace, TRACE_MARK) == TRACE_LINK, "link").otherwise("child")


def statement_kind(query: Column, events: str) -> Column:
    """What a statement on the table `events` does, by its text; spaces and case don't matter."""
    q = F.lower(F.trim(F.regexp_replace(query, "\\s+", " ")))
    table = events.lower()
    archive = q.startswith("with") & q.contains("event_archive")
    sets = F.regexp_extract(q, f"^update \\Q{table}\\E( e)? set status = \\S+, (.*)$", 2)
    return (
        F.when(q.startswith("with picked as"), "claim").when(q.startswith(f"insert into {table}"), "insert")
        .when(q.startswith(f"delete from {table} e using (values") | (archive & q.contains("values")), "finalizeBatch")
        .when(q.startswith(f"delete from {table} where id = ") | archive, "finalizeSingle")
        .when((sets == "") | sets.contains("where id in (select"), "other").when(sets.contains("attempts = attempts + "), "retry")
        .when(sets.contains("run_at = "), "release").when(sets.contains("last_fail_reason"), "disabled").otherwise("other")
    )


def rate(n: Column, per: Column) -> Column:
    """n / per; 0 where there is nothing to divide by."""
    return F.when(per > 0, n / per).otherwise(F.lit(0.0))


def human_bytes(n: int) -> str:
    for unit, size, places in (("GB", 1 << 30, 2), ("MB", 1 << 20, 1), ("KB", 1 << 10, 1)):
        if n >= size:
            return f"{n / size:.{places}f}{unit}"
    return f"{n}B"


def human_ms(ms: int) -> str:
    return f"{ms}ms" if ms < 1000 else f"{ms / 1000:.1f}s"
