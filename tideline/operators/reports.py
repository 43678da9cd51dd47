"""What a run's report says: counters between two moments, rates and shares, samples, what is in flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import human_ms, rate
from .transitions import _now


def deltas(earlier: DataFrame, later: DataFrame, counters: list[str]) -> DataFrame:
    """One row: each counter's difference and their total. Both are one row."""
    both = later.select(*[F.col(c).alias(f"_{c}") for c in counters]).join(earlier)
    each = [(F.col(f"_{c}") - F.col(c)).alias(c) for c in counters]
    return both.select(*each).withColumn("total", sum((F.col(c) for c in counters), F.lit(0)))


def ratios(ledger: DataFrame, publishes: DataFrame) -> DataFrame:
    """One row: events handled, published, handled a second from the first start to the last end, handler runs an event, and the share that coalescing saved."""
    span = F.timestamp_diff("MICROSECOND", F.min("started_at"), F.max("finished_at")) / 1_000_000
    sums = ledger.agg(F.count_distinct(F.when(F.col("outcome") == "SUCCESS", F.col("seq"))).alias("handled"), F.count("*").alias("runs"), span.alias("span")).join(publishes.agg(F.count("*").alias("published")))
    return sums.select("handled", "published", rate(F.col("handled"), F.col("span")).alias("handled_per_s"), rate(F.col("runs"), F.col("published")).alias("runs_per_event"), rate(F.col("published") - F.col("handled"), F.col("published")).alias("coalesced_share"))


def samples(rows: DataFrame, key: list[str], n: int = 20) -> DataFrame:
    """The first `n` in order of the key: a report's examples."""
    return rows.select(*key).orderBy(*key).limit(n)


def in_flight(hot: DataFrame, now, seconds: int) -> DataFrame:
    """By type: claimed rows, and those claimed longer ago than `seconds`."""
    old = F.col("claimed_at") + F.make_dt_interval(secs=F.lit(seconds)) < _now(now)
    return hot.where("status = 'PROCESSING'").groupBy("event_type").agg(F.count("*").alias("in_flight"), F.count(F.when(old, 1)).alias("abandoned"))


def latency(ledger: DataFrame, publishes: DataFrame) -> DataFrame:
    """One row: n, p50_ms, p95_ms, p99_ms (nearest rank) and max_ms from an event's publishing to its first success; negative is 0."""
    first = ledger.where("outcome = 'SUCCESS'").groupBy("seq").agg(F.min("finished_at").alias("first_at"))
    us = F.greatest(F.lit(0), F.timestamp_diff("MICROSECOND", "published_at", "first_at")).alias("us")
    rank = lambda p: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY us)") / 1000, 3)
    return publishes.join(first, "seq").select(us).agg(F.count("*").alias("n"), *[rank(p / 100).alias(f"p{p}_ms") for p in (50, 95, 99)], F.round(F.max("us") / 1000, 3).alias("max_ms"))


def report(ledger: DataFrame, publishes: DataFrame) -> DataFrame:
    """One row: ratios and latency of a run."""
    return ratios(ledger, publishes).join(latency(ledger, publishes))


def summary(row) -> str:
    """A report's row as one line for a console."""
    return f"{row['handled']} of {row['published']} handled, {row['handled_per_s']:.0f}/s, {100 * row['coalesced_share']:.1f} % coalesced, p50 {human_ms(int(row['p50_ms'] or 0))}, p95 {human_ms(int(row['p95_ms'] or 0))}, p99 {human_ms(int(row['p99_ms'] or 0))}"
