"""Failure policies as Column expressions: when to try again, when to give up."""

from __future__ import annotations

from dataclasses import dataclass, replace
from random import random

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FailurePolicy:
    """Exponential backoff under a limit of attempts. `jitter` is the greatest relative deviation; exhausted events are disabled or deleted."""

    max_attempts: int = 10
    base_ms: int = 5_000
    multiplier: float = 2.0
    cap_ms: int = 3_600_000
    jitter: float = 0.2
    exhausted: str = "DISABLE"
    seed: int | None = None

    def merged(self, **own) -> FailurePolicy:
        """This policy with a type's own settings over it; None keeps what stands here."""
        return replace(self, **{k: v for k, v in own.items() if v is not None})

    def delay_ms(self, attempt: Column) -> Column:
        """attempt counts from 1; milliseconds, truncated."""
        plain = F.least(F.lit(float(self.base_ms)) * F.pow(F.lit(self.multiplier), attempt - 1), F.lit(float(self.cap_ms))).cast("long")
        return plain if not self.jitter else (plain * (1 + self.jitter * (2 * F.rand(self.seed) - 1))).cast("long")

    def decide(self, attempts: Column, override_ms: Column | None = None) -> tuple[Column, Column]:
        """(RETRY, DISABLE or DELETE; delay in ms or null) for a row that failed `attempts` times before."""
        spent = attempts + 1 >= self.max_attempts
        delay = F.coalesce(override_ms, self.delay_ms(attempts + 1)) if override_ms is not None else self.delay_ms(attempts + 1)
        return F.when(spent, self.exhausted).otherwise("RETRY"), F.when(~spent, delay)


def reason(outcome_reason: Column, cause: Column, default: str) -> Column:
    return F.substring(F.coalesce(outcome_reason, cause, F.lit(default)), 1, 10_000)


def route(outcomes, now, default: FailurePolicy, policies: dict[str, FailurePolicy] | None = None, unknown: str = "SKIP", unknown_delay_ms: int = 60_000):
    """Adds route (delete, retry, release, disable, leave), reason and next_run to outcomes.

    SUCCESS and SKIP end an event; FAIL is never tried again; RETRY asks its type's policy, with the outcome's own delay before the policy's.
    LOCK_BUSY gives the row back without counting an attempt. UNKNOWN follows `unknown`: SKIP gives it back after a while, DISABLE disables,
    FAIL leaves the row PROCESSING for the sweep of stale claims.
    """
    decision, delay = default.decide(F.col("attempts"), F.col("delay_ms"))
    for event_type, policy in (policies or {}).items():
        mine, after = policy.decide(F.col("attempts"), F.col("delay_ms"))
        decision, delay = F.when(F.col("event_type") == event_type, mine).otherwise(decision), F.when(F.col("event_type") == event_type, after).otherwise(delay)
    kind = F.col("kind")
    way = (
        F.when(kind.isin("SUCCESS", "SKIP"), "delete").when(kind == "FAIL", "disable").when(kind == "LOCK_BUSY", "release").when(kind == "UNKNOWN", {"SKIP": "release", "DISABLE": "disable", "FAIL": "leave"}[unknown])
        .when(decision == "RETRY", "retry").when(decision == "DELETE", "delete").otherwise("disable")
    )
    wait = F.when(kind == "UNKNOWN", F.lit(unknown_delay_ms)).when(kind == "LOCK_BUSY", F.col("delay_ms")).otherwise(F.coalesce(delay, F.lit(0)))
    stamp = F.lit(now).cast("timestamp_ntz")
    why = reason(F.col("reason"), F.lit(None).cast("string"), "handler asked for a retry")
    return outcomes.withColumn("route", way).withColumn("reason", why).withColumn("next_run", stamp + F.make_dt_interval(secs=wait / 1000))


@dataclass
class AdaptiveWaiter:
    """Pause between polls: the least after a hit, else longer by `multiplier` up to the most; `jitter` is the greatest relative deviation."""

    least: float = 0.05
    most: float = 5.0
    multiplier: float = 1.5
    jitter: float = 0.1

    def __post_init__(self):
        if not 0 < self.least <= self.most or self.multiplier <= 1:
            raise ValueError("0 < least <= most and multiplier > 1 are asked for")
        self.current = self.least

    def record(self, batch: int) -> None:
        self.current = self.least if batch > 0 else min(self.most, self.current * self.multiplier)

    def next_wait(self, draw: float | None = None) -> float:
        """Seconds; `draw` in [0, 1) stands for the random number."""
        return self.current * (1 + self.jitter * (2 * (random() if draw is None else draw) - 1))
