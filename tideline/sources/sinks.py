"""Sinks and codecs around the state tables: ledger as CSV, reports as JSON, flat maps, cursors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ledger_csv(ledger: DataFrame, path: str) -> None:
    """By seq, then start, range-sorted over files that sort by name; nulls are empty fields."""
    cols = ["seq", "event_type", "attempt", "worker_id", "thread", "lock_key", "dedup_key", "started_at", "finished_at", "outcome"]
    ledger.select(*cols).orderBy("seq", "started_at").write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path, header=True, nullValue="", emptyValue="")


def report_json(report: DataFrame, path: str) -> None:
    """A report of few rows, one JSON object a line."""
    report.write.json(path, ignoreNullFields=False)


def map_from_json(text: Column) -> Column:
    """A flat string map; null and empty text are the empty map."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.create_map().cast("map<string,string>")).otherwise(F.from_json(text, "map<string,string>"))


def map_to_json(value: Column) -> Column:
    return F.to_json(value)


def encode_cursor(at: datetime, event_id: str) -> str:
    return f"{at.isoformat()}Z_{event_id}"


def decode_cursor(text: str) -> tuple[datetime, str]:
    at, sep, event_id = text.partition("_")
    if not sep or not event_id:
        raise ValueError(f"malformed cursor {text!r}")
    try:
        return datetime.fromisoformat(at.removesuffix("Z")), event_id
    except ValueError:
        raise ValueError(f"malformed cursor {text!r}") from None


def envelope(events: DataFrame, binding: Column, content_type: Column | None = None) -> DataFrame:
    """What a broker relay sends: binding, key, headers, content type (as given, else by the payload's lane), and the payload as text or bytes."""
    kind = F.when(F.col("payload").isNotNull(), "application/json").otherwise("application/octet-stream")
    kind = kind if content_type is None else F.coalesce(content_type, kind)
    return events.select("id", binding.alias("binding"), F.col("dedup_key").alias("key"), F.create_map(F.lit("event_id"), F.col("id").cast("string")).alias("headers"), kind.alias("content_type"), "payload", "payload_binary")
