"""Handlers, payload codecs, and the runner that calls handlers on the executors."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = "id string, version long, claimed_by string, event_type string, attempts int, kind string, reason string, delay_ms long, started_us long, finished_us long, thread string"


@dataclass
class Outcome:
    """SUCCESS and SKIP end an event, RETRY asks the failure policy, FAIL is never tried again."""

    kind: str
    reason: str | None = None
    delay_ms: int | None = None


SUCCESS, SKIP = Outcome("SUCCESS"), Outcome("SKIP")


class EventHandler(Protocol):
    """May also have `on_failure(context, outcome) -> Outcome`, asked after a RETRY or an exception; if that throws, the event is disabled."""

    event_type: str

    def handle(self, context: dict, payload: Any) -> Outcome | None: ...


@dataclass
class RelayHandler:
    """Sends envelopes through `sender(binding, headers, body) -> bool`; what is not acknowledged is tried again.

    The payload is an envelope as `sinks.envelope` makes it: binding, key, headers, content_type, and text or bytes.
    """

    event_type: str
    sender: Callable[[str, dict, Any], bool]
    key_header: str | None = None

    def handle(self, context: dict, payload: dict) -> Outcome:
        headers = {**(payload.get("headers") or {}), "outboxer_eventId": str(context["id"]), "contentType": payload["content_type"]}
        if self.key_header and payload.get("key") is not None:
            headers[self.key_header] = payload["key"].encode()
        body = payload["payload"] if payload.get("payload") is not None else payload["payload_binary"]
        return SUCCESS if self.sender(payload["binding"], headers, body) else Outcome("RETRY", f"sender did not acknowledge for binding '{payload['binding']}'")


def failed(handler, context: dict, done: Outcome) -> Outcome:
    """What a failed attempt becomes: the handler's own decision if it has one."""
    if done.kind != "RETRY" or not hasattr(handler, "on_failure"):
        return done
    try:
        return handler.on_failure(context, done) or done
    except Exception as e:
        return Outcome("FAIL", f"failure handler threw: {type(e).__name__}: {e}")


def _json_out(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


@dataclass
class Codecs:
    """Payload formats by name: (encode, decode). The stored format of a row chooses; an unknown one is a failure of the row."""

    known: dict[str, tuple[Callable, Callable]] = field(default_factory=lambda: {"json": (_json_out, json.loads), "text": (str, str), "binary": (bytes, bytes)})

    def protobuf(self, message_class, name: str = "protobuf") -> Codecs:
        self.known[name] = (lambda m: m.SerializeToString(), message_class.FromString)
        return self

    def decode(self, name: str, text, binary):
        if name not in self.known:
            raise ValueError(f"unknown payload format {name}")
        return self.known[name][1](text if text is not None else bytes(binary))


def run_handlers(claimed: DataFrame, handlers: dict[str, EventHandler], codecs: Codecs | None = None, parallelism: int | None = None, lock_key: str | None = None) -> DataFrame:
    """One row of OUTCOMES for each claimed row. Handlers run in Python on the executors, a batch at a time.

    Rows that share `lock_key` go to one task and run there one after the other, in claim order. What a handler throws
    becomes RETRY with the error as its reason; a type without a handler becomes UNKNOWN.
    """
    codecs = codecs or Codecs()
    rows = claimed.select(*[c for c in ("id", "version", "claimed_by", "event_type", "attempts", "payload", "payload_binary", "payload_format", "priority", "run_at", "trace_context", "dedup_key") if c in claimed.columns], *([lock_key] if lock_key and lock_key not in claimed.columns else []))
    if lock_key:
        rows = rows.repartition(*([parallelism] if parallelism else []), F.coalesce(F.col(lock_key), F.col("id").cast("string"))).sortWithinPartitions(F.desc("priority"), "run_at", "id")
    elif parallelism:
        rows = rows.repartition(parallelism)

    def run(batches):
        import threading

        import pandas as pd

        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                begun = time.time_ns() // 1000
                handler = handlers.get(r["event_type"])
                if handler is None:
                    done = Outcome("UNKNOWN", f"no handler for {r['event_type']}")
                else:
                    try:
                        payload = codecs.decode(r.get("payload_format") or "json", r.get("payload"), r.get("payload_binary"))
                        done = handler.handle(r, payload) or SUCCESS
                    except Exception as e:
                        done = Outcome("RETRY", f"{type(e).__name__}: {e}")
                    done = failed(handler, r, done)
                out.append((str(r["id"]), r["version"], r["claimed_by"], r["event_type"], r["attempts"], done.kind, done.reason, done.delay_ms, begun, time.time_ns() // 1000, threading.current_thread().name))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOMES.split(", ")])
            yield frame.astype({"delay_ms": "Int64", "version": "Int64", "attempts": "Int32"})

    return rows.mapInPandas(run, OUTCOMES)
