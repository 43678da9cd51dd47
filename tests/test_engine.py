"""The engine's contract: claims, coalescing, guards, recovery, replay, commits that race."""

from datetime import datetime, timedelta

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tideline.engine import Engine, EngineConfig
from tideline.functions import scalar
from tideline.handlers import Outcome
from tideline.policy import FailurePolicy
from tideline.schema import PENDING, WORKER
from tideline.sources import sinks

T = datetime(2024, 5, 1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the handlers of this file


class Orders:
    event_type = "order"

    def handle(self, context, payload):
        return {"ok": None, "bad": Outcome("FAIL", "no such order"), "again": Outcome("RETRY", "busy")}.get(payload["say"]) if payload["say"] != "throw" else 1 / 0


def pending(spark, *rows):
    """rows: (id, say, priority, seconds after T, dedup_key)"""
    made = [(i, "order", f'{{"say": "{say}"}}', None, "json", "Order", p, T + timedelta(seconds=s), {"trace": i}, key) for i, say, p, s, key in rows]
    return spark.createDataFrame(made, PENDING)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/state", [Orders()], EngineConfig(batch=5, archive=True, default_policy=FailurePolicy(max_attempts=2, jitter=0)))


def hot(engine):
    return {r["id"]: r for r in engine.store.read("events").collect()}


def test_publish_is_all_or_nothing(engine, spark):
    assert engine.publish(pending(spark, ("a", "ok", 0, 0, None)), T) == 1
    with pytest.raises(ValueError):
        engine.publish(pending(spark, ("b", "ok", 0, 0, None), ("a", "ok", 0, 0, None)), T)
    with pytest.raises(ValueError):
        engine.publish(pending(spark, ("c", "ok", 0, 0, None), ("c", "ok", 0, 0, None)), T)
    assert set(hot(engine)) == {"a"}


def test_claim_order_and_coalescing(engine, spark):
    engine.publish(pending(spark, *[(f"k{i:02}", "ok", 0, i, "order-7") for i in range(30)]), T)
    got = engine.claim("order", T + timedelta(hours=1)).collect()
    assert [r["id"] for r in got] == ["k00"] and len(got[0]["coalesced"]) == 29
    assert engine.claim("order", T + timedelta(hours=1)).collect() == []
    archived = engine.store.read("event_archive")
    assert archived.count() == 29 and {r[0] for r in archived.select("last_fail_reason").distinct().collect()} == {"coalesced at claim"}


def test_keyless_rows_never_coalesce_and_future_twins_stay(engine, spark):
    engine.publish(pending(spark, ("a", "ok", 0, 0, "x"), ("b", "ok", 1, 0, None), ("c", "ok", 1, 0, None), ("d", "ok", 5, 7200, "x")), T)
    got = engine.claim("order", T + timedelta(seconds=1)).collect()
    assert [r["id"] for r in got] == ["b", "c", "a"] and all(not r["coalesced"] for r in got)
    assert hot(engine)["d"]["status"] == "PENDING"


def test_tick_routes_outcomes(engine, spark):
    engine.publish(pending(spark, ("ok", "ok", 0, 0, None), ("bad", "bad", 0, 0, None), ("again", "again", 0, 0, None), ("throw", "throw", 0, 0, None)), T)
    assert engine.tick("order", T) == {"delete": 1, "disable": 1, "retry": 2}
    left = hot(engine)
    assert left["bad"]["status"] == "DISABLED" and left["bad"]["attempts"] == 0 and left["bad"]["last_fail_reason"] == "no such order"
    assert left["again"]["attempts"] == 1 and left["again"]["run_at"] == T + timedelta(seconds=5) and left["throw"]["last_fail_reason"].startswith("ZeroDivisionError")
    assert engine.state("ok") == "ARCHIVED" and engine.state("bad") == "DISABLED" and engine.state("none") == "ABSENT"
    assert engine.tick("order", T + timedelta(minutes=1)) == {"disable": 2}  # the second failure exhausts the policy
    assert engine.store.read("handled").count() == 6


def test_lost_claims_change_nothing(engine, spark):
    engine.publish(pending(spark, ("a", "ok", 0, 0, None)), T)
    claimed = engine.claim("order", T)
    outcome = claimed.select("id", (F.col("version") - 1).alias("version"), "claimed_by", "event_type", "attempts", F.lit("SUCCESS").alias("kind"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("delay_ms"), F.lit(0).cast("long").alias("started_us"), F.lit(1).cast("long").alias("finished_us"), F.lit("t").alias("thread"))
    engine.finalize(outcome, T)
    assert hot(engine)["a"]["status"] == "PROCESSING"


def test_recovery_and_replay(engine, spark):
    engine.publish(pending(spark, ("a", "ok", 0, 0, None)), T)
    engine.register(spark.createDataFrame([("w-0", "h", 1, T, T, False, {})], WORKER), T)
    assert engine.heartbeat(T)
    engine.claim("order", T)
    assert engine.sweep_stale(T + timedelta(seconds=600)) == 0  # strictly older
    assert engine.recover_orphans(T + timedelta(seconds=31)) == 1 and hot(engine)["a"]["attempts"] == 1 and "w-0 was stale" in hot(engine)["a"]["last_fail_reason"]
    assert not engine.heartbeat(T)
    assert engine.drain("order", T + timedelta(minutes=2)) == 1
    assert engine.replay("order", T + timedelta(minutes=3), 10) == {"replayed": 1, "id_in_use": 0, "next": None}
    assert hot(engine)["a"]["attempts"] == 0 and engine.store.read("event_archive").count() == 0


def test_two_writers_of_one_version(engine, spark):
    engine.publish(pending(spark, ("a", "ok", 0, 0, None)), T)
    base, events = engine.store.version(), engine.store.read("events")
    assert engine.store.commit(base, {"events": events}) and not engine.store.commit(base, {"events": events.limit(0)})
    assert set(hot(engine)) == {"a"}
    assert engine.store.vacuum(1) == 2  # the first folder, and that of the writer that lost
    assert set(hot(engine)) == {"a"}


def test_stream_dispatch_is_idempotent(engine, spark, tmp_path):
    from tideline.streaming.dispatch import dispatcher, pending_stream

    source = f"{tmp_path}/in"
    pending(spark, ("a", "ok", 0, 0, None), ("b", "bad", 0, 0, None)).write.parquet(source)
    for _ in range(2):
        dispatcher(engine, pending_stream(engine, source), f"{tmp_path}/cp", lambda: T).awaitTermination(120)
        pending(spark, ("b", "bad", 0, 0, None)).write.mode("append").parquet(source)
    assert {k: v["status"] for k, v in hot(engine).items()} == {"b": "DISABLED"}


def test_a_batch_that_comes_again_changes_nothing(engine, spark):
    rows = pending(spark, ("a", "ok", 0, 0, None))

    def step(store, base):
        from tideline.operators import transitions as X

        return {}, {"events": X.publish(store.read("events", base), rows, T).returned}, "published"

    assert engine.store.transact(step, batch=("s", 0)) == "published"
    assert engine.drain("order", T) == 1 and hot(engine) == {}
    assert engine.store.transact(step, batch=("s", 0)) is None and hot(engine) == {}  # finished and gone, and not published again
    assert engine.store.transact(step, batch=("other", 0)) == "published" and engine.store.last_batch("s") == 0


def test_writers_that_died_leave_nothing_that_counts(engine, spark, tmp_path):
    engine.publish(pending(spark, ("a", "ok", 0, 0, None)), T)
    root = tmp_path / "state"
    (root / "_commits" / "2.lock").touch()
    (root / "_commits" / ".half").write_text('{"events": [')
    engine.store._write("events", 2, engine.store.read("events"))  # a writer that lost the race, or died before its commit
    engine.publish(pending(spark, ("b", "ok", 0, 0, None)), T)
    assert set(hot(engine)) == {"a", "b"} and engine.store.vacuum(1) == 1 and set(hot(engine)) == {"a", "b"}


def test_entity_locks_and_lost_claims_in_dispatch(engine, spark):
    engine.publish(pending(spark, ("a", "ok", 0, 0, None), ("b", "ok", 0, 1, None), ("c", "ok", 0, 2, None)), T)
    keyed = [("a", "k1"), ("b", "k1"), ("c", "k2")]
    keys = spark.createDataFrame(keyed, "id string, dedup_key string")

    def rekey(store, base):  # keys that don't coalesce: set after publishing
        events = store.read("events", base).drop("dedup_key").join(keys, "id")
        return {"events": events.withColumn("payload_class", F.col("dedup_key")).withColumn("dedup_key", F.lit(None).cast("string"))}, {}, None

    engine.store.transact(rekey)
    at = T + timedelta(minutes=1)
    assert engine.tick("order", at, lock_key="payload_class", entity_locks=True) == {"delete": 2, "release": 1}
    left = hot(engine)["b"]
    assert left["attempts"] == 0 and left["last_fail_reason"] == "lock busy: k1" and left["run_at"] == at + timedelta(seconds=1)
    assert engine.store.read("entity_locks").count() == 0
    assert engine.tick("order", at + timedelta(seconds=1), lock_key="payload_class", entity_locks=True) == {"delete": 1}
    engine.publish(pending(spark, ("d", "ok", 0, 0, None)), T)
    claimed = engine.claim("order", at)
    assert engine.owned(claimed).count() == 1
    assert engine.watchdog(at + timedelta(seconds=300)) == 0 and engine.watchdog(at + timedelta(seconds=20), {"order": 10}) == 1
    assert engine.owned(claimed).count() == 0 and "stuck" in hot(engine)["d"]["last_fail_reason"] and hot(engine)["d"]["attempts"] == 1


def test_admin(engine, spark):
    engine.publish(pending(spark, *[(f"e{i}", "bad", 0, 0, None) for i in range(5)], ("ok", "ok", 0, 0, None)), T)
    assert engine.drain("order", T) == 2  # six rows in batches of five
    page, cursor = engine.find_by_status("DISABLED", limit=3)
    assert [r["id"] for r in page.collect()] == ["e4", "e3", "e2"]
    rest, end = engine.find_by_status("DISABLED", "order", 3, cursor)
    assert [r["id"] for r in rest.collect()] == ["e1", "e0"] and end is None
    assert engine.reenable("e0", T) and not engine.reenable("e0", T) and not engine.reenable("nope", T)
    assert engine.reenable_all("order", T, 2) == 2 and engine.find("e0").first()["status"] == "PENDING"
    assert engine.find_in_archive("ok").count() == 1 and engine.replay_one("ok", T) == "REPLAYED" and engine.replay_one("ok", T) == "NOT_FOUND"
    assert engine.await_done("nope", 1) == "COMPLETED" and engine.await_done("e4", 1) == "DISABLED" and engine.await_done("ok", 0.1, 0.05) == "TIMED_OUT:PENDING"
    n = {(r["status"]): r["n"] for r in engine.metrics()}
    assert n == {"PENDING": 4, "DISABLED": 2}
    engine.reenable_all("order", T, 1)
    assert {r["status"]: r["n"] for r in engine.metrics(60)} == n and {r["status"]: r["n"] for r in engine.metrics()} != n
    assert engine.retention(T + timedelta(days=9), disabled_days=1) == {"archive": 0, "disabled": 1}


def test_unknown_types_follow_the_policy(spark, tmp_path):
    for policy, status in (("SKIP", "PENDING"), ("DISABLE", "DISABLED"), ("FAIL", "PROCESSING")):
        e = Engine(spark, f"file://{tmp_path}/{policy}", [], EngineConfig(unknown=policy))
        e.publish(pending(spark, ("a", "ok", 0, 0, None)), T)
        e.tick("order", T)
        assert hot(e)["a"]["status"] == status and hot(e)["a"]["attempts"] == 0
    assert e.sweep_owned(T + timedelta(seconds=601)) == 1 and hot(e)["a"]["last_fail_reason"] == "swept: abandoned local claim"


def test_relay_and_failure_handlers():
    from tideline.handlers import SUCCESS, RelayHandler, failed

    sent = []
    relay = RelayHandler("e", lambda *a: sent.append(a) or a[0] == "good", "key")
    envelope = {"binding": "good", "key": "k", "headers": {"x": "1"}, "content_type": "application/json", "payload": "{}"}
    assert relay.handle({"id": 7}, envelope) == SUCCESS
    assert sent[0] == ("good", {"x": "1", "outboxer_eventId": "7", "contentType": "application/json", "key": b"k"}, "{}")
    assert relay.handle({"id": 7}, envelope | {"binding": "bad", "payload": None, "payload_binary": b"x"}).kind == "RETRY" and sent[1][2] == b"x"

    class Decides:
        def on_failure(self, context, outcome):
            return {"fatal": Outcome("FAIL", "no use"), "throws": None}[outcome.reason] if outcome.reason != "throws" else 1 / 0

    assert failed(Decides(), {}, Outcome("RETRY", "fatal")).kind == "FAIL" and failed(Decides(), {}, SUCCESS) == SUCCESS
    assert failed(Decides(), {}, Outcome("RETRY", "throws")).reason.startswith("failure handler threw: ZeroDivisionError")
    merged = FailurePolicy(max_attempts=3).merged(base_ms=200, cap_ms=None)
    assert (merged.max_attempts, merged.base_ms, merged.cap_ms) == (3, 200, 3_600_000)


def test_sinks_and_report(spark, tmp_path):
    from pyspark.sql import Row

    from tideline.operators import reports
    from tideline.schema import HANDLING

    rows = [(2, "a", 1, "w", "t", None, None, T, T + timedelta(seconds=2), "SUCCESS"), (1, "a", 1, "w", "t", "k,1", 'q"x', T, T + timedelta(seconds=1), "SUCCESS"), (1, "a", 2, "w", "t", None, None, T + timedelta(seconds=1), T + timedelta(seconds=3), "FAIL")]
    ledger = spark.createDataFrame(rows, HANDLING)
    sinks.ledger_csv(ledger, f"{tmp_path}/csv")
    lines = [x for f in sorted((tmp_path / "csv").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("seq")]
    assert [x.split(",")[0] for x in lines] == ["1", "1", "2"] and lines[0].split(",")[-2] == "2024-05-01T00:00:01.000000" and ",,," in lines[2]
    publishes = spark.createDataFrame([Row(seq=i, published_at=T) for i in (1, 2, 3)]).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    report = reports.report(ledger, publishes)
    sinks.report_json(report, f"{tmp_path}/json")
    got = spark.read.json(f"{tmp_path}/json").first()
    assert (got["handled"], got["published"], got["p50_ms"], got["max_ms"], got["runs_per_event"]) == (2, 3, 1000.0, 2000.0, 1.0)
    assert reports.summary(report.first()) == "2 of 3 handled, 1/s, 33.3 % coalesced, p50 1.0s, p95 2.0s, p99 2.0s"
    maps = spark.createDataFrame([('{"a":"x\\u0001y\\n\\"z"}',), ("",), (None,)], "m string").select(sinks.map_from_json(F.col("m")).alias("m"))
    back = maps.select("m", sinks.map_from_json(sinks.map_to_json(F.col("m"))).alias("again")).collect()
    assert back[0]["m"] == {"a": 'x\x01y\n"z'} and all(r["m"] == r["again"] for r in back) and back[1]["m"] == back[2]["m"] == {}


def test_long_reasons_are_cut(engine, spark):
    from tideline.operators import transitions as X

    engine.publish(pending(spark, ("a", "ok", 0, 0, None)), T)
    claimed = engine.claim("order", T)
    marks = claimed.select("id", "version", "claimed_by", F.repeat(F.lit("x"), 10_500).alias("reason"), F.lit(T).cast("timestamp_ntz").alias("next_run"))
    assert len(X.mark_retry(engine.store.read("events"), marks).returned.first()["last_fail_reason"]) == 10_000


def test_waiting_and_formats():
    from tideline.policy import AdaptiveWaiter

    w = AdaptiveWaiter(1, 3)
    assert [w.current, *(w.record(0) or w.current for _ in range(4))] == [1, 1.5, 2.25, 3, 3] and w.next_wait(0.5) == 3 and abs(w.next_wait(0) - 2.7) < 1e-9
    w.record(2)
    assert w.current == 1
    assert [scalar.human_bytes(n) for n in (5, 1536, 3 << 20, 5 << 30)] == ["5B", "1.5KB", "3.0MB", "5.00GB"] and [scalar.human_ms(x) for x in (999, 1500)] == ["999ms", "1.5s"]
    with pytest.raises(ValueError):
        AdaptiveWaiter(2, 1)


def test_scalars_and_cursors(spark):
    df = spark.range(1).select(scalar.advisory_hash(F.lit("order-1")).alias("h"), FailurePolicy(jitter=0).delay_ms(F.lit(4)).alias("d"), scalar.round_ms(F.lit(1234)).alias("r"))
    assert tuple(df.first()) == (842140288160000396, 40_000, 1.234)
    assert sinks.decode_cursor(sinks.encode_cursor(T, "x_y")) == (T, "x_y")
    for bad in ("", "x", "2024_", "no-time_x"):
        with pytest.raises(ValueError):
            sinks.decode_cursor(bad)


def test_settle_agrees_with_the_single_transitions(engine, spark):
    from tideline.operators import transitions as X

    engine.publish(pending(spark, *[(f"e{i}", "ok", 0, 0, None) for i in range(5)]), T)
    engine.claim("order", T)
    events = engine.store.read("events")
    routes = {"e0": "delete", "e1": "retry", "e2": "release", "e3": "disable", "e4": "retry"}
    marks = events.select("id", (F.col("version") + (F.col("id") == "e4").cast("int")).alias("version"), "claimed_by").join(spark.createDataFrame(list(routes.items()), "id string, route string"), "id").withColumns({"reason": F.lit("why"), "next_run": F.lit(T + timedelta(hours=1)).cast("timestamp_ntz")})
    marks = marks.union(marks)
    done = X.settle(events, marks.union(marks.where("id = 'e0'").withColumn("route", F.lit("disable"))), T, "w-0")
    stepwise = X.mark_processed(events, marks.where("route = 'delete'")).hot
    for step, route in ((X.mark_retry, "retry"), (X.release, "release"), (X.mark_disabled, "disable")):
        stepwise = step(stepwise, marks.where(F.col("route") == route)).hot
    key = lambda df: sorted(map(repr, df.drop("trace_context").collect()))
    assert key(done.hot) == key(stepwise) and [r["id"] for r in done.archive.collect()] == ["e0"]


def test_appends_add_folders_and_compact_joins_them(engine, spark):
    for i in range(3):
        engine.publish(pending(spark, (f"e{i}", "ok", 0, 0, None)), T)
    assert len(engine.store.folders()["events"]) == 3 and not engine.store.compact("events", 4)
    assert engine.store.compact("events", 3) and len(engine.store.folders()["events"]) == 1 and set(hot(engine)) == {"e0", "e1", "e2"}
