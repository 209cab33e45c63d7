"""Ledgers that depend on what came before: small cases, brute force, and streams against their batch forms."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from cairn import ledger_reports as reports
from cairn.operators import history, ranking, sessions
from cairn.streaming import ledgers

SF = "/root/testdata/sf0.001"
SAMPLE = "session long, ordinal long, at_us long, cpu_ns long, elapsed_ns long, reason string"
MINUTE = 60_000_000


def outcomes(spark, rows, **more):
    found = sessions.session_charges(spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SAMPLE), **more)
    return [(r.charged_ns, r.outcome, r.reason) for r in found.orderBy("ordinal").collect()]


def test_the_first_fault_ends_a_session(spark):
    ok = lambda at, cpu: (at * MINUTE, cpu, 5, None)
    assert outcomes(spark, [ok(1, 100), ok(2, 40), ok(3, 90)]) == [(100, "charged", None), (0, "unknown", "cpu_observation_regressed"), (0, "refused", None)]
    assert outcomes(spark, [ok(5, 7), ok(4, 9)])[1] == (0, "unknown", "cpu_clock_rollback")
    assert outcomes(spark, [ok(1, None)]) == [(0, "unknown", "cpu_unknown")]
    assert outcomes(spark, [(MINUTE, 7, 0, None), (2 * MINUTE, 8, 0, None)]) == [(7, "charged", None), (0, "unknown", "elapsed_window_invalid")]
    assert outcomes(spark, [ok(1, 5), ok(2, 9)], now_us=60 * MINUTE, idle_us=30 * MINUTE) == [(5, "charged", None), (4, "recovered_unknown", "interrupted_session")]


def test_slots_take_a_sample_where_it_ends(spark):
    rows = [(1, 0, 59 * MINUTE, 10, 1, None), (1, 1, 61 * MINUTE, 30, 1, None), (2, 0, 30 * MINUTE, 5, 1, None), (2, 1, 90 * MINUTE, 4, 1, None), (2, 2, 200 * MINUTE, 9, 1, None)]
    charges = sessions.session_charges(spark.createDataFrame(rows, SAMPLE))
    hours = {r.slot_us // sessions.HOUR_US: (r.charged_ns, r.blocked, r.sessions) for r in sessions.slot_totals(charges, sessions.HOUR_US).collect()}
    assert hours == {0: (15, False, 2), 1: (20, True, 2)}
    assert {r.slot_us: r.charged_ns for r in sessions.slot_totals(charges, sessions.DAY_US).collect()} == {0: 35}


def by_file(df, folder, order, parts=3):
    """Rows in a folder, a file for each part in order, so that each is a batch of a stream."""
    edges = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
    for i, (low, high) in enumerate(zip([float("-inf"), *edges], [*edges, float("inf")])):
        df.where((F.col(order) > low) & (F.col(order) <= high)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by time
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return stream.sparkSession.table(name)


def test_sessions_as_a_stream(spark, tmp_path):
    samples = reports.samples(spark, SF).withColumn("at", F.timestamp_micros("at_us"))
    stream = by_file(samples, str(tmp_path / "in"), "ordinal")
    got = run(ledgers.session_stream(stream, 400 * sessions.DAY_US, "400 days"), "charges")
    want = sessions.session_charges(samples)
    columns = ["session", "ordinal", "at_us", "charged_ns", "outcome", "reason"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_a_timer_closes_a_session_that_nothing_ended(spark, tmp_path):
    rows = [(1, 0, 0, 5, 1, None), (2, 0, 0, 5, 1, None), (2, 1, MINUTE, 4, 1, None), (3, 0, 500 * MINUTE, 1, 1, None), (4, 0, 900 * MINUTE, 1, 1, None)]
    rows = [(*r[:2], r[2] + sessions.DAY_US, *r[3:]) for r in rows]
    samples = spark.createDataFrame(rows, SAMPLE).withColumn("at", F.timestamp_micros("at_us"))
    stream = by_file(samples, str(tmp_path / "in"), "at_us")
    got = run(ledgers.session_stream(stream, 100 * MINUTE), "timed")
    closed = {(r.session, r.outcome, r.reason) for r in got.where("outcome <> 'charged'").collect()}
    assert (1, "recovered_unknown", "interrupted_session") in closed and (2, "unknown", "cpu_observation_regressed") in closed
    assert not [c for c in closed if c[0] == 4] and got.where("session = 2").count() == 2


def test_reservations_settle_once_and_are_never_refunded(spark):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    reserved = spark.createDataFrame([(t, at(0), 10) for t in range(1, 7)], "token long, at string, allowance long").withColumn("at", F.col("at").cast("timestamp"))
    settled = [(1, at(5), 4), (1, at(5), 4), (1, at(6), 9), (2, at(31), 3), (3, at(5), 11), (4, at(0), 0), (9, at(1), 1), (6, at(5), -1)]
    settlements = spark.createDataFrame(settled, "token long, at string, observed long").withColumn("at", F.col("at").cast("timestamp"))
    found = sessions.settled_reservations(reserved, settlements, 30 * MINUTE)
    assert {r.token: (r.status, r.observed) for r in found.collect()} == {1: ("settled", 4), 2: ("unknown", None), 3: ("unknown", None), 4: ("settled", 0), 5: ("unknown", None), 6: ("unknown", None)}
    row = sessions.reservation_ledger(found.where("token <> 5"), reserved.where("token = 5")).first()
    assert (row.reserved, row.observed, row.unknown_reserved, row.outstanding, row.attempts) == (60, 4, 30, 10, 6)


def test_reservations_as_streams(spark, tmp_path):
    reserved, settled = reports.reservations(spark, SF)
    late = F.lit("2024-01-20").cast("timestamp")  # what comes after pushes the watermark over what is compared
    streams = [by_file(df.withColumn("_order", F.unix_micros("at")), str(tmp_path / n), "_order").drop("_order") for n, df in (("r", reserved), ("s", settled))]
    got = run(ledgers.reservation_stream(*streams, reports.WINDOW, "1 hour"), "outcomes").where(F.col("at") < late)
    first = got.groupBy("token", "allowance").agg(F.min(F.struct("settled_at", "observed")).alias("f")).select("token", F.when(F.col("f.observed").isNull(), "unknown").otherwise("settled").alias("status"), "f.observed")
    want = sessions.settled_reservations(reserved, settled, reports.WINDOW).where(F.col("at") < late).select("token", "status", "observed")
    assert sorted(map(str, map(tuple, first.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_admission_as_a_stream_and_in_small_batches(spark, tmp_path):
    requests = reports.consent_requests(spark, SF)
    want = sessions.admissions(requests, "consent", ["event_id"])
    rows = sorted(map(tuple, want.collect()))
    stream = by_file(requests, str(tmp_path / "in"), "event_id")
    assert sorted(map(tuple, run(ledgers.admission_stream(stream, "consent", "event_id"), "admitted").collect())) == rows
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")  # the state is carried from batch to batch
    try:
        assert sorted(map(tuple, want.collect())) == rows
    finally:
        spark.conf.set(key, before)


def test_refused_requests_spend_nothing():
    state, day = sessions.Admission(), sessions.DAY_US
    ask = lambda at, asked, revoked=None: state.admit(at, asked, 100, 250, 0, 10 * day, revoked)
    assert [ask(1, 70), ask(2, 70), ask(3, 30), ask(0, 1), ask(4, 1)] == [("admitted", 70), ("durable_quantum", 0), ("admitted", 30), ("clock_rollback", 0), ("daily_byte_limit", 0)]
    assert [ask(day, 100), ask(2 * day, 100), ask(2 * day + 1, 50), ask(3 * day, 0)] == [("admitted", 100), ("durable_quantum", 0), ("admitted", 50), ("admitted", 0)]
    assert [ask(3 * day, 1), ask(4 * day, 1, 4 * day), ask(10 * day, 1)] == [("lifetime_byte_limit", 0), ("read_consent_revoked", 0), ("read_consent_expired", 0)]
    assert sessions.Admission().admit(1, 200, 100, 250, 0, 10, None) == ("admitted", 64)  # whole blocks of what is left


def chain(n, intent="i"):
    out, before = [], None
    for nth in range(1, n + 1):
        payload = json.dumps({"intent_id": intent, "expected_sequence": nth, "predecessor_id": before, "created_at_us": nth, "kind": "k", "outcome": f"o{nth}"})
        before = "p-" + hashlib.sha256(payload.encode()).hexdigest()
        out.append((intent, nth, before, payload))
    return out


def forged(row, **more):
    payload = json.dumps(json.loads(row[3]) | more)
    return (row[0], row[1], "p-" + hashlib.sha256(payload.encode()).hexdigest(), payload)


@pytest.mark.parametrize(
    "change, broken, reason",
    [
        (lambda c: c, None, None), (lambda c: [], None, "none"), (lambda c: c[:2] + [(*c[2][:3], c[2][3] + " ")] + c[3:], 3, "digest_differs"), (lambda c: c[:1] + c[2:], 2, "sequence_broken"), (lambda c: c[1:], 1, "sequence_broken"),
        (lambda c: c[:2] + [forged(c[2], outcome="x")] + c[3:], 4, "predecessor_differs"), (lambda c: [forged(c[0], intent_id="j")] + c[1:], 1, "other_intent"), (lambda c: c[:4] + [forged(c[4], created_at_us=1)], 5, "time_runs_back"),
        (lambda c: chain(17), 17, "too_many_events"), (lambda c: c + c[-1:], 6, "sequence_broken"), (lambda c: c[:1] + [(*c[1][:3], None)] + c[2:], 2, "digest_differs"), (lambda c: c[:1] + [("i", 2, "p-" + hashlib.sha256(b"no json").hexdigest(), "no json")] + c[2:], 2, "other_intent"),
    ],
)
def test_the_first_broken_link_of_a_journal(spark, change, broken, reason):
    rows = change(chain(5))
    found = history.verified_journal(spark.createDataFrame(rows, "intent_id string, sequence int, id string, payload string"), "p-").collect()
    if not rows:
        assert found == []
    else:
        assert [(r.broken_at, r.reason, r.valid, r.state) for r in found] == [(broken, reason, broken is None, "o5" if broken is None else "outcome_unknown")]


def test_positions_and_turns(spark):
    rng = random.Random(1)
    rows = [(None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 7}", rng.randrange(50), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, v long, id long").repartition(5)
    got = {r.id: r.nth for r in ranking.ranked(df, ["k"], ["v", "id"]).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    assert sorted(r.nth for r in ranking.ranked(df, [], ["id"]).collect()) == list(range(1, 701))
    work = spark.createDataFrame([(1, 10, "source", 5), (1, 11, "source", 3), (1, 12, "maintenance", 0), (2, 20, "maintenance", 0), (3, 30, "source", 99), (3, 31, "source", 1), (4, 40, "source", 1)], "root_id long, id long, kind string, due_at long")
    roots = spark.createDataFrame([(1, True, False), (2, True, True), (3, True, False), (4, False, False), (5, True, False)], "root_id long, enabled boolean, busy boolean")
    turns = lambda **m: [r.id for r in ranking.fair_turns(work, roots, 1, 50, **m).orderBy("turn").collect()]
    assert turns() == [31, 11, 10, 12]
    assert turns(allow_source=False) == [12]
    with pytest.raises(ValueError):
        ranking.fair_turns(work, spark.range(200).selectExpr("id AS root_id", "true AS enabled", "false AS busy"), 0, 0)
