"""Streams give the rows that the batch reports give."""

from pyspark.sql import functions as F

from cairn.operators import ledger
from cairn.sources import adapters
from cairn.streaming import observations as obs

SF = "/root/testdata/sf0.001"


def split(spark, folder, parts=3):
    events = spark.read.parquet(f"{SF}/events.parquet")
    low, high = events.agg(F.min("event_id"), F.max("event_id") + 1).first()
    for i in range(parts):
        a, b = low + (high - low) * i // parts, low + (high - low) * (i + 1) // parts
        events.where((F.col("event_id") >= a) & (F.col("event_id") < b)).coalesce(1).write.mode("append").parquet(folder)


def test_latest_rows_by_micro_batch(spark, tmp_path):
    split(spark, str(tmp_path / "in"))
    table = obs.LatestTable(spark, str(tmp_path / "latest"), ["user_id"], ["ts", "event_id"])
    query = table.follow(obs.read_observations(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    want = ledger.latest_observation(adapters.observations(spark, SF)).select("user_id", "event_id")
    assert sorted(map(tuple, table.read().select("user_id", "event_id").collect())) == sorted(map(tuple, want.collect()))


def test_latest_rows_survive_restarts_and_repeated_batches(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "user_id long, ts long, event_id long")
    open_ = lambda: obs.LatestTable(spark, str(tmp_path / "t"), ["user_id"], ["ts", "event_id"], parts=3)
    open_().write_batch(rows((1, 5, 1), (2, 5, 2), (3, 5, 3)), 0)
    table = open_()  # as after a restart
    table.write_batch(rows((1, 4, 9), (2, 6, 4), (8, 1, 5)), 1)
    want = [(1, 5, 1), (2, 6, 4), (3, 5, 3), (8, 1, 5)]
    assert sorted(map(tuple, open_().read().collect())) == want
    open_().write_batch(rows((1, 4, 9), (2, 6, 4), (8, 1, 5)), 1)  # the same batch again
    assert sorted(map(tuple, open_().read().collect())) == want
    (tmp_path / "t" / "batch-0000000001" / "_SUCCESS").unlink()  # a batch that ended half-way does not count
    assert sorted(map(tuple, open_().read().collect())) == [(1, 5, 1), (2, 5, 2), (3, 5, 3)]
    open_().write_batch(rows((1, 4, 9), (2, 6, 4), (8, 1, 5)), 1)
    assert open_().clean() >= 1 and sorted(map(tuple, open_().read().collect())) == want and open_().clean() == 0


def test_daily_totals_as_a_stream(spark, tmp_path):
    split(spark, str(tmp_path / "in"))
    stream = obs.daily_totals(obs.read_observations(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = ledger.reservation_totals(adapters.reservations(spark, SF)).where("day is not null").select("day", "reserved", "attempts")
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, want.collect()))


def test_revisit_state_matches_the_batch_form(spark, tmp_path):
    passes = adapters.passes(spark, SF)
    passes.orderBy("day").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(passes.schema).parquet(str(tmp_path / "in"))
    query = obs.revisit_stream(stream).writeStream.format("memory").queryName("revisits").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = ledger.adaptive_revisits(passes).select("user_id", "day", "streak", "interval_hours")
    got = spark.table("revisits")
    assert got.where("rollback").isEmpty()
    assert sorted(map(tuple, got.drop("rollback").collect())) == sorted(map(tuple, want.collect()))


def test_refresh_phases_as_a_stream(spark, tmp_path):
    script = {
        1: [("request", None, True, "pending"), ("activate", None, False, "pending"), ("activate", None, True, "active"), ("request", None, True, "active"), ("witness", 7, True, "active"), ("restart", None, True, "active"), ("finalize", 7, True, "completed")],
        2: [("activate", None, True, "none"), ("request", None, True, "pending"), ("activate", None, True, "active"), ("restart", None, True, "unknown"), ("finalize", 7, True, "unknown"), ("request", None, True, "pending")],
        3: [("request", None, True, "pending"), ("activate", None, True, "active"), ("witness", 7, True, "active"), ("finalize", 8, True, "unknown")],
    }
    schema = "root_id long, at long, kind string, generation long, ok boolean"
    for part in range(2):  # two batches: the state outlives the first
        rows = [(root, at, *event[:3]) for root, events in script.items() for at, event in enumerate(events) if (at >= 3) == part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = obs.refresh_stream(stream).writeStream.format("memory").queryName("refreshes").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.root_id, r.at): r.phase for r in spark.table("refreshes").collect()}
    assert got == {(root, at): event[3] for root, events in script.items() for at, event in enumerate(events)}
    assert spark.table("refreshes").where("phase = 'completed'").first().qualification == "historical_pass_completed"
