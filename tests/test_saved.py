"""Refusals and bounds of what is saved and read again."""

import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import cursors, scalars
from cairn.operators import hashing, history, reconcile, sessions, tree
from cairn.sources import metadata, schema


def test_cursors_of_findings_belong_to_their_age():
    assert cursors.encode_finding(7) == "nm1:7" and cursors.encode_finding(7, 30) == "nm2:30:7"
    assert cursors.decode_finding("nm1:7") == 7 and cursors.decode_finding("nm2:30:7", 30) == 7
    for token, days in [("nm1:7", 30), ("nm2:30:7", 90), ("nm2:30:7", 31), ("nm2:90:7", 90), ("nm1:0", 90), ("nm1:07", 90), ("nm1:-1", 90), ("nm1:", 90), ("7", 90), ("nm1:9223372036854775808", 90), ("nm1:7", 0), ("nm2:40000:7", 40_000)]:
        with pytest.raises(ValueError):
            cursors.decode_finding(token, days)


def test_a_store_of_roots_is_bounded_and_refuses_as_a_whole(spark):
    saved = spark.createDataFrame([(f"/r{i}", True) for i in range(3)], "path string, enabled boolean")
    wanted = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    assert {(r.path, r.action) for r in reconcile.admit_roots(wanted("/r0", "/n"), saved, 4).collect()} == {("/r0", "kept"), ("/n", "added"), ("/r1", "disabled"), ("/r2", "disabled")}
    with pytest.raises(ValueError):
        reconcile.admit_roots(wanted("/n", "/m"), saved, 4)
    assert reconcile.admit_roots(wanted("/r0"), saved, 3).count() == 3  # nothing new
    with pytest.raises(ValueError):
        reconcile.admit_roots(wanted("/r0"), saved, 2)


def test_sizes_for_people_agree_in_both_forms(spark):
    sizes = [0, 1, 1023, 1024, 1536, 1280, 1792, 12845056, 1 << 20, (1 << 30) - 1, 5 << 40, 3 << 60]
    found = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", scalars.human_size(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in found} == {s: scalars.human_bytes(s) for s in sizes}


def test_differences_count_repeats_and_match_nulls(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    b = spark.createDataFrame([(1, None), (3, "y")], "a int, b string")
    assert {tuple(r) for r in reconcile.differences(a, b).collect()} == {(1, None, 1), (2, "x", 1), (3, "y", -1)}
    assert reconcile.differences(a, a).isEmpty()


REPORT = "version int, files array<struct<id:bigint,size:bigint>>"


def told(tmp_path, name, *lines):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "part.json").write_text("\n".join(lines))
    return str(folder)


def test_reports_with_anything_else_are_refused(spark, tmp_path):
    from pyspark.sql.types import StructType

    declared = StructType.fromDDL(REPORT)
    file = {"id": 1, "size": 2}
    body = lambda **more: json.dumps({"version": 1, "files": [file]} | more, separators=(",", ":"))
    assert [tuple(r) for r in schema.read_report(spark, told(tmp_path, "ok", body()), declared).collect()] == [(1, 2)]
    bad = {
        "more": body(other=1), "less": '{"files":[{"id":1,"size":2}]}', "twice": '{"version":1,"version":1,"files":[{"id":1,"size":2}]}', "case": '{"Version":1,"files":[{"id":1,"size":2}]}', "type": '{"version":"1","files":[{"id":1,"size":2}]}',
        "none": body(files=[]), "many": body(files=[file] * 21), "large": body(files=[{"id": 1, "size": 2}]) + " " * (1 << 20), "text": "no json",
    }
    for name, text in bad.items():
        with pytest.raises(Exception):
            schema.read_report(spark, told(tmp_path, name, text), declared).collect()
    with pytest.raises(ValueError):
        schema.read_report(spark, told(tmp_path, "lines", body(), body()), declared)


def test_checks_of_a_dataset_stop_at_the_first_failure(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 1, None, "")], "root_id long, epoch long, changed long, unknown boolean, x string")
    good = rows.selectExpr("root_id", "epoch", "true AS changed", "unknown", "cast(5 AS bigint) AS finished_ns")
    schema.write_relation(good, str(tmp_path), "passes")
    found = {r.check: r.status for r in schema.dataset_checks(spark, str(tmp_path), {"passes": ["root_id", "epoch"]}).collect()}
    assert set(found.values()) == {"ok"} and len(found) == 7
    (tmp_path / "passes.parquet" / "_SUCCESS").unlink()
    found = {r.check: r.status for r in schema.dataset_checks(spark, str(tmp_path), {"passes": ["root_id"]}).collect()}
    assert (found["exists"], found["written_whole"], found["schema"]) == ("ok", "failed", "not_checked")
    schema.write_relation(good.withColumn("root_id", F.lit(None).cast("long")), str(tmp_path / "b"), "passes")
    assert [r.status for r in schema.dataset_checks(spark, str(tmp_path / "b"), {"passes": ["root_id"]}).collect()][-2:] == ["failed", "not_checked"]


def test_a_relation_of_another_schema_is_refused(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/passes.parquet")
    with pytest.raises(ValueError):
        schema.read_relation(spark, str(tmp_path), "passes")


def test_dismissals_that_were_undone_stay_undone(spark):
    script = [("save", "a", "dismissed", 1), ("save", "a", "dismissed", 1), ("undo", "a", "undone", 1), ("save", "a", "undone", 1), ("undo", "a", "undone", 1), ("undo", "b", "not_found", 1), ("save", "b", "dismissed", 2), ("save", "c", "capacity_reached", 2), ("save", "b", "dismissed", 2)]
    rows = [(s, i, action, request) for s in (1, 2) for i, (action, request, _, _) in enumerate(script)]
    found = sessions.dismissal_history(spark.createDataFrame(rows, "store long, ordinal long, action string, request_id string"), "store", 2)
    for s in (1, 2):
        assert [(r.state, r.records) for r in found.where(F.col("store") == s).orderBy("ordinal").collect()] == [(state, n) for _, _, state, n in script]


def test_paced_dispatches(spark):
    hour, day = sessions.HOUR_US, sessions.DAY_US
    script = [(0, "dispatched", 1), (hour - 1, "cadence", 1), (hour, "dispatched", 2), (2 * hour, "daily_chunk_limit", 2), (-1, "clock_rollback", 2), (day, "dispatched", 1), (day - 1, "clock_rollback", 1)]
    rows = [(1, i, day * 5 + at) for i, (at, _, _) in enumerate(script)]
    found = sessions.dispatches(spark.createDataFrame(rows, "scope long, ordinal long, at_us long"), "scope", hour, 2)
    assert [(r.outcome, r.used) for r in found.orderBy("ordinal").collect()] == [(o, n) for _, o, n in script]


def test_second_selections_conflict(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 9, "b"), (2, 12, "a")]
    found = sessions.kept_selections(spark.createDataFrame(rows, "store long, ordinal long, payload string"))
    assert {(r.store, r.ordinal): r.state for r in found.collect()} == {(1, 1): "created", (1, 2): "existing", (1, 3): "conflict", (2, 9): "created", (2, 12): "conflict"}


def test_snapshots_of_hash_work(spark):
    sha = "a" * 64
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    work = [(1, 1, "complete", 10, 10, sha), (1, 2, "running", 10, 0, None), (2, 1, "complete", 10, 4, sha), (3, 1, "pending", 10, 0, None), (4, 1, "pending", 10, 11, None), (5, 1, "complete", 10, 10, "xyz")]
    found = hashing.hash_snapshot(
        frame([(1, 2), (2, 1), (3, 2), (4, 1), (5, 1), (6, 0), (7, 1)], "selection_id long, targets long"), frame(work, "selection_id long, work_id long, status string, size long, durable_offset long, sha256 string"),
        frame([(1, 2, "2024-01-01", 5, "reserved")], "selection_id long, work_id long, day string, reserved long, status string"), frame([(1, "2024-01-01", 5)], "selection_id long, day string, total_reserved long"),
    )
    assert {r.selection_id: (r.reason, r.files) for r in found.collect()} == {
        1: (None, 2), 2: ("completed_without_digest", None), 3: ("files_do_not_match", None), 4: ("offset_outside_file", None), 5: ("completed_without_digest", None), 6: (None, 0), 7: ("files_do_not_match", None),
    }


def test_trees_that_change_between_passes(spark):
    rows = [("a", "p", "x"), ("a", "q", "y"), ("b", "p", "x"), ("c", "p", "x")]
    first = spark.createDataFrame(rows, "tree string, path string, fields string")
    second = spark.createDataFrame([*rows[:2], ("b", "p", "z"), ("d", "p", "x")], "tree string, path string, fields string")
    found = {r.tree: (r.status, r.digest is None) for r in tree.stable_trees(first, second).collect()}
    assert found == {"a": ("metadata_observed", False), **{t: ("tree_changed_during_check", True) for t in "bcd"}}


def test_containers_of_an_engine(spark):
    body = json.dumps([{"Id": "c1", "Image": "i", "State": "running", "Created": 5}, {"Id": "c2", "Image": "j", "State": "weird", "Created": 6}])
    found = metadata.engine_containers(spark.createDataFrame([("x", body), ("y", "[]")], "context string, body string")).collect()
    assert [tuple(r) for r in found] == [("x", "c1", "i", "running", 5, False), ("x", "c2", "j", "unknown", 6, False)]


def test_plans_are_approved_once_and_revoked_for_good(spark):
    day = sessions.DAY_US
    script = [
        ("use", 0, "absent", "refused"), ("approve", 0, "absent", "refused"), ("save", 0, "pending", "created"), ("save", 0, "pending", "existing"), ("use", 0, "pending", "refused"), ("revoke", 0, "pending", "refused"), ("approve", 5, "approved", "recorded"),
        ("approve", 9, "approved", "existing"), ("use", 9, "approved", "allowed"), ("use", day + 5, "expired", "refused"), ("approve", day + 6, "expired", "refused"), ("revoke", day + 7, "revoked", "recorded"), ("revoke", day + 8, "revoked", "existing"), ("use", 6, "revoked", "refused"),
    ]
    rows = [(p, i, action, at) for p in (1, 2) for i, (action, at, _, _) in enumerate(script)]
    found = sessions.plan_history(spark.createDataFrame(rows, "plan_id long, ordinal long, action string, at_us long"))
    for p in (1, 2):
        assert [(r.state, r.result) for r in found.where(F.col("plan_id") == p).orderBy("ordinal").collect()] == [(s, r) for _, _, s, r in script]


def test_changes_are_told_in_order_and_blocked_outweighs(spark):
    columns = [c for _, own in history.CHANGES for c in own]
    ddl = "observation_id long, finding_id long, " + ", ".join(f"{c} string" for c in columns)
    base = spark.createDataFrame([(o, f, *"abcdefghijk"[: len(columns)]) for o, f in [(1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1)]], ddl)
    row = lambda o, f, status="observed", code="", **more: (o, f, *[more.get(c, v) for c, v in zip(columns, "abcdefghijk")], status, code)
    none = dict.fromkeys(columns)
    live = [row(1, 1), row(1, 2, internal_links="z", lock_sha256="z"), row(2, 1, "blocked", "tree_limit", **none), row(3, 1), row(5, 1, entries=None)]
    found = history.compare_observations(base, spark.createDataFrame(live, ddl + ", status string, code string"))
    assert {(r.observation_id, r.finding_id): (r.status, r.code, r.changes, r.observation_status) for r in found.collect()} == {
        (1, 1): ("matches_observation", None, "", "changed"), (1, 2): ("changed", None, "lock_bytes_changed,tree_counts_changed", "changed"), (2, 1): ("blocked", "tree_limit", "", "blocked"),
        (3, 1): ("matches_observation", None, "", "matches_observation"), (4, 1): ("no_evidence", None, "", "no_evidence"), (5, 1): ("no_evidence", None, "", "no_evidence"),
    }
