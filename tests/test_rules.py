"""Scalar rules, refusals and plans with known answers."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import digests, paths, scalars
from cairn.operators import hashing, history, ledger, reports, tree
from cairn.plans.store import RecordStore, export, verify_export
from cairn.sources import filesystem, metadata


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "size, expected",
    [(0, []), (98_304, [(0, 98_304)]), (98_305, [(0, 65_536), (65_537, 32_768)]), (98_306, [(0, 32_768), (32_769, 32_768), (65_538, 32_768)])],
)
def test_sample_windows(spark, size, expected):
    assert [tuple(w) for w in one(spark, digests.sample_windows(F.lit(size)))] == expected


@pytest.mark.parametrize("cpu, elapsed, wait", [(10**9, 10**10, 90 * 10**9), (10**8, 10**10, 0), (40 * 10**9, 100 * 10**9, 3600 * 10**9)])
def test_cpu_wait(spark, cpu, elapsed, wait):
    assert one(spark, scalars.cpu_wait(F.lit(cpu), F.lit(elapsed))) == wait


def test_grant_and_pacing(spark):
    big = F.lit(1 << 40)
    assert one(spark, scalars.read_grant(big, F.lit(1000), big, F.lit(5000))) == 960
    assert one(spark, scalars.pacing_cost(F.lit(64), 5 << 20)) == 12_208


def test_containment_is_by_component(spark):
    assert not one(spark, paths.within(F.lit(b"/work/project-old"), F.lit(b"/work/project")))
    assert one(spark, paths.within(F.lit(b"/work/project/x"), F.lit(b"/work/project")))


def test_unsigned_numbers(spark):
    for text, ok in [("0", True), ("18446744073709551615", True), ("18446744073709551616", False), ("011", False), ("", False), ("-1", False)]:
        assert one(spark, paths.is_unsigned(F.lit(text))) is ok


def test_names_that_are_not_utf8_keep_their_order(spark):
    rows = spark.createDataFrame([(bytearray(b"a!"),), (bytearray(b"a/\xff"),), (bytearray(b"a0"),), (bytearray(b"a"),)], "p binary")
    assert [bytes(r.p) for r in rows.where(paths.in_subtree(F.col("p"), b"a")).orderBy("p").collect()] == [b"a", b"a/\xff"]


BAND = [("10", 1, 5, 1), ("10", 2, 5, 1), ("11", 1, 5, 1), ("", 1, 5, 1), ("0", 1, 5, 1), ("011", 1, 5, 1), ("12", 1, 5, 1), ("12", 1, 3, 1), ("12", 1, 5, 2)]


def test_identity_evidence_of_a_band(spark):
    rows = spark.createDataFrame([(i, 2 << 20, "1", inode, g, ctime, 5, a) for i, (inode, g, ctime, a) in enumerate(BAND)], "id long, size long, device string, inode string, generation long, ctime_ns long, mtime_ns long, allocated long")
    band = reports.same_size_bands(rows, 1 << 20).first()
    assert (band.files, band.known_objects, band.repeated, band.unknown, band.conflicting) == (9, 3, 3, 3, 1)


def test_pages_of_equal_sizes(spark):
    mib = 1 << 20
    rows = spark.createDataFrame([(1, 8 * mib), (2, 8 * mib), (3, 8 * mib), (4, 4 * mib), (5, 4 * mib), (6, mib)], "id long, size long")
    rows = rows.withColumns({"root_id": F.lit(1), "path": F.concat(F.lit("f"), "id").cast("binary"), "parent": F.lit(b"."), "kind": F.lit("file"), "skip_reason": F.lit(""), "device": F.lit("1"), "inode": F.col("id").cast("string")})
    rows = rows.withColumns({"ctime_ns": F.lit(1), "generation": F.lit(1)})
    roots = spark.createDataFrame([(1, True)], "id long, enabled boolean")

    def page(after, rows=rows, limit=2):
        found = reports.same_size_page(rows, roots, mib, limit, after).orderBy(F.desc("size"))
        return [tuple(r) for r in found.select("size", "files", "ids", "continues_before", "continues_after").collect()]

    assert page(None) == [(8 * mib, 2, "3,2", False, True)]
    assert page((8 * mib, 2)) == [(8 * mib, 1, "1", True, False), (4 * mib, 1, "5", False, True)]
    assert page((4 * mib, 5)) == [(4 * mib, 1, "4", True, False)]
    skipped = rows.withColumn("skip_reason", F.when(F.col("id").isin(3, 4), "excluded or protected").otherwise(""))
    assert page(None, skipped) == [(8 * mib, 1, "2", False, True)]  # the page is cut first
    assert page(None, skipped, 6) == [(8 * mib, 2, "2,1", False, False)]


def test_largest_files_is_a_bounded_top_k(spark):
    import cairn.catalogue as c

    plan = c.QUERIES["largest_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    with pytest.raises(ValueError):
        reports.largest_files(spark.range(1), spark.range(1), spark.range(1), 202)


WORK = "file_id long, size long, sha256 string, status string, device string, inode string, ctime_ns long, mtime_ns long, allocated long"


def test_keeper_preview_refuses_what_is_not_equal_and_distinct(spark):
    row = lambda i, sha="aa", status="complete", inode=None: (i, 5, sha, status, "1", inode or str(i), 1, 1, 8)
    work = spark.createDataFrame([row(1), row(2), row(3, "bb"), row(4, None, "pending"), row(5, inode="9"), row(6, inode="9")], WORK)
    assert {(r.file_id, r.role) for r in hashing.keeper_preview(work, 1, [2]).collect()} == {(1, "keeper"), (2, "copy")}
    for copies in ([3], [4], [5], [1], [], list(range(2, 30))):
        with pytest.raises(ValueError):
            hashing.keeper_preview(work, 1, copies)


def test_copy_sizes_overflow_is_unknown(spark):
    groups = spark.createDataFrame([(2**62, "aa", 4)], "size long, sha256 string, members long")
    allocated = spark.createDataFrame([(2**62, "aa", None)], "size long, sha256 string, copy_allocated long")
    row = hashing.copy_sizes(groups, allocated).first()
    assert (row.copy_bytes, row.copy_status, row.allocated_status) == (None, "overflow", "overflow")


def test_revisit_intervals(spark):
    days = [("2024-01-01", False), ("2024-01-02", False), ("2024-01-03", False), ("2024-01-04", True)]
    rows = spark.createDataFrame([(1, d, c, False) for d, c in days], "user_id long, day string, changed boolean, unknown boolean")
    assert [(r.streak, r.interval_hours) for r in ledger.adaptive_revisits(rows).orderBy("day").collect()] == [(0, 24), (1, 24), (2, 168), (0, 24)]


def test_empty_page_is_zero_not_unknown(spark):
    empty = spark.createDataFrame([], "logical_bytes long, allocated_bytes long, status string")
    row = tree.page_size_summary(empty, spark.createDataFrame([], "a long, b long")).first()
    assert (row.folders, row.logical_bytes, row.allocated_bytes, row.logical_reason) == (0, 0, 0, None)


def test_selection_is_refused_when_one_is_gone(spark):
    findings = spark.createDataFrame([(1, "selected"), (2, "age_not_met")], "id long, outcome string")
    assert history.exact_selection(findings, [1]).count() == 1
    with pytest.raises(ValueError):
        history.exact_selection(findings, [1, 2])


def test_tree_roles(spark):
    rows = spark.createDataFrame([(".",), (".bin",), (".bin/x",), ("@s",), ("@s/p",), ("p",), ("p/lib/x",)], "p string")
    assert [r.v for r in rows.select(tree.tree_role(F.col("p")).alias("v")).collect()] == ["boundary", "bin", "bin", "scope", "package", "package", "content"]


def test_filesystem_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filesystem, "BATCH", 2)
    top, store = tmp_path / "tree", str(tmp_path / "store")
    for folder in ("a/.git", "b", "c"):
        (top / folder).mkdir(parents=True)
    for name in ("a/.git/hidden", "b/inside", "c/g"):
        (top / name).write_text("x")
    (top / "a" / "f").write_text("hello")
    (top / "a" / "link").symlink_to("f")
    (top / "a" / "hard").hardlink_to(top / "a" / "f")
    entries, passes = filesystem.scan_tree(spark, str(top), store, 2, exclude=(b"b",))
    rows = {bytes(r.path): r for r in entries.collect()}
    assert set(rows) == {b"a", b"b", b"c", b"a/.git", b"a/f", b"a/link", b"a/hard", b"c/g"}
    assert rows[b"a/f"].inode == rows[b"a/hard"].inode and rows[b"a/f"].size == 5
    assert rows[b"a/link"].kind == "symlink" and rows[b"a/.git"].skip_reason == rows[b"b"].skip_reason == "excluded or protected"
    assert {bytes(r.path) for r in passes.where("complete").collect()} == {b".", b"a", b"c"}
    (top / "late").write_text("x")  # a scan begun again keeps the levels it has
    assert filesystem.scan_tree(spark, str(top), store, 2)[0].count() == len(rows)
    gone = next(filesystem.list_directory(str(top).encode(), b"none", 0, frozenset()))
    assert gone[0][2] == filesystem.LISTING and gone[0][9]


def test_locks_engines_and_power(spark):
    lock = '{"lockfileVersion": 3, "packages": {"": {"dependencies": {"x": "1"}}, "node_modules/x": {}, "node_modules/@s/y": {}}}'
    cases = [('{"dependencies": {"x": "1"}}', lock, "supported"), ('{"dependencies": {"x": "2"}}', lock, "manifest_differs"), ('{"a": 1, "a": 2}', lock, "malformed"), ("{}", '{"lockfileVersion": 1}', "unsupported_version")]
    rows = spark.createDataFrame(cases, "m string, l string, want string")
    found = rows.select("want", metadata.lock_layout("m", "l").alias("v")).collect()
    assert all(r.want == r.v.status for r in found)
    assert found[0].v.packages == ["node_modules/@s/y", "node_modules/x"]
    images = metadata.engine_images(spark.createDataFrame([("c", '[{"Id": "i", "RepoTags": ["b", "a"], "Created": 5}]')], "context string, body string"))
    assert tuple(images.first()) == ("c", "i", "a,b", 5, False)


def test_power_supplies(spark):
    # host, name, scope, type, online, present, status
    rows = [
        ("h", "a", "System", "Mains", "1", None, None), ("h", "b", "System", "Battery", None, "1", "Discharging"), ("h", "c", "Device", "Battery", None, "1", "Discharging"),
        ("k", "a", "System", "Battery", None, "1", "Not charging"), ("k", "b", "System", "Battery", None, "0", "Discharging"), ("l", "b", None, "Battery", None, "1", "Full"), ("l", "a", "System", "Battery", None, None, "Full"),
        ("m", "a", "System", "Solar", "1", None, None), ("n", "a", "System", "USB_C", "3", None, None),
    ]
    found = metadata.power_state(spark.createDataFrame(rows, "host string, name string, scope string, type string, online string, present string, status string"))
    assert {r.host: (r.reason, r.confirmed_batteries, r.discharging_batteries, r.ambiguous) for r in found.collect()} == {
        "h": ("confirmed_system_battery_discharge_witness", 1, 1, 0), "k": ("no_system_battery_discharge_witness", 1, 0, 0), "l": ("battery_presence_unconfirmed", 0, 0, 2),
        "m": ("supply_type_outside_profile", 0, 0, 1), "n": ("external_supply_unconfirmed", 0, 0, 1),
    }


def test_records_are_content_addressed_and_never_change(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "records"), "plan_")
    payloads = spark.createDataFrame([("a",), ("b",), ("a",)], "payload string")
    assert store.append(payloads).count() == 2
    store.append(payloads)
    assert store.read().count() == 2 and store.is_valid()
    with pytest.raises(ValueError):
        store.append(spark.range(200).select(F.col("id").cast("string").alias("payload")))
    export(store.read(), str(tmp_path / "copy"))
    assert verify_export(spark, str(tmp_path / "copy"), store.read())
    assert not verify_export(spark, str(tmp_path / "copy"), payloads.selectExpr("payload as id", "payload"))
