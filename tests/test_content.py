"""Files read by range, and scans that go on where they were broken off."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from cairn.functions import digests
from cairn.sources import content, filesystem

WINDOW = digests.WINDOW
SIZES = [0, 1, WINDOW, 3 * WINDOW, 3 * WINDOW + 1, 3 * WINDOW + 2, 5 * WINDOW, 3 << 20]


def saved(spark, paths):
    rows = []
    for i, p in enumerate(paths):
        s = os.stat(p)
        rows.append((i, os.fsencode(str(p)), s.st_size, s.st_mtime_ns, s.st_ctime_ns, str(s.st_dev), str(s.st_ino)))
    return spark.createDataFrame(rows, "id long, path binary, size long, mtime_ns long, ctime_ns long, device string, inode string")


@pytest.fixture()
def files(tmp_path):
    out = []
    for i, size in enumerate(SIZES):
        out.append(tmp_path / f"f{i}")
        out[-1].write_bytes(os.urandom(size))
    return out


def test_samples_read_three_windows_and_equal_those_of_whole_contents(spark, files):
    found = {r.id: r for r in content.sample_files(saved(spark, files), "sample", tasks=3).collect()}
    whole = spark.createDataFrame([(i, f.read_bytes()) for i, f in enumerate(files)], "id long, b binary")
    want = {r.id: r.d for r in whole.select("id", digests.sample_digest(F.col("b"), "sample").alias("d")).collect()}
    assert {i: r.digest for i, r in found.items()} == want
    assert all(r.requested == r.read == min(size, 3 * WINDOW) for r, size in zip((found[i] for i in range(len(SIZES))), SIZES))


def test_whole_digests(spark, files):
    found = {r.id: (r.status, r.sha256, r.read) for r in content.hash_files(saved(spark, files), tasks=2).collect()}
    assert found == {i: ("complete", hashlib.sha256(f.read_bytes()).hexdigest(), len(f.read_bytes())) for i, f in enumerate(files)}


def test_files_that_are_no_longer_what_was_saved_are_blocked(spark, files, tmp_path):
    rows = saved(spark, files)
    files[1].unlink()
    files[2].write_bytes(b"x" * WINDOW)
    files[3].unlink()
    files[3].symlink_to(files[4])
    files[5].unlink()
    files[5].mkdir()
    for found in (content.sample_files(rows, "sample").collect(), content.hash_files(rows).collect()):
        codes = {r.id: r.code for r in found}
        assert (codes[1], codes[2], codes[3], codes[5]) == ("missing", "file_changed", "unreadable", "not_regular_file")
        assert all(r.status == ("blocked" if r.code else "complete") for r in found) and codes[0] == codes[4] == codes[6] == codes[7] == ""
        assert sum(r.read for r in found if r.code) == 0


def test_rows_that_disagree_about_an_object_are_blocked_unread(spark, files):
    rows = saved(spark, files)
    twice = rows.union(rows.where("id = 4").withColumns({"id": F.lit(99).cast("long"), "size": F.col("size") - 1}))
    found = {r.id: (r.code, r.requested) for r in content.sample_files(twice, "sample").collect()}
    assert found[4] == found[99] == ("identity_conflict", 0) and found[7][0] == ""


def test_no_files(spark):
    none = saved(spark, [])
    assert content.sample_files(none, "sample").count() == content.hash_files(none).count() == 0


def test_a_scan_goes_on_inside_a_directory(spark, tmp_path, monkeypatch):
    top, store = tmp_path / "tree", str(tmp_path / "store")
    (top / "big").mkdir(parents=True)
    for i in range(25):
        (top / "big" / f"{i:03d}").write_text("x")
    (top / "big" / "sub").mkdir()
    (top / "big" / "sub" / "f").write_text("x")
    filesystem.scan_tree(spark, str(top), store, 2, step=10, steps=2)  # broken off after ten children of the directory
    told = spark.read.parquet(f"{store}/step-000001").where("kind <> 'cursor'").count()
    assert told == 10
    listed = []
    plain = os.scandir
    monkeypatch.setattr(os, "scandir", lambda *a: listed.append(a) or plain(*a))
    (top / "big" / "0000").write_text("late")  # before the place where the scan stands
    entries, passes = filesystem.scan_tree(spark, str(top), store, 2, step=10)
    paths = sorted(bytes(r.path) for r in entries.collect())
    assert paths == sorted([b"big", b"big/sub", b"big/sub/f"] + [b"big/%03d" % i for i in range(25)])
    assert {bytes(r.path) for r in passes.where("complete").collect()} == {b".", b"big", b"big/sub"}
    again, _ = filesystem.scan_tree(spark, str(top), store, 2, step=10)  # nothing is left to do
    assert again.count() == len(paths)


def test_a_large_directory_is_read_once_and_told_in_few_steps(spark, tmp_path, monkeypatch):
    top, store = tmp_path / "tree", str(tmp_path / "store")
    (top / "big").mkdir(parents=True)
    for i in range(103):
        (top / "big" / f"{i:03d}").write_text("x")
    entries, passes = filesystem.scan_tree(spark, str(top), store, 2, step=5)
    assert sorted(bytes(r.path) for r in entries.collect()) == [b"big"] + [b"big/%03d" % i for i in range(103)]
    assert {bytes(r.path) for r in passes.where("complete").collect()} == {b".", b"big"} and passes.count() == 2
    assert len(list((tmp_path / "store").glob("step-*"))) == 3
    listed, plain = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda *a: listed.append(a) or plain(*a))
    rows = [r for batch in filesystem.list_directory(os.fsencode(top), b"big", os.lstat(top).st_dev, frozenset(), 5) for r in batch]
    assert len(listed) == 1 and sum(r[2] == "file" for r in rows) == 5 and sum(r[1].count(b"/") + 1 for r in rows if r[2] == filesystem.CURSOR) == 98
    assert [r[3] for r in rows if r[2] == filesystem.CURSOR] == [0] * 19 + [1]


def test_contents_do_not_move_and_rows_go_back_in_batches(spark, tmp_path):
    rows = spark.range(2500).select("id", F.encode(F.concat(F.lit("x"), "id"), "utf-8").alias("content"), F.expr("cast(id div 1000 as string)").alias("folder"))
    written = content.write_files(rows, str(tmp_path))
    assert "Exchange" not in written._jdf.queryExecution().toString()
    saved_rows = written.localCheckpoint()
    assert {r.id: bytes(r.path) for r in saved_rows.collect()} == {i: os.fsencode(f"{tmp_path}/{i // 1000}/f{i}") for i in range(2500)}
    found = content.read_ranges(saved_rows.withColumns({"start": F.lit(0).cast("long"), "length": F.col("size")}))
    assert {r.id: bytes(r.content) for r in found.collect()} == {i: b"x%d" % i for i in range(2500)}
    values = [(i, 0, 1, b"y" * (1 + (i == 3) * content.BYTES_OF_BATCH), "", 1, 1) for i in range(2500)]
    batches = list(content._batches(values, content._schema(content._RANGE)))
    assert [b.num_rows for b in batches] == [4, 1000, 1000, 496] and sum((b.column(0).to_pylist() for b in batches), []) == list(range(2500))
