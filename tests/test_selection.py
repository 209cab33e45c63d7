"""Cursors, frozen selections, records and guards."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import cursors, scalars
from cairn.operators import selection
from cairn.plans import store

INVENTORY = "ab" * 32


def test_cursors_have_one_form_and_one_inventory():
    token = cursors.encode(INVENTORY, 64, 100, 7)
    assert cursors.decode(token, INVENTORY, 64) == (100, 7)
    for other in (token + "=", token[:-1], "", "x" * 600, cursors.encode(INVENTORY, 64, 10, 7), cursors.encode("AB" * 32, 64, 100, 7), cursors.encode(INVENTORY, 64, 100, 0)):
        with pytest.raises(ValueError):
            cursors.decode(other, INVENTORY, 64)
    with pytest.raises(ValueError, match="another"):
        cursors.decode(token, INVENTORY, 65)


def files(spark):
    rows = [(1, 1, b"a/b/f", b"a/b", "file", 5, 50, ""), (2, 1, b"a/g", b"a", "file", 6, 60, ""), (3, 1, b"c/h", b"c", "file", 7, 70, ""), (4, 1, b"a/s", b"a", "file", 8, 80, "excluded or protected")]
    e = spark.createDataFrame(rows, "id long, root_id long, path binary, parent binary, kind string, size long, mtime_ns long, skip_reason string")
    e = e.withColumns({"device": F.lit("1"), "inode": F.col("id").cast("string"), "ctime_ns": F.col("mtime_ns"), "generation": F.lit(1).cast("long")})
    d = spark.createDataFrame([(1, b"a", True, ""), (1, b"a/b", True, ""), (1, b"c", False, "")], "root_id long, path binary, complete boolean, last_error string")
    return e, d


def test_selection_is_whole_or_refused(spark):
    e, d = files(spark)
    shown = lambda *rows: spark.createDataFrame(rows, "id long, size long, mtime_ns long")
    found = selection.select_files(e, d, shown((1, 5, 50), (2, 6, 60))).collect()
    assert sorted((r.id, r.binding.inode) for r in found) == [(1, "1"), (2, "2")]
    for rows in ([(1, 5, 51)], [(1, 5, 50), (1, 5, 50)], [(9, 1, 1)], [(4, 8, 80)], [(i, 1, 1) for i in range(21)]):
        with pytest.raises(ValueError):
            selection.select_files(e, d, shown(*rows))
    chains = {r.id: r.chain_valid for r in selection.ancestor_chains(e, d).collect()}
    assert chains == {1: True, 2: True, 3: False, 4: True}


def test_waits_have_guards(spark):
    rows = spark.createDataFrame([(10**17, 1), (-5, 10), (5, 0), (5, -10), (1, 50)], "cpu long, elapsed long")
    got = [r[0] for r in rows.select(scalars.cpu_wait(F.col("cpu"), F.col("elapsed"))).collect()]
    assert got == [scalars.HOUR_NS, 0, 0, 0, 50]


def test_two_writers_keep_each_others_records(spark, tmp_path, monkeypatch):
    payload = lambda *p: spark.createDataFrame([(x,) for x in p], "payload string")
    a, b = (store.RecordStore(spark, str(tmp_path / "r"), "x_") for _ in range(2))
    a.append(payload("one"))
    stale = a.version()
    b.append(payload("two"))
    versions = iter([stale])
    monkeypatch.setattr(a, "version", lambda: next(versions, None) or store.RecordStore.version(a))  # read before the other wrote
    a.append(payload("three", "one"))
    assert sorted(r.payload for r in b.read().collect()) == ["one", "three", "two"] and b.is_valid()
    with pytest.raises(ValueError):
        b.append(payload(*map(str, range(126))))
    (tmp_path / "r" / ".claim-0000000004").touch()  # a writer that never came back
    monkeypatch.setattr(store, "CLAIM_SECONDS", -1)
    b.append(payload("four"))
    assert b.read().count() == 4
