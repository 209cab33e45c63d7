"""Sums kept by changes and purges of clustered relations, against what a full pass gives."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import maintenance, tree
from cairn.plans.clustered import ClusteredTable, purge_relations
from cairn.sources import projects

SF = "/root/testdata/sf0.001"
FILE = "root_id long, path string, parent string, size long, allocated long, device string, inode string"


def tables(spark, rows):
    return spark.createDataFrame(rows, FILE).withColumns({c: F.col(c).cast("binary") for c in ("path", "parent")})


def plain(rows):
    """Figures of every scope by going through all rows."""
    scopes = {}
    for root, _, parent, size, allocated, device, inode in rows:
        parts = parent.split("/")
        for scope in [".", *["/".join(parts[: i + 1]) for i in range(len(parts))]] if parent != "." else ["."]:
            scopes.setdefault((root, scope), []).append((size, allocated, device, inode))
    out = {}
    for key, found in scopes.items():
        objects = {}
        for size, allocated, device, inode in found:
            if device and inode:
                objects.setdefault((device, inode), []).append((allocated, size))
        loose = [f for f in found if not (f[2] and f[3])]
        allocated = sum(f[1] for f in loose) + sum(max(a for a, _ in o) for o in objects.values())
        out[key] = (len(found), sum(f[0] for f in found), allocated, len(loose), len(objects), sum(len(o) - 1 for o in objects.values()), sum(len(set(o)) > 1 for o in objects.values()))
    return out


def told(store):
    return {(r.root_id, r.scope): tuple(r)[2:] for r in store.sizes().collect()}


def inventory(seed, n=160):
    rng = random.Random(seed)
    folders = [".", "a", "a/b", "a/b/c", "a-old", "d"]
    return [(rng.choice((1, 2)), f"f{i}", rng.choice(folders), rng.randrange(4) * 100, rng.choice((4096, 8192)), "1" if rng.random() < 0.9 else "", str(rng.randrange(25) or "")) for i in range(n)]


def edit(rng, rows):
    rows = [r for r in rows if rng.random() > 0.1]
    rows = [(*r[:3], r[3] + 50, *r[4:]) if rng.random() < 0.1 else (*r[:6], str(rng.randrange(1, 25))) if rng.random() < 0.1 else r for r in rows]
    return rows + [(1, f"n{rng.random()}", "new/place", 7, 4096, "1", "3") for _ in range(3)]


def test_sums_after_random_edits_equal_a_full_pass(spark, tmp_path):
    rng, rows = random.Random(5), inventory(1)
    store = maintenance.ScopeLedger(spark, str(tmp_path / "ledger"), 8)
    store.apply(tables(spark, rows).withColumn("sign", F.lit(1).cast("long")), 0)
    assert told(store) == plain(rows)
    for batch in (1, 2):
        after = edit(rng, rows)
        changes = maintenance.signed(tables(spark, rows), tables(spark, after))
        store.apply(changes, batch)
        assert told(store) == plain(after)
        rows = after
    store.apply(changes, 2)  # a batch run again
    assert told(maintenance.ScopeLedger(spark, str(tmp_path / "ledger"), 8)) == plain(rows)
    store.apply(tables(spark, rows).withColumn("sign", F.lit(-1).cast("long")), 3)
    assert told(store) == {}


def test_an_edit_reads_and_writes_the_parts_it_touches(spark, tmp_path):
    rows = inventory(2)
    store = maintenance.ScopeLedger(spark, str(tmp_path / "ledger"), 64)
    first = store.apply(tables(spark, rows).withColumn("sign", F.lit(1).cast("long")), 0)
    one = [(1, "late", "a/b", 10, 4096, "1", "5")]
    counts = store.apply(tables(spark, one).withColumn("sign", F.lit(1).cast("long")), 1)
    assert counts["ledger"] == 1 and counts["sums"] <= 3 and first["ledger"] > 15  # one object, three scopes
    assert told(store) == plain(rows + one)
    written = {p.name for p in (tmp_path / "ledger" / "ledger-0000000001").iterdir() if p.name.startswith("_part")}
    assert len(written) == 1


def test_a_batch_that_broke_off_does_not_count(spark, tmp_path):
    rows = inventory(3)
    store = maintenance.ScopeLedger(spark, str(tmp_path / "ledger"), 4)
    store.apply(tables(spark, rows).withColumn("sign", F.lit(1).cast("long")), 0)
    store.apply(tables(spark, rows[:9]).withColumn("sign", F.lit(-1).cast("long")), 1)
    (tmp_path / "ledger" / "end-0000000001").unlink()
    assert told(store) == plain(rows)


def test_changes_of_another_ledger_are_refused(spark, tmp_path):
    store = maintenance.ScopeLedger(spark, str(tmp_path / "ledger"), 4)
    with pytest.raises(Exception, match="does not belong"):
        store.apply(tables(spark, inventory(4)[:5]).withColumn("sign", F.lit(-1).cast("long")), 0)


def test_ledger_agrees_with_the_report_over_projects(spark, tmp_path):
    e, d = projects.entries(spark, SF).drop("link"), projects.passes(spark, SF)
    live = maintenance.live_files(e, d)
    store = maintenance.ScopeLedger(spark, str(tmp_path / "ledger"), 4)
    store.apply(live.withColumn("sign", F.lit(1).cast("long")), 0)
    want = tree.scope_sizes(e.where("kind = 'file'"), d).where("file_paths > 0").select("root_id", "scope", "file_paths", "logical_bytes", "allocated_bytes", "unknown_inodes", "repeated", "conflicting")
    got = store.sizes().drop("objects")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def clustered(spark, folder, files=12):
    names = [f"{a}{b}/{c}" for a in "abc" for b in ("", "!", "0", "/x", "/x/y") for c in "mnop"] + ["a", "a/x", "a!", "a0", "b", "z\xff"]
    rows = [(r, n.encode("latin-1"), i) for r in (1, 2) for i, n in enumerate(sorted(set(names)))]
    table = ClusteredTable(spark, str(folder))
    table.write(spark.createDataFrame(rows, "root_id long, path binary, n long"), files)
    return table, {(r, p) for r, p, _ in rows}


def keys(df):
    return {(r.root_id, bytes(r.path)) for r in df.collect()}


def below(rows, root, top):
    return {(r, p) for r, p in rows if r == root and (p == top or p.startswith(top + b"/"))}


def test_a_subtree_is_read_from_the_files_that_hold_it(spark, tmp_path):
    table, rows = clustered(spark, tmp_path / "t")
    found = table.subtree(1, b"a/x")
    assert keys(found) == below(rows, 1, b"a/x")
    assert len(found.inputFiles()) <= 3 < table.manifest().count()
    assert keys(table.subtree(1, b".")) == {k for k in rows if k[0] == 1} and keys(table.subtree(3, b"a")) == set()
    assert keys(table.read()) == rows


def test_a_purge_rewrites_the_files_it_meets(spark, tmp_path):
    table, rows = clustered(spark, tmp_path / "t")
    before = {r.file for r in table.manifest().collect()}
    tops = spark.createDataFrame([(1, bytearray(b"a/x")), (2, bytearray(b"none"))], "root_id long, path binary")
    counts = table.purge(tops)
    assert counts["files"] == len(before) and 1 <= counts["rewritten"] <= counts["read"] <= 4
    after = {r.file for r in table.manifest().collect()}
    assert len(before - after) == counts["rewritten"]
    rows -= below(rows, 1, b"a/x")
    assert keys(table.read()) == rows
    keep = spark.createDataFrame([(2, bytearray(b"a"))], "root_id long, path binary")
    table.purge(keep, keep_anchor=True)
    rows -= below(rows, 2, b"a") - {(2, b"a")}
    assert keys(table.read()) == rows
    version = table.version()
    assert table.purge(keep, keep_anchor=True)["rewritten"] == 0 and table.version() == version  # nothing is left to do
    (tmp_path / "t" / f"manifest-{version:08d}" / "_SUCCESS").unlink()  # a purge that broke off
    assert keys(table.read()) != rows and table.version() == version - 1


def test_purges_reach_every_relation_and_refuse_roots(spark, tmp_path):
    tables_ = {n: clustered(spark, tmp_path / n)[0] for n in ("entries", "directories")}
    rows = keys(tables_["entries"].read())
    tops = spark.createDataFrame([(1, bytearray(b"a"), True), (2, bytearray(b"b"), False)], "root_id long, path binary, keep_anchor boolean")
    counts = purge_relations(tables_, tops)
    gone = below(rows, 1, b"a") | below(rows, 2, b"b")
    assert keys(tables_["directories"].read()) == rows - gone
    assert keys(tables_["entries"].read()) == rows - (gone - {(1, b"a")})
    assert counts["entries"]["rewritten"] < counts["entries"]["files"]
    with pytest.raises(ValueError):
        tables_["entries"].purge(spark.createDataFrame([(1, bytearray(b"."))], "root_id long, path binary"))


def test_several_subtrees_are_read_in_turns(spark, tmp_path, monkeypatch):
    from cairn.plans import clustered as stored

    monkeypatch.setattr(stored, "MAX_TOPS", 2)
    table, rows = clustered(spark, tmp_path / "t")
    tops = [(1, b"a/x"), (1, b"b"), (2, b"a"), (2, b"a/x/y"), (2, b"none")]
    found = table.subtrees(spark.createDataFrame([(r, bytearray(t)) for r, t in tops], "root_id long, path binary"))
    got = {(r.root_id, bytes(r._top), bytes(r.path)) for r in found.collect()}
    assert got == {(r, t, p) for r, t in tops for _, p in below(rows, r, t)}
