"""Measures and rules on small trees worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators import reconcile, reports, rules, tree
from tests import fixtures as fx

ENTRY = "id long, root_id long, path string, parent string, kind string, size long, allocated long, mtime_ns long, ctime_ns long, device string, inode string, generation long, observed_at_ns long, skip_reason string"
PASS = "root_id long, path string, generation long, complete boolean, checked_at_ns long, last_error string"


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY).withColumns({c: F.col(c).cast("binary") for c in ("path", "parent")})


def passes(spark, rows):
    return spark.createDataFrame(rows, PASS).withColumn("path", F.col("path").cast("binary"))


def outcomes(df):
    return {r.id: r.outcome for r in df.collect()}


def test_measures_of_linked_sparse_missing_and_gone_rows(spark):
    scopes = spark.createDataFrame(fx.SCOPES, "root_id long, scope string")
    found = tree.measure_directories(entries(spark, fx.TREE), passes(spark, fx.TREE_PASSES), scopes)
    columns = "root_id scope status entries_examined excluded_entries file_paths logical_bytes allocated_bytes repeated unconfirmed".split()
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == sorted(m[:10] for m in fx.MEASURED)
    assert {(r.root_id, r.scope): r.unknown_reason for r in found.collect() if r.status == "unknown"} == {(1, "missing"): "not_observed"}


def test_an_unknown_level_above_outweighs_all(spark):
    rows = [fx.entry(1, ".", "directory"), fx.entry(2, "a"), fx.entry(3, "a/b", "directory"), fx.entry(4, "c", "directory", generation=4), fx.entry(5, "c/d", "directory"), fx.entry(6, "c/d/f", size=9)]
    listed = [fx.listing(p) for p in (".", "a/b", "c", "c/d")]
    scopes = spark.createDataFrame([(1, s) for s in (".", "a/b", "c/d", "c/none/x")], "root_id long, scope string")
    found = tree.measure_directories(entries(spark, rows), passes(spark, listed), scopes).collect()
    assert {r.scope: r.unknown_reason for r in found} == {".": None, "a/b": "not_a_directory", "c/d": "absent_from_parent_listing", "c/none/x": "not_observed"}
    assert {r.scope: r.status for r in found} == {".": "recorded_complete", "a/b": "unknown", "c/d": "unknown", "c/none/x": "unknown"}


def test_compacted_totals_root_errors_and_truncation(spark):
    rows = [fx.entry(1, ".", "directory"), fx.entry(2, "n", "directory"), fx.entry(3, "n/a", size=5, allocated=4096, inode="7"), fx.entry(4, "n/b", size=5, allocated=4096, inode="7"), fx.entry(5, "z", size=5, allocated=4096, inode="7")]
    e, d = entries(spark, rows), passes(spark, [fx.listing(p) for p in (".", "n")])
    totals, ledger = reconcile.compact(e.where("id in (3, 4)"))
    scopes = spark.createDataFrame([(1, "."), (1, "n")], "root_id long, scope string")
    row = lambda **more: {r.scope: r for r in tree.measure_directories(e, d, scopes, totals=totals, ledger=ledger, **more).collect()}
    found = row()
    assert (found["."].entries_examined, found["."].file_paths, found["."].logical_bytes, found["."].allocated_bytes, found["."].repeated, found["."].compacted_files) == (3, 3, 15, 4096, 2, 2)
    assert found["."].status == found["n"].status == "recorded_complete"
    failed = spark.createDataFrame([(1,)], "root_id long")
    assert row(root_errors=failed)["n"].status == "stale"
    cut = row(entry_limit=2)
    assert (cut["."].status, cut["."].truncated, cut["."].file_paths, cut["n"].truncated) == ("partial", True, 2, False)
    nameless, _ = reconcile.compact(e.where("id = 3").withColumn("inode", F.lit("")))
    unsure = {r.scope: r for r in tree.measure_directories(e, d, scopes, totals=nameless, ledger=ledger.limit(0)).collect()}
    assert (unsure["."].status, unsure["."].allocated_bytes, unsure["."].unknown_inodes) == ("partial", None, 1)


def test_sizes_that_overflow_raise(spark):
    rows = [fx.entry(1, ".", "directory"), *[fx.entry(i, f"f{i}", size=2**62) for i in range(2, 5)]]
    scopes = spark.createDataFrame([(1, ".")], "root_id long, scope string")
    with pytest.raises(Exception, match="(?i)overflow"):
        tree.measure_directories(entries(spark, rows), passes(spark, [fx.listing(".")]), scopes).collect()


NODE = {2: "selected", 5: "nested_dependency", 6: "not_directory", 7: "skipped", 8: "manifest_missing_or_unsupported", 9: "parent_incomplete_or_error", 11: "parent_unconfirmed", 13: "timestamp_unknown", 15: "age_not_met"}
BUILD = {20: "selected", 30: "manifest_missing_or_unsupported", 40: "age_not_met", 50: "not_directory", 51: "skipped", 52: "profile_missing_or_unsupported"}


def test_rules_of_projects(spark):
    e, d = entries(spark, fx.PROJECTS), passes(spark, fx.PROJECT_PASSES)
    assert {i: o for i, o in outcomes(rules.node_modules(e, d, fx.AS_OF)).items() if o != "not_node_modules"} == NODE
    assert {i: o for i, o in outcomes(rules.build_outputs(e, d, fx.AS_OF)).items() if o != "not_target"} == BUILD
    assert outcomes(rules.build_outputs(e, d, None))[40] == "selected"  # any age


def test_a_skipped_manifest_outweighs_a_missing_profile(spark):
    rows = [fx.entry(1, "t/target", "directory"), fx.entry(2, "t/Cargo.toml", skip="protected"), fx.entry(3, "t/node_modules", "directory"), fx.entry(4, "t/package.json", skip="protected")]
    e, d = entries(spark, rows), passes(spark, [fx.listing("t")])
    assert outcomes(rules.build_outputs(e, d, fx.AS_OF))[1] == outcomes(rules.node_modules(e, d, fx.AS_OF))[3] == "skipped"


def test_the_first_marker_that_fails_names_the_layout(spark):
    rows = [fx.entry(1, ".", "directory"), fx.entry(2, "README", skip="protected")] + [fx.entry(10 + i, f"{i:02x}", "directory") for i in range(255)]
    listed = [fx.listing(".")] + [fx.listing(f"{i:02x}") for i in range(255)]
    layout = lambda r: rules.cache_layout(entries(spark, r), passes(spark, listed)).first().layout
    assert layout(rows) == "marker_skipped"  # and not the missing shard that comes later
    assert layout([rows[0], fx.entry(2, "README"), *rows[2:]]) == "marker_missing"
    assert layout([rows[0], fx.entry(2, "README"), *rows[2:], fx.entry(999, "ff", "directory")]) == "listing_incomplete_or_error"


def test_build_trees_hide_confirmed_files_only(spark):
    base = [fx.entry(1, ".", "directory"), fx.entry(2, "p", "directory"), fx.entry(3, "p/Cargo.toml"), fx.entry(4, "p/Cargo.lock"), fx.entry(5, "p/target", "directory"), fx.entry(6, "p/target/debug", "directory"),
            fx.entry(7, "p/target/debug/.cargo-lock"), fx.entry(8, "p/target/debug/deps", "directory"), fx.entry(9, "p/target/debug/.fingerprint", "directory")]
    leaf = [fx.entry(20, "p/target/debug/deps/lib", size=7), fx.entry(21, "p/target/loose", size=7, generation=2), fx.entry(22, "p/src", size=7)]
    listed = [fx.listing(p) for p in (".", "p", "p/target", "p/target/debug", "p/target/debug/deps", "p/target/debug/.fingerprint")]
    roots = spark.createDataFrame([(1, True, "/w")], "id long, enabled boolean, path string").withColumn("path", F.col("path").cast("binary"))

    def verdicts(rows, more=(), roots=roots, **limits):
        e, d = entries(spark, [*rows, *leaf, *more]), passes(spark, listed)
        files = reports.eligible(e.where("id >= 20"), roots)
        return {r.id: r.verdict for r in rules.below_build_outputs(files, e, d, roots, **limits).collect()}

    assert verdicts(base) == {20: "excluded", 21: "retained_unknown", 22: "no_target_ancestor"}
    assert verdicts(base[:-1])[20] == "retained_unrecognized"
    assert verdicts([*base[:6], fx.entry(7, "p/target/debug/.cargo-lock", skip="protected"), *base[7:]])[20] == "retained_unknown"
    assert verdicts([base[0], fx.entry(2, "p", "directory", generation=2), *base[2:]])[20] == "retained_unknown"  # a level above is not confirmed
    assert verdicts([*base[:6], fx.entry(7, "p/target/debug/.cargo-lock", inode="20", mtime=fx.OLD + 1), *base[7:]])[20] == "retained_unknown"  # one object in two states
    assert verdicts(base, levels=2)[20] == "retained_ancestor_limit"
    inside = roots.withColumn("path", F.lit(b"/w/target/x"))
    assert verdicts(base, roots=inside)[20] == "retained_unrecognized"
    assert verdicts(base, [fx.entry(30, "p/target/debug/deps/target", "directory")])[20] == "excluded"  # the outermost counts


def test_the_first_rows_of_scopes_are_dealt_by_their_number(spark, monkeypatch):
    e, d = entries(spark, fx.TREE), passes(spark, fx.TREE_PASSES)
    scopes = e.select("root_id", paths.as_text(F.col("parent")).alias("scope")).distinct()
    plain = tree.measure_directories(e, d, scopes, entry_limit=3).collect()
    dealt, first = [], tree._first_rows
    monkeypatch.setattr(tree, "ROWS_OF_TASK", 2)
    monkeypatch.setattr(tree, "_first_rows", lambda rows, limit, tasks: (dealt.append(tasks), first(rows, limit, tasks))[1])
    assert sorted(map(str, tree.measure_directories(e, d, scopes, entry_limit=3).collect())) == sorted(map(str, plain))
    ways = e.agg(F.sum(F.size(paths.ancestors(F.col("path"))) + 1)).first()[0]
    assert dealt == [-(-ways // 2)] and ways > len(fx.TREE)


#: Names around the separator in the order of bytes, a missing parent, and levels that are gone.
ODD_TREE = [
    fx.entry(1, ".", "directory"), fx.entry(2, "a", "directory"), fx.entry(3, "a!", size=3), fx.entry(4, "a-b", "directory"), fx.entry(5, "a-b/f", size=5, inode="7"), fx.entry(6, "a/c", "directory", generation=9), fx.entry(7, "a/c/d", "directory"),
    fx.entry(8, "a/c/d/f", size=7, inode="7"), fx.entry(9, "a/none/f", size=9), fx.entry(10, "a0", size=11), fx.entry(11, "é", "directory"), fx.entry(12, "é/è", "directory"), fx.entry(13, "é/è/f", size=13, inode="7"), fx.entry(14, "x"), fx.entry(15, "x/y", size=15),
]
ODD_PASSES = [fx.listing(p) for p in (".", "a", "a-b", "a/c", "a/c/d", "é", "é/è")]


def _odd_tree(spark):
    text = lambda c: paths.as_text(F.col(c)).alias("scope")
    e, d = entries(spark, ODD_TREE), passes(spark, ODD_PASSES)
    return e, d, e.select("root_id", text("parent")).union(e.where("kind = 'directory'").select("root_id", text("path")))


@pytest.mark.parametrize("limit", [None, 3])
def test_measures_do_not_depend_on_the_parts_of_a_tree(spark, monkeypatch, limit):
    e, d, scopes = _odd_tree(spark)
    whole = {r.scope: r for r in tree.measure_directories(e, d, scopes, entry_limit=limit).collect()}
    latin = lambda s: s.encode().decode("latin-1")
    assert {s: r.unknown_reason for s, r in whole.items() if r.status == "unknown"} == {"a/c": "absent_from_parent_listing", "a/c/d": "absent_from_parent_listing", "a/none": "not_observed", "x": "not_a_directory"}
    assert (whole["a"].entries_examined, whole["a"].truncated, whole[latin("é")].logical_bytes) == ((3, True, 13) if limit else (5, False, 13))
    if not limit:
        assert (whole["."].entries_examined, whole["."].excluded_entries, whole["."].file_paths, whole["."].repeated) == (15, 4, 6, 1)
    monkeypatch.setattr(tree, "ROWS_OF_TASK", 8)
    assert sorted(map(str, tree.measure_directories(e, d, scopes, entry_limit=limit).collect())) == sorted(map(str, whole.values()))
    assert sorted(map(str, tree.measure_directories(e, d, entry_limit=limit).collect())) == sorted(map(str, whole.values()))


def test_rows_are_added_up_before_scopes_are_moved(spark):
    e, d, scopes = _odd_tree(spark)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        plan = tree.measure_directories(e, d, scopes)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    moved = [below for line, below in zip(plan, plan[1:]) if "Exchange hashpartitioning" in line]
    assert moved and all("HashAggregate" in line for line in moved)


def test_only_scopes_of_more_rows_are_cut(spark, monkeypatch):
    e, d, scopes = _odd_tree(spark)
    cut, first = [], tree._first_rows
    monkeypatch.setattr(tree, "_first_rows", lambda rows, limit, tasks: (cut.extend(r.scope for r in rows.select("scope").distinct().collect()), first(rows, limit, tasks))[1])
    tree.measure_directories(e, d, scopes, entry_limit=4).collect()
    assert sorted(cut) == [".", "a"]
