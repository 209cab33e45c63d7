"""Batches of listings, retirements and settings."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import scanning
from cairn.sources import config
from tests import fixtures as fx
from tests.test_trees import entries, passes

LISTING = "root_id long, path string, generation long, complete boolean, fault string, at_ns long"


def batch(spark, rows):
    return spark.createDataFrame(rows, LISTING).withColumn("path", F.col("path").cast("binary"))


def test_a_listing_that_failed_leaves_only_its_fault(spark):
    saved = entries(spark, [fx.entry(1, ".", "directory"), fx.entry(2, "a", "directory"), fx.entry(3, "a/f", size=1), fx.entry(4, "b", "directory")])
    children = entries(spark, [fx.entry(3, "a/f", size=9), fx.entry(9, "a/d", "directory"), fx.entry(10, "a/x", "directory", skip="protected"), fx.entry(11, "b/g")]).drop("generation", "observed_at_ns")
    jobs = spark.createDataFrame([(1, "scan", "a"), (1, "other", "a/d")], "root_id long, kind string, path string").withColumn("path", F.col("path").cast("binary"))
    revisions = spark.createDataFrame([(1, 5), (2, 7)], "root_id long, revision long")
    after = scanning.commit_listings(batch(spark, [(1, "a", 3, True, "", 50), (1, "b", 3, True, "denied", 60), (1, "c", 3, True, "gone", 60)]), children, saved, passes(spark, [fx.listing("."), fx.listing("b", 2)]), jobs, revisions)
    text = lambda name, *columns: {tuple(bytes(v).decode() if isinstance(v, (bytes, bytearray)) else v for v in r) for r in after[name].select(*columns).collect()}
    assert text("entries", "path", "size", "generation") == {(".", 0, 1), ("a", 0, 1), ("a/f", 9, 3), ("b", 0, 1), ("a/d", 0, 3), ("a/x", 0, 3)}
    assert text("directories", "path", "generation", "complete", "last_error") == {(".", 1, True, ""), ("a", 3, True, ""), ("b", 2, True, "denied"), ("c", 0, False, "gone")}
    assert text("jobs", "kind", "path") == {("scan", "a"), ("other", "a/d"), ("scan", "a/d")}
    assert text("revisions", "root_id", "revision") == {(1, 6), (2, 7)} and text("reconcile", "path", "generation") == {("a", 3)}


def test_children_that_are_gone_or_no_directories_any_more_are_retired(spark):
    rows = [fx.entry(1, ".", "directory", generation=3), fx.entry(2, "gone", "directory", generation=2), fx.entry(3, "stays", "directory", generation=3), fx.entry(4, "flat", generation=3), fx.entry(5, "held", generation=3), fx.entry(6, "held/f", generation=1), fx.entry(7, "plain", generation=3), fx.entry(8, "plain!/x", generation=3), fx.entry(9, "old/f", generation=1)]
    listed = [fx.listing(".", 3), fx.listing("flat", 2), fx.listing("old", 5)]
    tasks = spark.createDataFrame([(1, ".", 3), (1, "old", 4)], "root_id long, path string, generation long").withColumn("path", F.col("path").cast("binary"))
    found = scanning.retirements(entries(spark, rows), passes(spark, listed), tasks).collect()
    assert {(bytes(r.path).decode(), r.preserve_entry) for r in found} == {("gone", False), ("flat", True), ("held", True)}  # the task of "old" is void


GOOD = 'version = 1\nroots = ["~/work", "/data/x"]\nexcludes = ["/data/x/tmp"]\n[scan]\nwork_seconds = 10\n'


def test_settings_are_read_strictly():
    found = config.load(GOOD, "/home/u")
    assert found.roots == ("/home/u/work", "/data/x") and found.scan.work_seconds == 10 and found.scan.interval_seconds == 300
    bad = [
        "", "version = 2\nroots = ['/a']", "version = 1", "version = 1\nroots = []", "version = 1\nroots = ['a']", "version = 1\nroots = ['/a', '/a/b']", "version = 1\nroots = ['/a/b']\nexcludes = ['/a']", GOOD + "other = 1", GOOD + "work_seconds = 11",
        GOOD.replace("10", "301"), GOOD.replace("10", "'x'"), GOOD.replace("10", "true"), GOOD + "max_state_bytes = 5", GOOD + "cpu_charge_seconds_per_day = 7", GOOD + "compact_inventory = true\nadaptive_revisits = true", 'version = 1\nroots = ["/a\\u0000"]', "version = 1\nroots = 5", "version = true\nroots = ['/a']",
    ]
    for text in bad:
        with pytest.raises(config.Refused):
            config.load(text, "/home/u")
    assert config.load("version = 1\nroots = ['/a', '/a-old', '/b/../c/.']", "/h").roots == ("/a", "/a-old", "/c")


def test_retirements_go_on_until_there_are_none(spark):
    rows = [fx.entry(1, ".", "directory", generation=3), fx.entry(2, "gone", "directory", generation=2), fx.entry(3, "gone/a", "directory"), fx.entry(4, "gone/a/f"), fx.entry(5, "flat", generation=3), fx.entry(6, "flat/left", "directory"), fx.entry(7, "flat/left/f"), fx.entry(8, "gone!", generation=3)]
    listed = [fx.listing(".", 3), fx.listing("gone"), fx.listing("gone/a"), fx.listing("flat/left"), fx.listing("other")]
    tasks = spark.createDataFrame([(1, ".", 3)], "root_id long, path string, generation long").withColumn("path", F.col("path").cast("binary"))
    left, kept = scanning.retire_all(entries(spark, rows), passes(spark, listed), tasks)
    names = lambda df: {bytes(r.path).decode() for r in df.collect()}
    assert names(left) == {".", "flat", "gone!"} and names(kept) == {".", "other"}
    assert scanning.retirements(left, kept, tasks).isEmpty()
