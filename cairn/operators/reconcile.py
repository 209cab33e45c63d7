"""Reconciling saved rows with completed listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.functions.evidence import differ


def absent_rows(entries: DataFrame, directories: DataFrame) -> DataFrame:
    """Rows that a completed, error-free listing of their parent no longer holds."""
    done = directories.where("complete and last_error = ''").select("root_id", F.col("path").alias("parent"), F.col("generation").alias("_g"))
    return entries.join(done, ["root_id", "parent"]).where("_g <> generation").drop("_g")


def purge_subtrees(entries: DataFrame, tops: DataFrame) -> DataFrame:
    """Entries without those below a purged path (root_id, path, keep_anchor), and without the path itself unless it is kept."""
    above = entries.select("root_id", "id", F.explode(paths.ancestors(F.col("path"))).alias("_top"))
    t = tops.select("root_id", paths.as_text(F.col("path")).alias("_top"))
    below = above.join(t, ["root_id", "_top"], "left_semi").select("root_id", "id")
    anchors = tops.where("not keep_anchor").select("root_id", "path")
    return entries.join(below, ["root_id", "id"], "left_anti").join(anchors, ["root_id", "path"], "left_anti")


MAX_ROOTS = 128


def admit_roots(wanted: DataFrame, saved: DataFrame, limit: int = MAX_ROOTS) -> DataFrame:
    """``sync_roots`` where a store retains ``limit`` roots at most, disabled ones included: a request that would go beyond is refused as a whole."""
    retained = saved.limit(limit + 1).count()
    added = wanted.select("path").distinct().join(saved.select("path"), "path", "left_anti").limit(limit + 1).count()
    if retained > limit or added and retained + added > limit:
        raise ValueError(f"a store retains {limit} roots at most")
    return sync_roots(wanted, saved)


def sync_roots(wanted: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved roots with those no longer wanted disabled, and new ones added."""
    w = wanted.select("path", F.lit(True).alias("_w"))
    s = saved.select("path", F.col("enabled").alias("_was"))
    action = F.when(F.col("_was").isNull(), "added").when(F.col("_w").isNull() & F.col("_was"), "disabled").when(F.col("_w").isNotNull() & ~F.col("_was"), "enabled").otherwise("kept")
    return w.join(s, "path", "full").select("path", F.coalesce("_w", F.lit(False)).alias("enabled"), action.alias("action"))


def upsert(saved: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Saved rows and a batch with the last row of each key by the order given."""
    columns = saved.columns
    both = saved.select(*columns).unionByName(batch.select(*columns))
    return both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select("_r.*")


def compact(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of generated trees as totals by directory and as a ledger of identities."""
    named = (F.col("device") != "") & (F.col("inode") != "")
    ok = F.col("skip_reason") == ""
    keys = ["root_id", "parent", "generation"]
    totals = files.groupBy(*keys).agg(
        F.sum(F.when(ok, F.col("size")).otherwise(0)).alias("logical"), F.count_if(ok).alias("files"), F.count_if(ok & ~named).alias("unknown_inodes"), F.count_if(~ok).alias("skipped_files")
    )
    ledger = files.where(ok & named).groupBy(*keys, "device", "inode").agg(
        F.max("allocated").alias("allocated"), F.max("size").alias("logical"), F.count("*").alias("paths"), differ("allocated", "size").alias("conflicting")
    )
    return totals, ledger


def edit_exclusions(saved: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Exclusions after an edit: adding one that is there or removing one that is not changes nothing."""
    return saved.select("path").union(add.select("path")).distinct().join(remove.select("path"), "path", "left_anti")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two tables that one has more often than the other, and how much more often; nulls are equal. Counts meet, not the repeated rows."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_n")).unionAll(b.select(*columns, F.lit(-1).alias("_n")))
    return both.groupBy(*columns).agg(F.sum("_n").cast("long").alias("more")).where("more <> 0")


def same_contents(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
