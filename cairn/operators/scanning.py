"""What a batch of listings does to a saved inventory: rows, passes, further work and revisions from one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators.reconcile import purge_subtrees, upsert
from cairn.sources.written import written

SCAN = "scan"


def commit_listings(listings: DataFrame, children: DataFrame, entries: DataFrame, directories: DataFrame, jobs: DataFrame, revisions: DataFrame) -> dict[str, DataFrame]:
    """The relations after a batch of listings, to be written together.

    ``listings`` has (root_id, path, generation, complete, fault, at_ns), one of each directory; ``children``
    what they found (root_id, parent, path, kind and the other columns of an entry that an observation
    tells). A listing that failed leaves its fault on the directory's pass and nothing else; its children, if any, do not
    count. Children replace saved rows of their path and belong to the listing's generation. A directory among
    them that is not skipped is further work, unless it is already. A listing read to its end is to be
    reconciled. Every root that was listed without fault has a new revision, so that what was cached of it lapses.
    """
    good = listings.where("fault = ''")
    told = children.join(good.select("root_id", F.col("path").alias("parent"), F.col("generation"), F.col("at_ns").alias("observed_at_ns")), ["root_id", "parent"])
    saved = entries.columns
    rows = upsert(entries.withColumn("_new", F.lit(0)), told.withColumn("_new", F.lit(1)).select(*saved, "_new"), ["root_id", "path"], ["_new"]).drop("_new")
    old = directories.select("root_id", "path", F.struct("generation", "complete", "checked_at_ns").alias("_old"))
    new = listings.select("root_id", "path", F.col("fault").alias("_fault"), F.struct("generation", "complete", F.col("at_ns").alias("checked_at_ns")).alias("_new"))
    both = directories.select("root_id", "path", F.col("last_error").alias("_error")).join(old, ["root_id", "path"], "left").join(new, ["root_id", "path"], "full")
    failed = F.col("_fault") != ""
    # a pass that failed keeps what an earlier one found; one that never was has neither generation nor end
    none = F.struct(F.lit(0).cast("long").alias("generation"), F.lit(False).alias("complete"), F.lit(0).cast("long").alias("checked_at_ns"))
    state = F.when(F.col("_fault").isNull(), F.col("_old")).when(failed, F.coalesce("_old", none)).otherwise(F.col("_new"))
    passes = both.select("root_id", "path", state.alias("_s"), F.coalesce("_fault", "_error").alias("last_error")).select("root_id", "path", "_s.generation", "_s.complete", "_s.checked_at_ns", "last_error")
    below = told.where("kind = 'directory' and skip_reason = ''").select("root_id", F.lit(SCAN).alias("kind"), "path").distinct()
    work = jobs.select("root_id", "kind", "path").unionByName(below.join(jobs.where(F.col("kind") == SCAN).select("root_id", "path"), ["root_id", "path"], "left_anti"))
    touched = good.select("root_id").distinct().withColumn("_t", F.lit(1))
    revised = revisions.join(touched, "root_id", "left").select("root_id", (F.col("revision") + F.coalesce("_t", F.lit(0))).alias("revision"))
    return {"entries": rows, "directories": passes, "jobs": work, "revisions": revised, "reconcile": good.where("complete").select("root_id", "path", "generation")}


def retirements(entries: DataFrame, directories: DataFrame, tasks: DataFrame) -> DataFrame:
    """Subtrees to retire (root_id, path, preserve_entry) after completed listings (root_id, path, generation).

    A child that the listing no longer holds goes with all below it. One that is no directory any more stays, but what a
    directory left there, a pass of its own or rows below it, goes. A task whose directory was listed again since, or
    failed, is void: a newer one will come.
    """
    current = directories.where("complete and last_error = ''").select("root_id", "path", "generation")
    due = tasks.join(current, ["root_id", "path", "generation"], "left_semi").select("root_id", F.col("path").alias("parent"), F.col("generation").alias("_g"))
    children = entries.join(due, ["root_id", "parent"]).select("root_id", "path", "kind", (F.col("generation") != F.col("_g")).alias("_absent"))
    own = directories.select("root_id", "path", F.lit(True).alias("_own")).distinct()
    # rows below a child: what has it among its ancestors
    suspects = children.where("not _absent and kind <> 'directory'").select("root_id", paths.as_text(F.col("path")).alias("_top"))
    above = entries.select("root_id", F.explode(paths.ancestors(F.col("path"))).alias("_top"))
    held = above.join(suspects, ["root_id", "_top"], "left_semi").distinct().select("root_id", F.col("_top"), F.lit(True).alias("_below"))
    found = children.withColumn("_top", paths.as_text(F.col("path"))).join(own, ["root_id", "path"], "left").join(held, ["root_id", "_top"], "left")
    left = (F.col("kind") != "directory") & (F.coalesce("_own", F.lit(False)) | F.coalesce("_below", F.lit(False)))
    return found.where(F.col("_absent") | left).select("root_id", "path", (~F.col("_absent")).alias("preserve_entry"))


def retire_all(entries: DataFrame, directories: DataFrame, tasks: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """Entries and passes after retirements until there are none: what is retired goes with all below it, an anchor that is preserved stays an entry.

    Each round is written, so rounds do not pile up; purging can only take rows away, so they end.
    """
    for _ in range(most):
        tops = written(retirements(entries, directories, tasks), "retirements")
        if tops.isEmpty():
            return entries, directories
        marked = tops.select("root_id", "path", F.col("preserve_entry").alias("keep_anchor"))
        entries = written(purge_subtrees(entries, marked), "retired-entries")
        passes = directories.withColumn("id", F.struct("root_id", "path"))
        directories = written(purge_subtrees(passes, marked.withColumn("keep_anchor", F.lit(False))).drop("id"), "retired-passes")
    raise ValueError(f"retirements did not end in {most} rounds")
