"""Saved reports over files: parent passes, largest files, same-size bands, pages and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import cursors, paths
from cairn.functions.evidence import differ

PARENT_PASSES = ("unknown", "directory_error", "unconfirmed", "partial", "observed_in_completed_parent_pass")
SAME_SIZE_OUTCOMES = ("disabled_root", "skipped", "generated_dependency", "compact_parent", "invalid_saved_path", "eligible")


def parent_pass() -> Column:
    """What the listing of the parent says of a row; needs the parent's pass as pass_generation, pass_complete and pass_error."""
    return (
        F.when(F.col("pass_generation").isNull(), "unknown")
        .when(F.col("pass_error") != "", "directory_error")
        .when(F.col("pass_generation") != F.col("generation"), "unconfirmed")
        .when(~F.col("pass_complete"), "partial")
        .otherwise("observed_in_completed_parent_pass")
    )


def with_parent_pass(entries: DataFrame, directories: DataFrame) -> DataFrame:
    passes = directories.select(
        "root_id",
        F.col("path").alias("parent"),
        F.col("generation").alias("pass_generation"),
        F.col("complete").alias("pass_complete"),
        F.col("last_error").alias("pass_error"),
    )
    return entries.join(passes, ["root_id", "parent"], "left").withColumn("parent_pass", parent_pass())


def outside_compacted(files: DataFrame, compacted: DataFrame) -> DataFrame:
    """Files whose directory (root_id, path of ``compacted``) was not reduced to totals."""
    return files.join(compacted.select("root_id", F.col("path").alias("parent")).distinct(), ["root_id", "parent"], "left_anti")


def largest_files(entries: DataFrame, roots: DataFrame, directories: DataFrame, limit: int, after: tuple[int, int] | None = None, compacted: DataFrame | None = None) -> DataFrame:
    """A page of enabled roots' files by size and id, largest first; ``after`` is the last row of the page before.

    Files below compacted directories are left out. With ``limit`` one more than a page, the last
    row tells that more follow: see ``page_with_cursor``.
    """
    if not 1 <= limit <= 201:
        raise ValueError("a page has 1 to 200 rows, and one to look ahead")
    files = entries.join(roots.where("enabled").select(F.col("id").alias("root_id")), "root_id", "left_semi").where("kind = 'file'")
    if compacted is not None:
        files = outside_compacted(files, compacted)
    if after:
        files = files.where((F.col("size") < after[0]) | ((F.col("size") == after[0]) & (F.col("id") < after[1])))
    page = files.orderBy(F.desc("size"), F.desc("id")).limit(limit)
    return with_parent_pass(page, directories)


def page_with_cursor(ahead: DataFrame, limit: int, inventory: str, minimum: int = 0) -> tuple[DataFrame, str | None]:
    """A page without its look-ahead row, and where the next page begins if that row was there."""
    page = ahead.orderBy(F.desc("size"), F.desc("id")).limit(limit)
    ends = ahead.agg(F.count("*").alias("n")).first().n > limit
    if not ends:
        return page, None
    last = page.orderBy("size", "id").first()
    return page, cursors.encode(inventory, minimum, last["size"], last["id"])


def known_identity() -> Column:
    """Device and inode are canonical numbers, the inode is not 0, and times and generation are set."""
    number = paths.is_unsigned(F.col("device")) & paths.is_unsigned(F.col("inode"), positive=True)
    return F.coalesce(number, F.lit(False)) & (F.col("ctime_ns") > 0) & (F.col("generation") > 0)


def same_size_bands(files: DataFrame, minimum: int) -> DataFrame:
    """Sizes that two or more eligible files share, with counters of their identities: objects first, then sizes.

    ``files`` are those that ``eligible`` leaves.
    """
    rows = files.where(F.col("size") >= minimum).withColumn("_known", known_identity())
    objects = rows.groupBy("size", "_known", F.when(F.col("_known"), F.col("device")).alias("_d"), F.when(F.col("_known"), F.col("inode")).alias("_i")).agg(
        F.count("*").alias("_rows"), differ("ctime_ns", "mtime_ns", "allocated").alias("_differ")
    )
    known = F.col("_known")
    return (
        objects.groupBy("size")
        .agg(
            F.sum("_rows").alias("files"),
            F.count_if(known).alias("known_objects"),
            F.sum(F.when(known, F.col("_rows") - 1).otherwise(0)).alias("repeated"),
            F.sum(F.when(~known, F.col("_rows")).otherwise(0)).alias("unknown"),
            F.count_if(known & F.col("_differ")).alias("conflicting"),
        )
        .where("files >= 2")
    )


def same_size_outcome(entries: DataFrame, roots: DataFrame, compacted: DataFrame | None = None) -> DataFrame:
    """First rule that keeps each regular file from the same-size report, or ``eligible``; other rows are not examined."""
    rows = entries.where("kind = 'file'").join(roots.select(F.col("id").alias("root_id"), "enabled"), "root_id")
    under = F.lit(False)
    if compacted is not None:
        rows = rows.join(compacted.select("root_id", F.col("path").alias("parent"), F.lit(True).alias("_compact")), ["root_id", "parent"], "left")
        under = F.coalesce("_compact", F.lit(False))
    outcome = (
        F.when(~F.col("enabled"), "disabled_root")
        .when(F.col("skip_reason") != "", "skipped")
        .when(paths.has_generated_parent(F.col("path")), "generated_dependency")
        .when(under, "compact_parent")
        .when(~paths.is_relative(F.col("path")), "invalid_saved_path")
        .otherwise("eligible")
    )
    return rows.withColumn("outcome", outcome)


def eligible(entries: DataFrame, roots: DataFrame, compacted: DataFrame | None = None) -> DataFrame:
    """The rows that no rule keeps from the same-size report."""
    return same_size_outcome(entries, roots, compacted).where("outcome = 'eligible'").drop("outcome", "enabled")


def same_size_page(files: DataFrame, roots: DataFrame, minimum: int, limit: int, after: tuple[int, int] | None = None, compacted: DataFrame | None = None) -> DataFrame:
    """Bands of equal size on a page of raw rows, regular files alone.

    The page is cut before any exclusion; only eligible rows then enter bands. A band whose size is
    the cursor's continues one before; one whose size is the next raw row's continues after; a
    single row that does neither is dropped.
    """
    rows = files.where((F.col("kind") == "file") & (F.col("size") >= minimum))
    if after:
        rows = rows.where((F.col("size") < after[0]) | ((F.col("size") == after[0]) & (F.col("id") < after[1])))
    raw = rows.orderBy(F.desc("size"), F.desc("id")).limit(limit + 1).withColumn("_nth", F.row_number().over(Window.orderBy(F.desc("size"), F.desc("id"))))
    page, ahead = eligible(raw.where(F.col("_nth") <= limit), roots, compacted), raw.where(F.col("_nth") == limit + 1).agg(F.max("size").alias("_ahead"))
    known = known_identity()
    object_ = F.when(known, F.struct("device", "inode"))
    bands = page.groupBy("size").agg(
        F.count("*").alias("files"), F.count_if(~known).alias("unknown"), F.count_distinct(object_).alias("known_objects"), F.array_sort(F.collect_list("id")).alias("_ids")
    ).crossJoin(F.broadcast(ahead))  # one row
    return (
        bands.withColumn("continues_before", F.lit(False) if after is None else F.col("size") == after[0])
        .withColumn("continues_after", F.coalesce(F.col("size") == F.col("_ahead"), F.lit(False)))
        .where("files > 1 or continues_before or continues_after")
        .select("size", "files", "known_objects", "unknown", F.concat_ws(",", F.reverse("_ids")).alias("ids"), "continues_before", "continues_after")
    )


def histogram(rows: DataFrame, codes: tuple[str, ...], column: str = "outcome") -> DataFrame:
    """Rows of each code, those without any included."""
    listed = rows.sparkSession.createDataFrame([(c, i) for i, c in enumerate(codes)], f"{column} string, position int")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return listed.join(counts, column, "left").select(column, "position", F.coalesce("n", F.lit(0)).alias("n"))


def root_diagnostics(roots: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of each root by status; roots without any have zeros."""
    counts = jobs.groupBy("root_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running")], F.count_if(F.col("attempts") > 1).alias("retried"))
    joined = roots.select(F.col("id").alias("root_id")).join(counts, "root_id", "left")
    return joined.select("root_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pending", "running", "retried")])


def store_summary(roots: DataFrame, entries: DataFrame, jobs: DataFrame, directories: DataFrame) -> DataFrame:
    """Counts of a store in one row."""
    row = lambda df, **counts: df.agg(*[c.alias(n) for n, c in counts.items()])
    whole = F.col("complete") & (F.col("last_error") == "")
    return (
        row(roots, enabled_roots=F.count_if("enabled"))
        .crossJoin(row(entries, entries=F.count("*"), skipped_entries=F.count_if(F.col("skip_reason") != "")))
        .crossJoin(row(jobs, pending_jobs=F.count_if(F.col("status") == "pending"), running_jobs=F.count_if(F.col("status") == "running")))
        .crossJoin(row(directories, complete_directories=F.count_if(whole), directory_errors=F.count_if(F.col("last_error") != "")))
    )  # one row each


def due_jobs(jobs: DataFrame, roots: DataFrame) -> DataFrame:
    """For each kind, the earliest pending job of an enabled root and how many wait."""
    ready = jobs.where("status = 'pending'").join(roots.where("enabled").select(F.col("id").alias("root_id")), "root_id", "left_semi")
    return ready.groupBy("kind").agg(F.min(F.struct("due_at_ns", "id")).alias("_m"), F.count("*").alias("waiting")).select("kind", F.col("_m.due_at_ns").alias("due_at_ns"), F.col("_m.id").alias("job_id"), "waiting")


def root_page(roots: DataFrame, after: int, limit: int = 128) -> DataFrame:
    """A page of root ids beyond ``after`` with whether more follow: one more row is read than is returned."""
    ahead = roots.where(F.col("root_id") > after).orderBy("root_id").limit(limit + 1)
    more = ahead.agg((F.count("*") > limit).alias("truncated"))
    return ahead.orderBy("root_id").limit(limit).crossJoin(F.broadcast(more))  # one row


def rotation(queue: DataFrame, served: DataFrame) -> DataFrame:
    """A queue (id, ready_order) after some of its ids were served: these go behind all others, in the order in which they stood."""
    last = queue.agg(F.max("ready_order").alias("_last"))
    marked = queue.join(served.select("id", F.lit(True).alias("_served")), "id", "left").crossJoin(F.broadcast(last))  # one row
    return marked.select("id", F.when(F.col("_served"), F.col("_last") + F.col("ready_order")).otherwise(F.col("ready_order")).alias("ready_order"))


def existing(**relations: DataFrame) -> DataFrame:
    """(relation, id) of several stores' records in one table."""
    out = None
    for name, df in relations.items():
        part = df.select(F.lit(name).alias("relation"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionAll(part)
    return out


def state_size(parts: DataFrame, limit: int) -> DataFrame:
    """Bytes of each store's parts and whether they reach the limit; a part of unknown size leaves the state unknown."""
    sums = parts.groupBy("store").agg(F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes").isNull() | (F.col("bytes") < 0)).alias("_odd"))
    state = F.when(F.col("_odd") > 0, "unknown").when(F.col("bytes") >= limit, "limit_reached").otherwise("within_limit")
    return sums.select("store", F.when(F.col("_odd") == 0, F.col("bytes")).alias("bytes"), state.alias("state"))


def fair_turn(candidates: DataFrame, last_served: int, limit: int) -> DataFrame:
    """Roots in turn: those after the one served last, then from the start."""
    return candidates.orderBy((F.col("root_id") <= last_served).cast("int"), "root_id").limit(limit)
