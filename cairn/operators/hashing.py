"""Content digests: duplicate groups, coverage, keeper previews and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.evidence import differ

MAX_SELECTION = 20


def identity_evidence(work: DataFrame) -> DataFrame:
    """Work rows with what the whole selection says of their object: seen again, and in conflict with itself."""
    named = (F.col("device") != "") & (F.col("inode") != "")
    digest = F.when(F.col("status") == "complete", F.col("sha256"))
    objects = work.where(named).groupBy("device", "inode").agg(
        F.count("*").alias("_rows"), differ("size", "allocated", "ctime_ns", "mtime_ns").alias("_differ"), F.min(digest).alias("_d1"), F.max(digest).alias("_d2")
    )
    # an object seen once can neither repeat nor differ, so few objects meet the rows again
    objects = objects.where("_rows > 1").select("device", "inode", F.lit(True).alias("repeated"), (F.col("_differ") | F.coalesce(F.col("_d1") != F.col("_d2"), F.lit(False))).alias("conflicting"))
    return work.join(objects, ["device", "inode"], "left").na.fill(False, ["repeated", "conflicting"])


def hash_groups(work: DataFrame) -> DataFrame:
    """Complete files of equal size and digest, two or more."""
    done = identity_evidence(work).where("status = 'complete'")
    return (
        done.groupBy("size", "sha256")
        .agg(
            F.count("*").alias("members"),
            F.min("file_id").alias("first_id"),
            F.max("file_id").alias("last_id"),
            F.count_if("repeated").alias("repeated"),
            F.count_if("conflicting").alias("conflicting"),
        )
        .where("members >= 2")
    )


def hash_members(work: DataFrame) -> DataFrame:
    """The members of each group of two or more with their object's qualifiers and the group's size; to be read by size downwards, digest and id."""
    done = identity_evidence(work).where("status = 'complete'")
    # how large a group is needs no evidence
    groups = work.where("status = 'complete'").groupBy("size", "sha256").agg(F.count("*").alias("members")).where("members >= 2")
    return done.join(groups, ["size", "sha256"]).select("size", "sha256", "members", "file_id", "root_id", "repeated", "conflicting")


def identity_status(files: DataFrame, known: Column) -> DataFrame:
    """Files with the status of their object among all given: known, alias, conflicting, or unknown where the identity is not ``known``.

    Objects are reduced before they meet the files again; only those seen more than once do.
    """
    rows = files.withColumn("_known", known)
    objects = rows.where("_known").groupBy("device", "inode").agg(F.count("*").alias("_rows"), differ("ctime_ns", "mtime_ns", "size", "allocated").alias("_differ")).where("_rows > 1")
    joined = rows.join(objects, ["device", "inode"], "left")
    status = F.when(~F.col("_known"), "unknown").when(F.col("_differ"), "conflicting").when(F.col("_rows") > 1, "alias").otherwise("known")
    return joined.withColumn("identity_status", status).drop("_known", "_rows", "_differ")


def hash_coverage(work: DataFrame) -> DataFrame:
    """Selected, completed, unfinished and unmatched files in one row."""
    groups = work.where("status = 'complete'").groupBy("size", "sha256").agg(F.count("*").alias("n"))
    matched = groups.where("n >= 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_matched"), F.count("*").alias("groups"))
    counts = work.agg(F.count("*").alias("selected"), F.count_if(F.col("status") == "complete").alias("completed"))
    return counts.crossJoin(matched).select(  # one row each
        "selected", "completed", (F.col("selected") - F.col("completed")).alias("unfinished"), (F.col("completed") - F.col("_matched")).alias("unmatched"), "groups"
    )


def copy_sizes(groups: DataFrame, allocated: DataFrame) -> DataFrame:
    """Historical figures of a group's copies beside its keeper: copies times size and their allocated bytes, null with a status where a figure overflows."""
    joined = groups.join(allocated, ["size", "sha256"])
    copies = F.col("members") - 1
    logical = F.try_multiply(copies, F.col("size"))
    return joined.select(
        "size",
        "sha256",
        copies.alias("copies"),
        logical.alias("copy_bytes"),
        F.when(logical.isNull(), "overflow").otherwise("known").alias("copy_status"),
        F.col("copy_allocated"),
        F.when(F.col("copy_allocated").isNull(), "overflow").otherwise("known").alias("allocated_status"),
    )


def keeper_preview(work: DataFrame, keeper: int, copies: list[int]) -> DataFrame:
    """The keeper and its copies, if every one is complete, equal and an object of its own; the request is refused otherwise."""
    chosen = [keeper, *copies]
    if not 1 <= len(copies) < MAX_SELECTION or len(set(chosen)) != len(chosen):
        raise ValueError("a keeper and 1 to 19 other files are needed")
    rows = identity_evidence(work).where(F.col("file_id").isin(chosen))
    seen = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "complete").alias("done"),
        F.count_distinct("size", "sha256").alias("contents"), F.count_if(F.col("repeated") | F.col("conflicting")).alias("doubtful"),
    ).first()  # one row
    if seen.n != len(chosen) or seen.done != len(chosen) or seen.contents != 1 or seen.doubtful:
        raise ValueError("the files are not complete, equal and distinct")
    return rows.select("file_id", F.when(F.col("file_id") == keeper, "keeper").otherwise("copy").alias("role"), "size", "sha256")


#: Relations of a copy to its keeper, mildest first.
RELATIONS = ("historical_hashes_match", "historical_hashes_differ", "incomplete", "blocked")


def fresh_comparison(jobs: DataFrame) -> DataFrame:
    """Relation of each job: the gravest of its copies' to the keeper. ``jobs`` has job_id, role, status and sha256."""
    keeper = jobs.where("role = 'keeper'").select("job_id", F.col("status").alias("k_status"), F.col("sha256").alias("k_sha"))
    rank = (
        F.when((F.col("status") == "blocked") | (F.col("k_status") == "blocked"), 3)
        .when((F.col("status") != "complete") | F.col("k_status").isNull() | (F.col("k_status") != "complete"), 2)
        .when(F.col("sha256") != F.col("k_sha"), 1)
        .otherwise(0)
    )
    names = F.array(*[F.lit(r) for r in RELATIONS])
    compared = jobs.where("role = 'copy'").join(keeper, "job_id", "left").withColumn("_rank", rank)
    return compared.groupBy("job_id").agg(F.count("*").alias("copies"), F.max("_rank").alias("_rank")).select("job_id", "copies", F.element_at(names, F.col("_rank") + 1).alias("relation"))


def hash_snapshot(selections: DataFrame, work: DataFrame, attempts: DataFrame, budgets: DataFrame) -> DataFrame:
    """What is saved of each selection of files to hash, if its rows agree with one another: else it is corrupt and the first reason is told.

    ``selections`` has selection_id and targets, how many files it names; ``work`` (selection_id, work_id, status, size, durable_offset,
    sha256), ``attempts`` (selection_id, work_id, day, reserved, status) and ``budgets`` (selection_id, day, total_reserved, clock).
    A selection has ``MAX_SELECTION`` files at most; a file has one attempt, the last.
    """
    key = ["selection_id", "work_id"]
    a = attempts.select(*key, F.col("day").alias("_day"), F.col("reserved").alias("_reserved"), F.col("status").alias("_attempt"))
    b = budgets.select("selection_id", F.col("day").alias("_budget_day"), F.col("total_reserved").alias("_total"))
    rows = work.join(a, key, "left").join(b, "selection_id", "left")
    known = F.coalesce(F.col("status").isin("pending", "running", "complete", "blocked"), F.lit(False))
    reason = (
        F.when(~known, "status_unknown")
        .when((F.col("durable_offset") < 0) | (F.col("durable_offset") > F.col("size")), "offset_outside_file")
        .when((F.col("status") == "complete") & ((F.col("durable_offset") != F.col("size")) | F.coalesce(~F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(True))), "completed_without_digest")
        .when((F.col("status") != "complete") & F.col("sha256").isNotNull(), "digest_before_completion")
        .when((F.col("status") == "running") & F.coalesce(F.col("_attempt") != "reserved", F.lit(True)), "running_without_reservation")
        .when(F.col("_day").isNotNull() & F.col("_total").isNull(), "attempt_without_budget")
        .when((F.col("_day") > F.col("_budget_day")) | (F.col("_reserved") > F.col("_total")), "attempt_beyond_budget")
    )
    judged = rows.withColumn("_reason", reason)
    n = lambda s: F.count_if(F.col("status") == s)
    found = judged.groupBy("selection_id").agg(
        F.count("*").alias("files"), *[n(s).alias(s) for s in ("pending", "running", "complete", "blocked")], F.coalesce(F.sum("durable_offset"), F.lit(0)).alias("durable_bytes"), F.coalesce(F.max("_total"), F.lit(0)).alias("reserved_bytes"),
        F.min(F.when(F.col("_reason").isNotNull(), F.struct("work_id", "_reason"))).getField("_reason").alias("_reason"),
    )
    joined = selections.join(found, "selection_id", "left")
    count = F.coalesce("files", F.lit(0))
    reason = F.when((count != F.col("targets")) | (count > MAX_SELECTION), "files_do_not_match").otherwise(F.col("_reason"))
    figures = ["files", "pending", "running", "complete", "blocked", "durable_bytes", "reserved_bytes"]
    return joined.select("selection_id", F.when(reason.isNull(), "saved_hash_observations").otherwise("corrupt").alias("source"), reason.alias("reason"), *[F.when(reason.isNull(), F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in figures])
