"""Selections that name saved rows and are checked against later evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths

MAX_SELECTED, MAX_EVIDENCE_BYTES, MAX_REQUESTS = 20, 1 << 20, 200
#: What binds a selected row: a later row at the same path with other values is another object.
BINDING = ("device", "inode", "ctime_ns", "generation")


def root_of(targets: DataFrame, roots: DataFrame) -> DataFrame:
    """Targets (id, absolute path) with the enabled root (id, path) that holds them, the longest where several do; null without one.

    An equi-join on the directories above each path, not a comparison of all paths with all roots.
    """
    text = paths.as_text(F.col("path"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split(text, "/"))), lambda i: F.array_join(F.slice(F.split(text, "/"), 1, i), "/"))
    named = targets.select("id", F.explode(F.array_distinct(F.transform(above, lambda p: F.when(p == "", "/").otherwise(p)))).alias("_top"))
    known = roots.where("enabled").select(F.col("id").alias("root_id"), paths.as_text(F.col("path")).alias("_top"))
    best = named.join(known, "_top").groupBy("id").agg(F.max_by("root_id", F.struct(F.length("_top"), "root_id")).alias("root_id"))
    return targets.select("id").join(best, "id", "left")


def lookup_rows(requests: DataFrame, entries: DataFrame, directories: DataFrame) -> DataFrame:
    """Requests (ordinal, root_id, path as text) with what is saved of each: its row, its own listing and its parent's.

    ``MAX_REQUESTS`` requests at most, checked; so they are sent to the saved rows.
    """
    if requests.limit(MAX_REQUESTS + 1).count() > MAX_REQUESTS:
        raise ValueError(f"{MAX_REQUESTS} requests at most")
    asked = F.broadcast(requests.select("ordinal", "root_id", F.col("path").cast("binary").alias("path")))
    found = entries.join(asked, ["root_id", "path"]).select("ordinal", "id", "kind", "size", F.col("parent").alias("_parent"), "generation")
    own = directories.join(asked, ["root_id", "path"]).select("ordinal", F.col("complete").alias("own_complete"))
    parents = F.broadcast(requests.join(found.select("ordinal", "_parent"), "ordinal").select("ordinal", "root_id", F.col("_parent").alias("path")))
    above = directories.join(parents, ["root_id", "path"]).select("ordinal", F.col("generation").alias("parent_generation"), F.col("complete").alias("parent_complete"))
    return requests.join(found.drop("_parent"), "ordinal", "left").join(own, "ordinal", "left").join(above, "ordinal", "left")


def ancestor_chains(targets: DataFrame, directories: DataFrame) -> DataFrame:
    """For each target (id, root_id, path): directories above it below the root, how many have a completed pass without error, and whether all have."""
    levels = targets.select("id", "root_id", F.explode(F.filter(paths.ancestors(F.col("path")), lambda p: p != ".")).alias("_path"))
    passes = directories.select("root_id", paths.as_text(F.col("path")).alias("_path"), (F.col("complete") & (F.col("last_error") == "")).alias("_ok"))
    counted = levels.join(passes, ["root_id", "_path"], "left").groupBy("id").agg(F.count("*").alias("levels"), F.count_if(F.coalesce("_ok", F.lit(False))).alias("listed"))
    found = targets.select("id").join(counted, "id", "left").na.fill(0, ["levels", "listed"])
    return found.withColumn("chain_valid", F.col("levels") == F.col("listed"))


def select_files(entries: DataFrame, directories: DataFrame, shown: DataFrame) -> DataFrame:
    """A frozen selection of files as they were shown (id, size, mtime_ns): the saved rows with their bindings.

    Refused as a whole unless 1 to ``MAX_SELECTED`` different files are named, all are saved regular
    files that no rule skips, each equals what was shown, their parents' chains up to the parent are
    listed, and the evidence is small enough to keep.
    """
    asked = shown.limit(MAX_SELECTED + 1).select("id", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime")).collect()
    if not 1 <= len(asked) <= MAX_SELECTED or len({r.id for r in asked}) != len(asked):
        raise ValueError(f"1 to {MAX_SELECTED} different files are needed")
    rows = entries.where(F.col("id").isin([r.id for r in asked]))
    want = F.array(*[F.struct(F.lit(r.id).cast("long"), F.lit(r["_size"]).cast("long"), F.lit(r["_mtime"]).cast("long")) for r in asked])
    same = F.exists(want, lambda w: w == F.struct(F.col("id").cast("long"), F.col("size").cast("long"), F.col("mtime_ns").cast("long")))
    found = rows.where((F.col("kind") == "file") & (F.col("skip_reason") == "") & same)
    seen = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    valid = ancestor_chains(found.select("id", "root_id", F.col("parent").alias("path")), directories).where("chain_valid").count()
    if seen.n != len(asked) or valid != len(asked) or seen.bytes > MAX_EVIDENCE_BYTES:
        raise ValueError("a file is not as it was shown")
    return found.select("id", "root_id", "path", "size", "mtime_ns", F.struct(*BINDING).alias("binding"))


def bindings(entries: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rows with what binds them and the revision of their root at that time."""
    return entries.join(revisions.select("root_id", "revision"), "root_id", "left").select("id", "root_id", "revision", F.struct(*BINDING).alias("binding"))


def metadata_screen(frozen: DataFrame, current: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each frozen row (id) against the current one: ``metadata_matches``, or ``blocked`` with the reason."""
    a, b = frozen.select("id", F.struct(*columns).alias("_a")), current.select("id", F.struct(*columns).alias("_b"), (F.col("skip_reason") != "").alias("_skipped"))
    joined = a.join(b, "id", "left")
    reason = F.when(F.col("_b").isNull(), "missing").when(F.col("_skipped"), "skipped").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return joined.select("id", F.when(reason.isNull(), "metadata_matches").otherwise("blocked").alias("status"), F.coalesce(reason, F.lit("")).alias("reason"))


def locations(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Where each expected object (id, device, inode) is: present, replaced by another object, absent, or unknown where its identity is not saved."""
    seen = observed.select("id", F.col("device").alias("_d"), F.col("inode").alias("_i"))
    known = (F.col("device") != "") & (F.col("inode") != "")
    state = F.when(F.col("_d").isNull(), "absent").when(~known | (F.col("_i") == ""), "unknown").when((F.col("device") == F.col("_d")) & (F.col("inode") == F.col("_i")), "present").otherwise("replaced")
    return expected.join(seen, "id", "left").select("id", state.alias("state"))


def cached_or_computed(cache: DataFrame, revisions: DataFrame, computed: DataFrame, key: list[str], figures: list[str]) -> DataFrame:
    """Saved figures of a scope where their root's revision is still the one they were taken at, else those computed; ``source`` says which."""
    fresh = cache.join(revisions.select("root_id", "revision"), ["root_id", "revision"]).select(*key, F.struct(*figures).alias("_saved"))
    joined = computed.select(*key, F.struct(*figures).alias("_now")).join(fresh, key, "left")
    taken: Column = F.coalesce("_saved", "_now")
    return joined.select(*key, *[taken[f].alias(f) for f in figures], F.when(F.col("_saved").isNull(), "computed").otherwise("cached_reduction").alias("source"))
