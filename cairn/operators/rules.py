"""Rule-based reports: old dependency trees, build outputs and build caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import paths
from cairn.operators.reports import with_parent_pass
from cairn.sources.written import written

DAY_NS = 86_400_000_000_000

NODE_OUTCOMES = (
    "not_node_modules", "nested_dependency", "not_directory", "skipped", "manifest_missing_or_unsupported",
    "parent_incomplete_or_error", "parent_unconfirmed", "timestamp_unknown", "age_not_met", "selected",
)


def age(mtime: Column, cutoff: int) -> Column:
    """``timestamp_unknown`` before ``age_not_met``; null for a row that is old enough. A time at the cutoff is."""
    return F.when(mtime <= 0, "timestamp_unknown").when(mtime > cutoff, "age_not_met")


def incomplete() -> Column:
    """The parent's listing is missing, failed or not whole; needs the columns of ``with_parent_pass``."""
    return F.coalesce(~F.col("pass_complete") | (F.col("pass_error") != ""), F.lit(True))


def unconfirmed() -> Column:
    """The parent's listing is of another generation than the row."""
    return F.coalesce((F.col("pass_generation") != F.col("generation")) | (F.col("generation") <= 0), F.lit(True))


def node_modules(entries: DataFrame, directories: DataFrame, as_of_ns: int, days: int = 90) -> DataFrame:
    """Outcome of every row for the rule of old dependency trees: a directory of that name beside a manifest file, both confirmed and old."""
    if not 1 <= days <= 36_500:
        raise ValueError("days must be from 1 to 36500")
    cutoff = as_of_ns - days * DAY_NS
    rows = with_parent_pass(entries, directories)
    manifest = rows.select("root_id", paths.as_text(F.col("path")).alias("_manifest"), F.col("kind").alias("_mk"), F.col("skip_reason").alias("_ms"), F.col("generation").alias("_mg"), F.col("mtime_ns").alias("_mt"))
    joined = rows.withColumn("_manifest", paths.sibling(F.col("parent"), "package.json")).join(manifest, ["root_id", "_manifest"], "left")
    outcome = (
        F.when(paths.base_name(F.col("path")) != "node_modules", "not_node_modules")
        .when(paths.has_generated_parent(F.col("path")), "nested_dependency")
        .when(F.col("kind") != "directory", "not_directory")
        .when((F.col("skip_reason") != "") | (F.col("_ms") != ""), "skipped")
        .when(F.coalesce(F.col("_mk") != "file", F.lit(True)), "manifest_missing_or_unsupported")
        .when(incomplete(), "parent_incomplete_or_error")
        .when((F.col("generation") != F.col("pass_generation")) | (F.col("_mg") != F.col("pass_generation")), "parent_unconfirmed")
        .when((F.col("mtime_ns") <= 0) | (F.col("_mt") <= 0), "timestamp_unknown")
        .when((F.col("mtime_ns") > cutoff) | (F.col("_mt") > cutoff), "age_not_met")
        .otherwise("selected")
    )
    return joined.select("root_id", "id", "path", outcome.alias("outcome"))


def candidate_page(outcomes: DataFrame, after: int, examined: int = 1000, findings: int = 20) -> DataFrame:
    """A page of examined rows by id that ends with its last finding or row: both bounds hold."""
    raw = outcomes.where(F.col("id") > after).orderBy("id").limit(examined)
    seen = F.sum((F.col("outcome") == "selected").cast("int")).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    return raw.withColumn("_seen", F.coalesce(seen, F.lit(0))).where(F.col("_seen") < findings).drop("_seen")


#: Markers of a build directory, beside it and below each profile.
COMMON_MARKERS = (("target", "directory"), ("Cargo.toml", "file"), ("Cargo.lock", "file"))
PROFILES = ("debug", "release")
PROFILE_MARKERS = (("", "directory"), ("/.cargo-lock", "file"), ("/deps", "directory"), ("/.fingerprint", "directory"))


def _markers(targets: DataFrame) -> DataFrame:
    """Targets (root_id, id, _t) with the places that must hold a row of a kind, for each profile and common to both."""
    listed = [("common", n, k) for n, k in COMMON_MARKERS] + [(p, f"target/{p}{m}", k) for p in PROFILES for m, k in PROFILE_MARKERS]
    markers = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(n).alias("name"), F.lit(k).alias("want")) for p, n, k in listed]))
    project = F.regexp_replace("_t", "(^|/)target$", "")
    place = F.when(project == "", F.col("m.name")).otherwise(F.concat(project, F.lit("/"), F.col("m.name")))
    return targets.withColumn("m", markers).select("root_id", "id", F.col("m.profile").alias("profile"), F.col("m.name").alias("name"), F.col("m.want").alias("want"), place.alias("_place"))


def build_outputs(entries: DataFrame, directories: DataFrame, as_of_ns: int | None, days: int = 90) -> DataFrame:
    """Outcome of every row for the rule of build outputs, and the profile that decides it.

    A ``target`` directory with a project's manifest and lock beside it and all markers of a profile in
    it; debug is tried first. Every test is of all markers before the next. Where no profile qualifies,
    the first whose markers are all there gives the reason. Without ``as_of_ns`` any age will do.
    """
    cutoff = F.lit((1 << 63) - 1 if as_of_ns is None else as_of_ns - days * DAY_NS)
    rows = with_parent_pass(entries, directories)
    base, parts = paths.base_name(F.col("path")), paths.components(F.col("path"))
    nested = lambda name: F.array_contains(F.slice(parts, 1, F.size(parts) - 1), name)
    first = F.when(base != "target", "not_target").when(~paths.is_relative(F.col("path")), "unsupported_saved_path").when(nested("target") | nested("node_modules"), "nested_output")
    rows = rows.withColumn("_first", first)
    targets = rows.where(F.col("_first").isNull()).select("root_id", "id", paths.as_text(F.col("path")).alias("_t"))
    nodes = rows.select(
        "root_id", paths.as_text(F.col("path")).alias("_place"), F.col("kind").alias("_k"), (F.col("skip_reason") != "").alias("_s"), incomplete().alias("_i"), unconfirmed().alias("_u"), F.col("mtime_ns").alias("_m")
    )
    judged = _markers(targets).join(nodes, ["root_id", "_place"], "left")
    fits = F.coalesce(F.col("_k") == F.col("want"), F.lit(False))
    tests = {"skipped": F.coalesce("_s", F.lit(False)), "missing": ~fits, "incomplete": F.coalesce("_i", F.lit(True)), "unconfirmed": F.coalesce("_u", F.lit(True)), "timeless": F.coalesce(F.col("_m") <= 0, F.lit(True)), "young": F.coalesce(F.col("_m") > cutoff, F.lit(True))}
    any_ = lambda part, t: F.bool_or(F.when(F.col("profile").isin(*part), t).otherwise(False))
    own = judged.groupBy("root_id", "id").agg(
        F.bool_or(F.when(F.col("name") == "target", ~fits).otherwise(False)).alias("_flat"),
        any_(("common",), tests["skipped"]).alias("_common_skipped"), any_(("common",), tests["missing"]).alias("_common_missing"),
        *[any_(("common", p), t).alias(f"{p}_{name}") for p in PROFILES for name, t in tests.items()],
    )
    code = lambda p: (
        F.when(F.col(f"{p}_skipped"), "skipped").when(F.col(f"{p}_missing"), "profile_missing_or_unsupported").when(F.col(f"{p}_incomplete"), "parent_incomplete_or_error")
        .when(F.col(f"{p}_unconfirmed"), "parent_unconfirmed").when(F.col(f"{p}_timeless"), "timestamp_unknown").when(F.col(f"{p}_young"), "age_not_met").otherwise("selected")
    )
    any_profile = lambda f: F.coalesce(*[F.when(f(p), p) for p in PROFILES])
    profile = F.coalesce(any_profile(lambda p: code(p) == "selected"), any_profile(lambda p: ~F.col(f"{p}_missing")), any_profile(lambda p: code(p) == "skipped"))
    chosen = F.coalesce(*[F.when(profile == p, code(p)) for p in PROFILES], F.lit("profile_missing_or_unsupported"))
    outcome = F.when(F.col("_flat"), "not_directory").when(F.col("_common_skipped"), "skipped").when(F.col("_common_missing"), "manifest_missing_or_unsupported").otherwise(chosen)
    found = own.select("root_id", "id", outcome.alias("_outcome"), F.when(outcome == "selected", profile).alias("profile"))
    return rows.join(found, ["root_id", "id"], "left").select("root_id", "id", "path", F.coalesce("_first", "_outcome").alias("outcome"), "profile")


#: Outcomes of a layout that say too little to keep or leave a row.
UNCERTAIN = ("skipped", "unsupported_saved_path", "parent_incomplete_or_error", "parent_unconfirmed", "timestamp_unknown")
FILTER_COUNTERS = ("eligible_rows", "rows_with_target_ancestor", "excluded_rows", "retained_unrecognized_rows", "retained_unknown_rows", "retained_ancestor_limit_rows", "ancestor_levels", "marker_rows")


def _members(entries: DataFrame, directories: DataFrame) -> DataFrame:
    """Rows that their saved evidence confirms: not skipped, of a known object, in a whole listing not older than they are; directories with such a listing of their own."""
    rows = with_parent_pass(entries, directories)
    checked = directories.select("root_id", F.col("path").alias("parent"), F.col("checked_at_ns").alias("_pt"))
    own = directories.select("root_id", "path", (F.col("complete") & (F.col("last_error") == "") & (F.col("generation") > 0)).alias("_ok"), F.col("checked_at_ns").alias("_ot"))
    rows = rows.join(checked, ["root_id", "parent"], "left").join(own, ["root_id", "path"], "left")
    at_root = F.col("path") == F.lit(b".")
    above = at_root | (~incomplete() & ~unconfirmed() & (F.col("_pt") > 0) & (F.col("observed_at_ns") <= F.col("_pt")))
    known = paths.is_unsigned(F.col("device")) & paths.is_unsigned(F.col("inode"), positive=True)
    below = (F.col("kind") != "directory") | (F.col("_ok") & (F.col("_ot") > 0) & (F.col("observed_at_ns") <= F.col("_ot")))
    sane = (F.col("ctime_ns") > 0) & (F.col("generation") > 0) & (F.col("size") >= 0) & (F.col("allocated") >= 0) & (F.col("observed_at_ns") > 0)
    member = F.coalesce((F.col("skip_reason") == "") & known & sane & above & below, F.lit(False))
    object_ = F.struct("device", "inode", "ctime_ns", "mtime_ns", "allocated", "kind")
    return rows.select("root_id", paths.as_text(F.col("path")).alias("_path"), "kind", member.alias("member"), object_.alias("_object"))


def below_build_outputs(files: DataFrame, entries: DataFrame, directories: DataFrame, roots: DataFrame, levels: int = 256) -> DataFrame:
    """Files of the same-size report with what the build-tree filter says of each: ``verdict``, and the levels and markers looked at.

    The outermost ``target`` above a file counts. It hides the file if every level from the file to the
    root is confirmed, the directory is a recognised layout, its markers are confirmed as well, and no
    object among all these has two states. Levels are judged once for each directory, not for each file.
    """
    text = paths.as_text(F.col("parent"))
    parts = F.split(text, "/")
    place = F.array_position(parts, "target")
    in_root = roots.select(F.col("id").alias("root_id"), F.array_contains(F.split(paths.as_text(F.col("path")), "/"), "target").alias("_in_root"))
    rows = files.join(in_root, "root_id", "left").withColumn("_target", F.when(place > 0, F.array_join(F.slice(parts, 1, place.cast("int")), "/")))
    members = written(_members(entries, directories), "members")
    folders = rows.where("_target is not null and not _in_root").select("root_id", "parent", "_target").distinct()
    chain = folders.select("root_id", "parent", "_target", F.size(paths.ancestors(F.col("parent"))).alias("_depth"), F.explode(F.concat(paths.ancestors(F.col("parent")), F.array(text))).alias("_path"))
    chain = chain.join(members, ["root_id", "_path"], "left").groupBy("root_id", "parent", "_target").agg(
        F.bool_and(F.coalesce(F.col("member") & (F.col("kind") == "directory"), F.lit(False))).alias("_chain"), F.collect_set("_object").alias("_objects"), F.count("*").alias("ancestor_levels"), F.max("_depth").alias("_depth")
    )  # a chain has no more levels than a path has components
    outputs = build_outputs(entries, directories, None).where("outcome <> 'not_target'").select("root_id", "id", paths.as_text(F.col("path")).alias("_target"), "outcome", F.col("profile").alias("_profile"))
    selected = outputs.where("outcome = 'selected'")
    marked = _markers(selected.select("root_id", "id", F.col("_target").alias("_t"))).join(selected.select("root_id", "id", "_profile"), ["root_id", "id"]).where("profile = 'common' or profile = _profile")
    marked = marked.join(members.withColumnRenamed("_path", "_place"), ["root_id", "_place"], "left").groupBy("root_id", "id").agg(
        F.bool_and(F.coalesce(F.col("member") & (F.col("kind") == F.col("want")), F.lit(False))).alias("_marked"), F.collect_set("_object").alias("_marks"), F.count("*").alias("marker_rows")
    )
    layouts = outputs.join(marked, ["root_id", "id"], "left").drop("id")
    leaf = members.select("root_id", F.col("_path").alias("_leaf"), F.col("member").alias("_member"), "_object")
    judged = rows.withColumn("_leaf", paths.as_text(F.col("path"))).join(leaf, ["root_id", "_leaf"], "left").join(chain, ["root_id", "parent", "_target"], "left").join(layouts, ["root_id", "_target"], "left")
    seen = F.array_distinct(F.concat("_objects", "_marks", F.array("_object")))
    one_state = F.size(seen) == F.size(F.array_distinct(F.transform(seen, lambda o: F.struct(o["device"], o["inode"]))))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    verdict = (
        F.when(F.col("_target").isNull(), "no_target_ancestor")
        .when(F.col("_in_root"), "retained_unrecognized")
        .when(no(F.col("_member")), "retained_unknown")
        .when(F.col("_depth") >= levels, "retained_ancestor_limit")
        .when(no(F.col("_chain")) | F.col("outcome").isNull() | F.col("outcome").isin(*UNCERTAIN), "retained_unknown")
        .when(F.col("outcome") != "selected", "retained_unrecognized")
        .when(no(F.col("_marked")) | no(one_state), "retained_unknown")
        .otherwise("excluded")
    )
    return judged.select(*files.columns, verdict.alias("verdict"), F.coalesce("ancestor_levels", F.lit(0)).alias("ancestor_levels"), F.when(verdict == "excluded", F.col("marker_rows")).otherwise(0).alias("marker_rows"))


def filter_counters(judged: DataFrame, by: list[str]) -> DataFrame:
    """The filter's eight counters over files judged by ``below_build_outputs``."""
    n = lambda *codes: F.count_if(F.col("verdict").isin(*codes))
    return judged.groupBy(*by).agg(
        F.count("*").alias("eligible_rows"), F.count_if(F.col("verdict") != "no_target_ancestor").alias("rows_with_target_ancestor"), n("excluded").alias("excluded_rows"), n("retained_unrecognized").alias("retained_unrecognized_rows"),
        n("retained_unknown").alias("retained_unknown_rows"), n("retained_ancestor_limit").alias("retained_ancestor_limit_rows"), F.sum("ancestor_levels").alias("ancestor_levels"), F.sum("marker_rows").alias("marker_rows"),
    )


def cache_layout(entries: DataFrame, directories: DataFrame) -> DataFrame:
    """Per root, the code of the first of its 258 markers that fails: the root, its README and 256 shards, all confirmed, the directories listed."""
    shards = entries.sparkSession.range(256).select((F.col("id") + 2).alias("nth"), F.lower(F.lpad(F.hex("id"), 2, "0")).alias("_path"), F.lit("directory").alias("want"))
    fixed = entries.sparkSession.createDataFrame([(0, ".", "directory"), (1, "README", "file")], "nth long, _path string, want string")
    roots = entries.select("root_id").distinct()
    wanted = roots.crossJoin(F.broadcast(shards.union(fixed)))  # 258 markers for each root
    rows = with_parent_pass(entries.withColumn("parent", F.when(F.col("path") == F.lit(b"."), F.lit(b".")).otherwise(F.col("parent"))), directories).select(
        "root_id", paths.as_text(F.col("path")).alias("_path"), "kind", "skip_reason", incomplete().alias("_i"), unconfirmed().alias("_u")
    )
    own = directories.select("root_id", paths.as_text(F.col("path")).alias("_path"), (F.col("complete") & (F.col("last_error") == "") & (F.col("generation") > 0)).alias("listed"))
    judged = wanted.join(rows, ["root_id", "_path"], "left").join(own, ["root_id", "_path"], "left")
    code = (
        F.when(F.col("kind").isNull() & (F.col("nth") == 0), "root_not_saved")
        .when(F.col("kind").isNull(), "marker_missing")
        .when(F.col("kind") != F.col("want"), "marker_kind_or_parent")
        .when(F.col("skip_reason") != "", "marker_skipped")
        .when(F.col("_i"), "parent_incomplete_or_error")
        .when(F.col("_u"), "parent_unconfirmed")
        .when((F.col("want") == "directory") & ~F.coalesce("listed", F.lit(False)), "listing_incomplete_or_error")
    )
    first = F.min(F.when(code.isNotNull(), F.struct("nth", code.alias("code")))).getField("code")
    return judged.groupBy("root_id").agg(F.coalesce(first, F.lit("saved_layout_matches")).alias("layout"))


def cache_files(entries: DataFrame, directories: DataFrame, as_of_ns: int, days: int = 90) -> DataFrame:
    """Outcome of rows inside a build cache's shards: files named by a digest that begins with their shard."""
    cutoff = as_of_ns - days * DAY_NS
    rows = with_parent_pass(entries, directories)
    text = paths.as_text(F.col("path"))
    named = text.rlike("^([0-9a-f]{2})/\\1[0-9a-f]{62}-[ad]$")
    outcome = F.coalesce(
        F.when(~paths.is_relative(F.col("path")), "unsupported_saved_path"),
        F.when(~named, "outside_supported_layout"),
        F.when((F.col("kind") == "directory") & text.endswith("-d"), "executable_directory"),
        F.when(F.col("kind") != "file", "not_regular_file"),
        F.when(F.col("skip_reason") != "", "skipped"),
        F.when(incomplete(), "parent_incomplete_or_error"),
        F.when(unconfirmed(), "parent_unconfirmed"),
        age(F.col("mtime_ns"), cutoff),
        F.lit("selected"),
    )
    return rows.select("root_id", "id", "path", outcome.alias("outcome"))
