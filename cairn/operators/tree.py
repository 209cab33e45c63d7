"""Operators over the tree of paths: measures, overlaps, ancestors, links and roles."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from cairn.functions import paths
from cairn.functions.evidence import differ
from cairn.shipping import ship
from cairn.sources.written import written

#: Levels above a scope that are looked at.
ANCESTORS = 256
#: Rows that a task looks at where they are dealt by path, and rows of scopes, each row once for each scope above it, where only the first of a scope are kept.
ROWS_OF_TASK = 100_000
#: Parts by path, four to a task's rows, as a row takes its levels along; beyond them parts grow.
MAX_PARTS = 10_000
#: Kinds of rows, and why a scope is unknown, as numbers.
OTHER, FILE, DIRECTORY = 0, 1, 2
NOT_OBSERVED, NOT_A_DIRECTORY, ABSENT = 1, 2, 3
#: Figures of a measured scope.
MEASURES = (
    "entries_examined", "excluded_entries", "file_paths", "logical_bytes", "allocated_bytes", "unknown_inodes", "repeated", "unconfirmed", "skipped_entries", "incomplete_directories",
    "directory_errors", "compacted_directories", "compacted_files", "oldest_ns", "newest_ns", "truncated",
)


def _levels(path: Column) -> Column:
    """A relative path's way from the root ``.`` down to itself, all as text."""
    below = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.call_function("substring_index", path, F.lit("/"), i))
    return F.when(path == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), below))


def _up(path: Column) -> Column:
    """The directory right above a relative path, as text; null for the root."""
    name = F.substring_index(path, "/", -1)
    return F.when(path != ".", F.when(name == path, ".").otherwise(F.substr(path, F.lit(1), F.length(path) - F.length(name) - 1)))


def _key(path: str) -> Column:
    """Text by whose order what lies below a directory stands together, right after the directory."""
    return F.concat(F.col("root_id").cast("string"), F.when(F.col(path) == ".", "").otherwise(F.concat(F.lit("\x00"), F.replace(F.col(path), F.lit("/"), F.lit("\x00")))))


def _bounds(rows: DataFrame) -> list[str]:
    """Keys that cut the rows into parts of about equal size; they are drawn, as Spark draws those of a range, and only say where a row is looked at."""
    n = rows.count()
    parts = min(MAX_PARTS, -(-n // max(1, ROWS_OF_TASK // 4)))
    if parts < 2:
        return []
    keys = sorted(r[0] for r in rows.select(_key("_path")).sample(min(1.0, 40 * parts / n), 1).collect())
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def _dealt(records: DataFrame, bounds: list[str]) -> DataFrame:
    """Records dealt by ranges of their keys, with copies of those at a directory in each later part that holds something below it."""
    if not bounds:
        return records.withColumns({"_part": F.lit(0), "_native": F.lit(True)}).repartition(1, "_part")
    cuts, key = F.array(*[F.lit(b) for b in bounds]), F.col("_key")
    steps = F.array(*[F.lit(2**i) for i in range(len(bounds).bit_length() - 1, -1, -1)])
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= key, at + step).otherwise(at))
    # a directory has rows in a later part only if that part's first key lies below it
    tops = records.sparkSession.createDataFrame([(b, i) for i, b in enumerate(bounds, 1)], "_bound string, _later int").withColumn("_names", F.split("_bound", "\x00"))
    above = tops.where(F.size("_names") > 1).select("_later", F.explode(F.transform(F.sequence(F.lit(1), F.size("_names") - 1), lambda i: F.array_join(F.slice("_names", 1, i), "\x00"))).alias("_key"))
    later = above.groupBy("_key").agg(F.collect_list("_later").alias("_later"))
    found = records.withColumn("_key", _key("_path")).join(F.broadcast(later), "_key", "left")  # as many as parts and levels above them
    copies = F.concat(F.array(part), F.coalesce("_later", F.array().cast("array<int>")))
    return found.select(*records.columns, F.posexplode(copies).alias("_nth", "_part")).withColumn("_native", F.col("_nth") == 0).drop("_nth").repartition(len(bounds) + 1, "_part")


def _marked(entries: DataFrame, directories: DataFrame, scopes: DataFrame | None, totals: DataFrame | None, ledger: DataFrame | None) -> DataFrame:
    """Each row, identity of a ledger and scope with what the levels on the way to it say.

    Levels count from the root's 0 down to the row itself. A level is gone where its parent is no
    directory or the listing of its parent was completed without it, and sure where that listing
    confirms it. Only the immediate parent row decides: a level whose parent row is missing is
    neither gone by its parent's kind nor confirmed, and what is gone above a missing row does not
    reach below it. Files of a directory with ``totals`` are not there.

    A scope's ``reason`` is that of the deepest level that leaves it unknown; beyond ``ANCESTORS`` levels
    the walk is given up as partial.

    Rows, passes, totals and identities are moved once, to parts by their place in the tree, and meet there: each
    directory asks for its levels, and its files learn from it.
    """
    kind = F.when(F.col("kind") == "file", FILE).when(F.col("kind") == "directory", DIRECTORY).otherwise(OTHER)
    rows = entries.select(
        "root_id", paths.as_text(F.col("path")).alias("_path"), kind.alias("kind"), "size", "allocated", "device", "inode", "generation", "observed_at_ns", (F.col("skip_reason") != "").alias("skip"),
    )
    bounds = _bounds(rows)
    records = rows.withColumn("_there", F.lit(True)).unionByName(
        directories.select("root_id", paths.as_text(F.col("path")).alias("_path"), F.col("generation").alias("_pg"), F.col("complete").alias("_pc"), (F.col("last_error") != "").alias("_pe"), F.col("checked_at_ns").alias("_pt")),
        allowMissingColumns=True,
    )
    compacted = ["logical", "files", "unknown_inodes", "skipped_files"]
    if totals is not None:
        sums = totals.groupBy("root_id", "parent").agg(F.max("generation").alias("_cg"), *[F.sum(F.when(F.col("generation") > 0, F.col(c)).otherwise(0)).alias(f"_c_{c}") for c in compacted])
        records = records.unionByName(sums.withColumn("_path", paths.as_text(F.col("parent"))).drop("parent"), allowMissingColumns=True)
    else:
        records = records.withColumns({c: F.lit(None).cast("long") for c in ["_cg", *[f"_c_{c}" for c in compacted]]})
    records = records.withColumns({"_wanted": F.lit(None).cast("boolean"), "_object": F.lit(None).cast("string")})
    if scopes is not None:
        records = records.unionByName(scopes.select("root_id", F.col("scope").alias("_path"), F.lit(True).alias("_wanted")), allowMissingColumns=True)
    numbers = {c: F.lit(None).cast("long") for c in ("_low_a", "_low_s", "_high_s", "_n")}
    records = records.withColumns({**numbers, "_differ": F.lit(None).cast("boolean")})
    if ledger is not None and totals is not None:
        met = ledger.join(totals.where("generation > 0").select("root_id", "parent", "generation").distinct(), ["root_id", "parent", "generation"], "left_semi")
        name = F.concat_ws("\x00", F.col("generation").cast("string"), "device", "inode")
        records = records.unionByName(
            met.select("root_id", paths.as_text(F.col("parent")).alias("_path"), name.alias("_object"), "device", "inode", "allocated", F.col("allocated").alias("_low_a"), F.col("logical").alias("_low_s"), F.col("logical").alias("_high_s"), F.col("paths").alias("_n"), F.col("conflicting").alias("_differ")),
            allowMissingColumns=True,
        )
    dealt = _dealt(records, bounds)
    # a directory that is only named by the rows in it is a node as well
    values = [c for c in dealt.columns if c not in ("root_id", "_path", "_object", "_part")]
    up = _up(F.col("_path"))
    roles = F.when(F.col("_there") & up.isNotNull(), F.array(F.col("_path"), up)).otherwise(F.array("_path"))
    spread = dealt.withColumns({"_nth": F.lit(0)}).select(*dealt.columns, F.posexplode(roles).alias("_nth", "_at"))
    own = spread.select("_part", "root_id", F.col("_at").alias("_path"), "_object", *[F.when(F.col("_nth") == 0, F.col(c)).alias(c) for c in values], (F.col("_nth") == 1).alias("_named"))
    nodes = own.groupBy("_part", "root_id", "_path", "_object").agg(*[F.max(c).alias(c) for c in values], F.bool_or("_named").alias("_named"))
    nodes = nodes.withColumns({"_there": F.coalesce("_there", F.lit(False)), "_native": F.coalesce("_native", F.lit(False)), "_wanted": F.coalesce("_wanted", F.lit(False)), "_levels": _levels(F.col("_path"))})
    leaf = F.col("_object").isNull() & F.col("_there") & (F.col("kind") != DIRECTORY) & (F.col("_path") != ".")
    asks = F.col("_object").isNull() & (F.col("_named") | F.col("_wanted") | ~leaf)
    last = 2**31 - 1
    asked = F.transform("_levels", lambda p, i: F.struct(i.cast("int").alias("level"), p.alias("at"), F.col("_path").alias("home"), F.lit(False).alias("self")))
    itself = F.struct(F.lit(last).alias("level"), F.col("_path").alias("at"), F.when(leaf, up).otherwise(F.col("_path")).alias("home"), F.lit(True).alias("self"))
    held = [c for c in nodes.columns if c not in ("_part", "root_id", "_levels")]
    split = nodes.withColumn("_ask", F.explode(F.concat(F.array(itself), F.when(asks, asked).otherwise(F.array().cast("array<struct<level:int,at:string,home:string,self:boolean>>"))))).select("_part", "root_id", "_ask.*", *held)
    split = split.select("_part", "root_id", "level", "at", "home", "self", *[F.when(F.col("self"), F.col(c)).alias(c) for c in held])
    fact = F.struct("_there", "kind", "skip", "generation", "observed_at_ns", "_pg", "_pc", "_pe", "_pt", F.col("_cg").isNotNull().alias("compact"))
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = to_here(Window.partitionBy("_part", "root_id", "at").orderBy(F.desc("level"), F.asc("_object")))
    known = split.withColumn("_f", F.first(F.when(F.col("self") & F.col("_object").isNull(), fact), ignorenulls=True).over(at))
    steps = Window.partitionBy("_part", "root_id", "home").orderBy("level")
    before = lambda c: F.lag(c).over(steps)
    yes = lambda c: F.coalesce(c, F.lit(False))
    f, step = (lambda c: F.col("_f").getField(c)), ~F.col("self")
    known = known.withColumn("_here", yes(f("_there")) & ~yes((f("kind") == FILE) & before(f("compact"))))
    here = lambda c: F.when(F.col("_here"), f(c))
    known = known.withColumns({"_uk": before(here("kind")), "_us": before(here("skip")), "_upg": before(f("_pg")), "_upc": before(f("_pc")), "_upe": before(f("_pe"))})

    def judged(uk, us, pg, pc, pe, generation):
        """Whether a level is gone, is sure and has a parent that was listed in part."""
        absent = yes(pc & ~pe & (pg != generation))
        return yes(uk != DIRECTORY) | absent, yes((uk == DIRECTORY) & ~us & (pg == generation)), yes(~pc | pe), absent

    gone, sure, part_listed, absent = judged(F.col("_uk"), F.col("_us"), F.col("_upg"), F.col("_upc"), F.col("_upe"), here("generation"))
    inner = F.col("level") > 0
    reason = F.when(~F.col("_here"), NOT_OBSERVED).when(f("kind") != DIRECTORY, NOT_A_DIRECTORY).when(inner & absent, ABSENT)
    unlisted = F.coalesce(f("_pt"), F.lit(0)) == 0
    partial = here("skip") | yes(F.col("_upe")) | unlisted | (inner & ~yes(F.col("_upc")))
    stale = (~unlisted & (here("observed_at_ns") > f("_pt"))) | (inner & (here("generation") != F.coalesce("_upg", F.lit(0))))
    judged_steps = known.withColumns({"_gone": F.col("_here") & gone, "_sure": F.col("_here") & sure, "_reason": reason, "_partial": yes(partial), "_stale": yes(stale), "_listed_in_part": part_listed})
    so_far = to_here(steps)
    deepest = lambda test: F.coalesce(F.max(F.when(step & test, F.col("level"))).over(so_far), F.lit(-1))
    home = F.struct("level", here("kind").alias("kind"), here("skip").alias("skip"), f("_pg").alias("pg"), f("_pc").alias("pc"), f("_pe").alias("pe"), f("compact").alias("compact"), F.col("_listed_in_part").alias("in_part"))
    depth = F.size(F.split("home", "/")) - F.when(F.col("home") == ".", 1).otherwise(0)
    near = step & (depth - F.col("level") < ANCESTORS)
    told = judged_steps.withColumns({
        "missing_at": deepest(~F.col("_here")), "gone_at": deepest(F.col("_gone")), "unsure_at": deepest(~F.col("_sure")), "_home": F.last(F.when(step, home), ignorenulls=True).over(so_far),
        "_why": F.max(F.when(near & F.col("_reason").isNotNull(), F.col("level") * 4 + F.col("_reason"))).over(so_far) % 4,
        "_chain_partial": F.max(F.when(near, F.col("_partial"))).over(so_far), "_chain_stale": F.max(F.when(near, F.col("_stale"))).over(so_far),
    }).where("self")
    h = lambda c: F.col("_home").getField(c)
    below = yes(leaf)
    own_gone, own_sure, own_part, _ = judged(h("kind"), h("skip"), h("pg"), h("pc"), h("pe"), F.col("generation"))
    mine = h("level") + 1
    left_out = below & (F.col("kind") == FILE) & yes(h("compact"))
    scope = F.col("_wanted") if scopes is not None else F.col("_named") | F.col("_cg").isNotNull() | (F.col("_there") & (F.col("kind") == DIRECTORY))
    kept = told.select(
        "_part", "root_id", "_path", "home", (F.col("_native") & ((F.col("_there") & ~left_out) | (F.col("_object").isNotNull() & yes(h("kind") == DIRECTORY)))).alias("counted"), F.col("_object").isNotNull().alias("identity"),
        (scope & F.col("_object").isNull()).alias("is_scope"), "kind", "size", "allocated", "device", "inode", "observed_at_ns", yes(F.col("skip")).alias("skip"), F.col("_pc").alias("own_complete"), F.col("_pe").alias("own_error"), F.col("_pt").alias("own_checked_ns"),
        F.when(below, own_part).otherwise(h("in_part")).alias("parent_partial"), "missing_at", F.when(below & own_gone, mine).otherwise(F.col("gone_at")).alias("gone_at"), F.when(below & ~own_sure, mine).otherwise(F.col("unsure_at")).alias("unsure_at"),
        F.coalesce("_cg", F.lit(0).cast("long")).alias("_cg"), *[F.coalesce(f"_c_{c}", F.lit(0).cast("long")).alias(f"_c_{c}") for c in compacted], "_low_a", "_low_s", "_high_s", "_n", "_differ",
        F.when(left_out, NOT_OBSERVED).when(below, NOT_A_DIRECTORY).otherwise(F.col("_why")).cast("int").alias("reason"), (yes(F.col("_chain_partial")) | (depth >= ANCESTORS)).alias("chain_partial"), yes(F.col("_chain_stale")).alias("chain_stale"),
    )
    return kept.where("counted or is_scope")


def _first_rows(rows: DataFrame, limit: int, tasks: int) -> DataFrame:
    """The first rows of each scope by path and whether more follow; what a part holds of a scope is cut before it is moved."""
    order = [F.asc("_path")]
    few = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("root_id", "scope", "_part").orderBy(*order))).where(F.col("_nth") <= limit + 1)
    few = few.repartition(tasks, "root_id", "scope")
    ranked = few.withColumn("_nth", F.row_number().over(Window.partitionBy("root_id", "scope").orderBy(*order))).where(F.col("_nth") <= limit + 1)
    return ranked.withColumn("_truncated", F.max("_nth").over(Window.partitionBy("root_id", "scope")) > limit).where(F.col("_nth") <= limit).drop("_nth")


def _scoped(rows: DataFrame) -> DataFrame:
    """Each counted row once for each scope it lies in, with whether the scope leaves it out and whether all between them is sure."""
    levels = F.posexplode(_levels(F.col("home"))).alias("level", "scope")
    return rows.where("counted").select("*", levels).withColumns({"excluded": F.col("gone_at") > F.greatest("level", "missing_at"), "confirmed": F.col("unsure_at") <= F.col("level"), "_truncated": F.lit(False)})


def _sums(r: DataFrame) -> DataFrame:
    """Figures of scopes that need no identities."""
    zero = F.lit(0).cast("long")
    live, file, directory, inside = ~F.col("excluded"), F.col("kind") == FILE, F.col("kind") == DIRECTORY, F.col("_path") != F.col("scope")
    incomplete, failed = directory & ~F.coalesce("own_complete", F.lit(False)), directory & F.coalesce("own_error", F.lit(False))
    compact = live & directory & (F.col("_cg") > 0)
    of = lambda c: F.when(compact, F.col(f"_c_{c}")).otherwise(0)
    partial = F.col("skip") | incomplete | failed | (F.col("parent_partial") & inside) | (of("unknown_inodes") > 0) | (of("skipped_files") > 0)
    stale = (~F.col("confirmed") & inside) | (directory & F.coalesce((F.col("own_checked_ns") > 0) & (F.col("observed_at_ns") > F.col("own_checked_ns")), F.lit(False)))
    named = (F.col("device") != "") & (F.col("inode") != "")
    total = lambda c: F.coalesce(F.sum(c), zero)
    return r.groupBy("root_id", "scope").agg(
        F.count("*").alias("entries_examined"),
        F.count_if("excluded").alias("excluded_entries"),
        (F.count_if(live & file) + total(of("files"))).alias("file_paths"),
        (total(F.when(live & file, F.col("size"))) + total(of("logical"))).alias("logical_bytes"),
        total(F.when(live & file & ~named, F.col("allocated"))).alias("_loose"),
        (F.count_if(live & file & ~named) + total(of("unknown_inodes"))).alias("unknown_inodes"),
        F.bool_or(of("unknown_inodes") > 0).alias("_unknown"),
        F.count_if(live & ~F.col("confirmed") & inside).alias("unconfirmed"),
        (F.count_if(live & F.col("skip")) + total(of("skipped_files"))).alias("skipped_entries"),
        F.count_if(live & incomplete).alias("incomplete_directories"),
        F.count_if(live & failed).alias("directory_errors"),
        F.count_if(compact).alias("compacted_directories"),
        total(of("files")).alias("compacted_files"),
        F.min(F.when(live, F.col("observed_at_ns"))).alias("oldest_ns"),
        F.max(F.when(live, F.greatest("observed_at_ns", F.when(compact & (F.col("own_checked_ns") > 0), F.col("own_checked_ns"))))).alias("newest_ns"),
        F.bool_or(live & partial).alias("_partial"),
        F.bool_or(live & stale).alias("_stale"),
        F.bool_or("_truncated").alias("truncated"),
    )


def _linked(r: DataFrame) -> DataFrame:
    """Figures of scopes that count each object once, from their files and the identities of compacted directories."""
    named = (F.col("device") != "") & (F.col("inode") != "")
    met = ~F.col("excluded") & (F.col("identity") | (F.col("kind") == FILE) & named)
    own = lambda c, other: F.when(F.col("identity"), F.col(c)).otherwise(F.col(other))
    objects = r.where(met).groupBy("root_id", "scope", "device", "inode").agg(
        F.max("allocated").alias("a"), F.sum(F.when(F.col("identity"), F.col("_n")).otherwise(1)).alias("n"), F.min("allocated").alias("low_a"),
        F.min(own("_low_s", "size")).alias("low_s"), F.max(own("_high_s", "size")).alias("high_s"), F.bool_or(F.coalesce("_differ", F.lit(False))).alias("differ"),
    )
    apart = (F.col("low_a") != F.col("a")) | (F.col("low_s") != F.col("high_s"))
    return objects.groupBy("root_id", "scope").agg(F.sum("a").alias("_linked"), F.sum(F.col("n") - 1).alias("repeated"), F.bool_or(F.col("differ") | apart).alias("_differ"))


def measure_directories(entries: DataFrame, directories: DataFrame, scopes: DataFrame | None = None, root_errors: DataFrame | None = None, totals: DataFrame | None = None, ledger: DataFrame | None = None, entry_limit: int | None = None) -> DataFrame:
    """Sizes below each scope (root_id, scope as text) with their status, each linked object counted once.

    Without ``scopes`` every directory, and every parent that has no row, is one. A root has one row for a path.
    Rows that a completed listing says are gone are counted as examined and excluded only. A scope
    that is not there, or above which something is no directory or gone, is ``unknown`` with null
    sizes and the reason. ``root_errors`` names roots whose scopes are stale. ``totals`` and ``ledger``
    are what ``compact`` left of compacted directories: they replace the files there, and their
    identities meet those of ordinary files; where one holds files without identity, allocated bytes
    are unknown. ``entry_limit`` measures the first rows of each scope by path only, and says so.
    Sizes that overflow raise.

    Rows stand in the order of their paths where they are counted, so that a task adds up most scopes
    before anything is moved.
    """
    rows = written(_marked(entries, directories, scopes, totals, ledger), "measured-rows", compression="zstd")
    zero = F.lit(0).cast("long")
    chains = rows.where("is_scope").groupBy("root_id", F.col("_path").alias("scope")).agg(F.max("reason").alias("_why"), F.bool_or("chain_partial").alias("_chain_partial"), F.bool_or("chain_stale").alias("_chain_stale"))
    scoped = _scoped(rows)
    by_row, by_object = _sums(scoped.where("not identity")), _linked(scoped)
    if entry_limit:  # scopes of more rows are few or many: theirs are cut and added up anew
        by_row = written(by_row, "scope-sums", compression="zstd")
        large = written(by_row.where(F.col("entries_examined") > entry_limit).select("root_id", "scope"), "large-scopes")
        ways = rows.where("counted and not identity").agg(F.coalesce(F.sum(F.size(_levels(F.col("_path")))), zero)).first()[0]
        tasks = max(1, min(100_000, -(-ways // ROWS_OF_TASK)))
        held = scoped.join(large, ["root_id", "scope"])
        first = written(_first_rows(held.where("not identity"), entry_limit, tasks), "first-rows", compression="zstd")
        met = held.where("identity").join(first.select("root_id", "scope", "_path"), ["root_id", "scope", "_path"], "left_semi")
        by_row = by_row.where(F.col("entries_examined") <= entry_limit).unionByName(_sums(first))
        by_object = by_object.join(large, ["root_id", "scope"], "left_anti").unionByName(_linked(first.unionByName(met)))
    found = chains.join(by_row, ["root_id", "scope"], "left").join(by_object, ["root_id", "scope"], "left")
    if root_errors is not None:
        found = found.join(root_errors.select("root_id", F.lit(True).alias("_root_error")).distinct(), "root_id", "left")
    else:
        found = found.withColumn("_root_error", F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    unknown_reason = F.when(F.col("_why") == NOT_OBSERVED, "not_observed").when(F.col("_why") == NOT_A_DIRECTORY, "not_a_directory").when(F.col("_why") == ABSENT, "absent_from_parent_listing")
    known = F.col("_why").isNull() & F.col("entries_examined").isNotNull()
    stale, partial = F.col("_stale") | yes("_differ") | yes("_root_error") | yes("_chain_stale"), F.col("_partial") | F.col("truncated") | yes("_chain_partial")
    status = F.when(~known, "unknown").when(stale, "stale").when(partial, "partial").otherwise("recorded_complete")
    only = lambda c: F.when(known, c)
    plain = [c for c in MEASURES if c not in ("allocated_bytes", "repeated")]
    return found.select(
        "root_id", "scope", status.alias("status"), unknown_reason.alias("unknown_reason"), *[only(F.col(c)).alias(c) for c in plain],
        only(F.when(~F.col("_unknown"), F.col("_loose") + F.coalesce("_linked", zero))).alias("allocated_bytes"), only(F.coalesce("repeated", zero)).alias("repeated"),
    )


def identity_reduction(rows: DataFrame, by: list[str]) -> DataFrame:
    """Objects of each scope counted once: allocated bytes, paths, repeats and conflicting objects."""
    objects = rows.groupBy(*by, "device", "inode").agg(
        F.max("allocated").alias("_a"), F.count("*").alias("_n"), F.sum("logical").alias("_l"), differ("allocated", "logical").alias("_differ")
    )
    return objects.groupBy(*by).agg(
        F.count("*").alias("objects"), F.sum("_a").alias("allocated_bytes"), F.sum("_l").alias("logical_bytes"), F.sum("_n").alias("paths"),
        F.sum(F.col("_n") - 1).alias("repeated"), F.count_if("_differ").alias("conflicting"),
    )


def scope_sizes(entries: DataFrame, directories: DataFrame, totals: DataFrame | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """Sizes below every directory above the files, each linked object counted once in each scope.

    Only the files' own listings exclude rows. ``totals`` and ``ledger`` are what ``compact`` left of
    compacted directories: their sums are added, and their identities meet those of ordinary files.
    """
    gone = directories.where("complete and last_error = ''").select("root_id", F.col("path").alias("parent"), F.col("generation").alias("_g"))
    rows = entries.join(gone, ["root_id", "parent"], "left").withColumn("live", ~F.coalesce(F.col("_g") != F.col("generation"), F.lit(False)))
    named, live, zero, none = F.col("inode") != "", F.col("live"), F.lit(0).cast("long"), F.lit(None).cast("long")
    one = lambda test: F.when(test, 1).otherwise(0).cast("long")
    of = lambda test, c: F.when(test, F.col(c)).otherwise(0)
    keyed = live & named
    # one chain from rows to a directory's objects, to a scope's, to the scope; what has no object is summed under a null one
    objects = rows.select(
        "root_id", "parent", F.when(keyed, F.col("device")).alias("device"), F.when(keyed, F.col("inode")).alias("inode"), F.lit(1).cast("long").alias("entries_examined"), one(~live).alias("excluded_entries"), one(live).alias("file_paths"),
        of(live, "size").alias("logical_bytes"), of(live & ~named, "allocated").alias("loose"), one(live & ~named).alias("unknown_inodes"), F.when(live, F.col("observed_at_ns")).alias("oldest_ns"), F.when(live, F.col("observed_at_ns")).alias("newest_ns"),
        zero.alias("compacted_directories"), one(keyed).alias("n"), F.when(keyed, F.col("allocated")).alias("a"), F.when(keyed, F.col("allocated")).alias("low_a"), F.when(keyed, F.col("size")).alias("low_s"), F.when(keyed, F.col("size")).alias("high_s"),
    )
    if totals is not None:
        text = lambda c: F.lit(None).cast(objects.schema[c].dataType).alias(c)
        sums = totals.select(
            "root_id", "parent", text("device"), text("inode"), zero.alias("entries_examined"), zero.alias("excluded_entries"), F.col("files").alias("file_paths"), F.col("logical").alias("logical_bytes"), zero.alias("loose"), "unknown_inodes",
            none.alias("oldest_ns"), none.alias("newest_ns"), F.lit(1).cast("long").alias("compacted_directories"), zero.alias("n"), none.alias("a"), none.alias("low_a"), none.alias("low_s"), none.alias("high_s"),
        )
        seen = ledger.select(
            "root_id", "parent", "device", "inode", *[zero.alias(c) for c in ("entries_examined", "excluded_entries", "file_paths", "logical_bytes", "loose", "unknown_inodes")], none.alias("oldest_ns"), none.alias("newest_ns"),
            zero.alias("compacted_directories"), F.col("paths").alias("n"), F.col("allocated").alias("a"), F.col("allocated").alias("low_a"), F.col("logical").alias("low_s"), F.col("logical").alias("high_s"),
        )
        objects = objects.unionByName(sums).unionByName(seen)
    added = ["entries_examined", "excluded_entries", "file_paths", "logical_bytes", "loose", "unknown_inodes", "compacted_directories", "n"]
    least, most = ["oldest_ns", "low_a", "low_s"], ["newest_ns", "a", "high_s"]
    merged = [F.sum(c).alias(c) for c in added] + [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in most]
    by_parent = objects.groupBy("root_id", "parent", "device", "inode").agg(*merged)
    up = F.explode(F.concat(paths.ancestors(F.col("parent")), F.array(paths.as_text(F.col("parent"))))).alias("scope")
    by_scope = by_parent.select("root_id", up, "device", "inode", *added, *least, *most).groupBy("root_id", "scope", "device", "inode").agg(*merged)
    told = ["entries_examined", "excluded_entries", "file_paths", "logical_bytes", "unknown_inodes", "compacted_directories"]
    object_ = F.col("inode").isNotNull()
    return by_scope.groupBy("root_id", "scope").agg(
        *[F.sum(c).alias(c) for c in told[:5]], F.min("oldest_ns").alias("oldest_ns"), F.max("newest_ns").alias("newest_ns"), F.sum("compacted_directories").alias("compacted_directories"),
        (F.sum("loose") + F.sum(F.when(object_, F.col("a")).otherwise(0))).alias("allocated_bytes"), F.sum(F.when(object_, F.col("n") - 1).otherwise(0)).alias("repeated"), F.count_if(object_ & ((F.col("low_a") != F.col("a")) | (F.col("low_s") != F.col("high_s")))).alias("conflicting"),
    )


def overlapping_pairs(targets: DataFrame) -> DataFrame:
    """Pairs of targets (id, root_id, path) of which one is the other or lies below it: an equi-join on exploded ancestors."""
    t = targets.select("id", "root_id", paths.as_text(F.col("path")).alias("path"), paths.ancestors(F.col("path")).alias("_above"))
    lower = t.select(F.col("id").alias("lower_id"), "root_id", F.explode(F.concat("_above", F.array("path"))).alias("path"))
    upper = t.select(F.col("id").alias("upper_id"), "root_id", "path")
    found = upper.join(lower, ["root_id", "path"]).where("upper_id <> lower_id")
    return found.select(F.least("upper_id", "lower_id").alias("a"), F.greatest("upper_id", "lower_id").alias("b")).distinct()


def alias_groups(files: DataFrame) -> DataFrame:
    """Objects seen on more than one path, as one row each with the pairs they stand for; pairs are not multiplied out."""
    named = (F.col("device") != "") & (F.col("inode") != "")
    objects = files.where(named).groupBy("device", "inode").agg(F.count_distinct("root_id", "path").alias("paths"), F.min("id").alias("first_id"))
    return objects.where("paths > 1").withColumn("pairs", F.expr("paths * (paths - 1) div 2"))


def page_size_summary(measures: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Total of a page of measured folders in one row; unknown where a folder lacks its figure or two overlap, zero for an empty page.

    Allocated bytes of two or more folders are unknown: a linked object may lie in both.
    """
    crossing = overlaps.agg(F.count("*").alias("_overlaps"))
    total = measures.agg(
        F.count("*").alias("folders"), F.count("logical_bytes").alias("_known"), F.try_sum("logical_bytes").alias("_logical"),
        F.max("allocated_bytes").alias("_allocated"), F.max("status").alias("_status"),
    ).crossJoin(crossing)  # one row each
    reason = (
        F.when(F.col("folders") == 0, None).when(F.col("_overlaps") > 0, "overlap_detected").when(F.col("_known") < F.col("folders"), "measurement_unavailable").when(F.col("_logical").isNull(), "aggregate_overflow")
    )
    allocated_reason = (
        F.when(F.col("folders") == 0, None)
        .when(F.col("folders") > 1, "cross_folder_identity_evidence_unavailable")
        .when(F.col("_status") == "unknown", "measurement_unavailable")
        .when(F.col("_status") != "recorded_complete", "single_folder_incomplete_or_stale")
        .when(F.col("_allocated").isNull(), "single_folder_identity_unavailable")
    )
    return total.withColumn("logical_reason", reason).withColumn("allocated_reason", allocated_reason).select(
        "folders",
        F.when(F.col("folders") == 0, 0).when(F.col("logical_reason").isNull(), F.col("_logical")).alias("logical_bytes"), "logical_reason",
        F.when(F.col("folders") == 0, 0).when(F.col("allocated_reason").isNull(), F.col("_allocated")).alias("allocated_bytes"), "allocated_reason",
    )


def tree_digests(records: DataFrame) -> DataFrame:
    """Digest of each tree's records (tree, path, fields) in the order of their paths, fields framed by their lengths.

    A digest is of one stream, so a tree is one task; its rows are sorted by Spark, which spills, and
    pass a hasher in batches. Records with a null are counted only.
    """
    ship(records.sparkSession)
    framed = F.concat(F.octet_length("path").cast("string"), F.lit(":"), "path", F.octet_length("fields").cast("string"), F.lit(":"), "fields")
    rows = records.select("tree", "path", framed.alias("r")).repartition("tree").sortWithinPartitions("tree", "path", "r").select("tree", F.col("r").cast("binary").alias("r"))
    schema = StructType([records.schema["tree"], StructField("digest", StringType()), StructField("records", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        tree, digest, n = None, None, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((tree, digest.hexdigest(), n), arrow)], schema=arrow)

        for batch in batches:
            for own, r in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest is None or own != tree:
                    if digest is not None:
                        yield row()
                    tree, digest, n = own, hashlib.sha256(), 0
                digest.update(r.as_py() or b"")
                n += 1
        if digest is not None:
            yield row()

    return rows.mapInArrow(run, schema)


def stable_trees(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two passes over the same trees (records as ``tree_digests`` takes them): a digest stands only where both passes agree."""
    a, b = tree_digests(first), tree_digests(second)
    both = a.alias("a").join(b.alias("b"), "tree", "full")
    same = F.coalesce((F.col("a.digest") == F.col("b.digest")) & (F.col("a.records") == F.col("b.records")), F.lit(False))
    return both.select("tree", F.when(same, "metadata_observed").otherwise("tree_changed_during_check").alias("status"), F.when(same, F.col("a.digest")).alias("digest"), F.when(same, F.col("a.records")).alias("records"))


def resolve_link(directory: Column, target: Column) -> Column:
    """Where a relative link leads inside its tree; null if it leaves the tree or is absolute."""
    steps = F.concat(F.when(directory == ".", F.array().cast("array<string>")).otherwise(F.split(directory, "/")), F.split(target, "/"))
    walked = F.aggregate(
        steps,
        F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok")),
        lambda s, x: F.struct(
            F.when((x == ".") | (x == ""), s["at"]).when(x == "..", F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0)))).otherwise(F.concat(s["at"], F.array(x))).alias("at"),
            (s["ok"] & ~((x == "..") & (F.size(s["at"]) == 0))).alias("ok"),
        ),
    )
    return F.when(~target.startswith("/") & walked["ok"], F.array_join(walked["at"], "/"))


def link_targets(nodes: DataFrame) -> DataFrame:
    """Links of a tree (tree, path, kind, link, executable) and whether each ends at an executable file inside it."""
    directory = F.when(F.instr("path", "/") == 0, ".").otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    links = nodes.where("kind = 'symlink'").withColumn("target", resolve_link(directory, F.col("link")))
    files = nodes.select("tree", F.col("path").alias("target"), F.col("kind").alias("_k"), F.col("executable").alias("_x"))
    joined = links.join(files, ["tree", "target"], "left")
    verdict = F.when(F.col("target").isNull(), "outside").when(F.col("_k").isNull(), "missing").when((F.col("_k") != "file") | ~F.col("_x"), "not_executable").otherwise("valid")
    return joined.select("tree", "path", "target", verdict.alias("verdict"))


def tree_role(path: Column) -> Column:
    """Part that a path plays in a dependency tree."""
    parts = F.split(path, "/")
    n = F.size(parts)
    first = F.element_at(parts, 1)
    return (
        F.when(path == ".", "boundary")
        .when(first == ".bin", "bin")
        .when(first.startswith("@") & (n == 1), "scope")
        .when((~first.startswith("@") & (n == 1)) | (first.startswith("@") & (n == 2)), "package")
        .otherwise("content")
    )
