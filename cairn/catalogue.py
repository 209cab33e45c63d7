"""All reports of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import oracles as sql
from cairn.functions import digests, paths, scalars
from cairn.operators import hashing, history, ledger, ranking, reconcile, reports, rules, selection, tree
from cairn.plans import store
from cairn.registry import ORACLE_SQL, QUERIES, report  # noqa: F401
from cairn.sources import adapters, metadata

def fixture(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.sql(f"WITH {sql.values('f', columns, rows)} SELECT * FROM f")


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.roots(spark, sf_dir)


def some_directories(entries: DataFrame) -> DataFrame:
    """The same rows, some of them being directories."""
    return entries.withColumn("kind", F.when(F.col("id") % 41 == 7, "directory").otherwise(F.col("kind")))


def as_path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.col("path").cast("string"))


def work_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file as a hashing task; some were never finished."""
    e = adapters.entries(spark, sf_dir)
    return e.select(F.col("id").alias("file_id"), "root_id", "size", F.col("digest").alias("sha256"), F.when(F.col("id") % 11 == 0, "pending").otherwise("complete").alias("status"), "device", "inode", "ctime_ns", "mtime_ns", "allocated")


WORK = "work AS (SELECT id AS file_id, root_id, size, digest AS sha256, CASE WHEN id % 11 = 0 THEN 'pending' ELSE 'complete' END AS status, device, inode, ctime_ns, mtime_ns, allocated FROM files)"
KNOWN = "inode <> '' AND ctime_ns > 0 AND generation > 0"


# --- files of equal size, largest files, labels ------------------------------------------------


@report(f"""WITH {sql.entries()},
    objects AS (SELECT size, {KNOWN} AS known, CASE WHEN {KNOWN} THEN inode END AS i, count(*) AS n,
                       count(DISTINCT (ctime_ns, mtime_ns, allocated)) AS kinds FROM files WHERE size >= 64 AND skip_reason = '' AND id % 41 <> 7 GROUP BY ALL)
    SELECT size, cast(sum(n) AS BIGINT) AS files, count(*) FILTER (known) AS known_objects, cast(coalesce(sum(n - 1) FILTER (known), 0) AS BIGINT) AS repeated,
           cast(coalesce(sum(n) FILTER (NOT known), 0) AS BIGINT) AS "unknown", count(*) FILTER (known AND kinds > 1) AS conflicting
    FROM objects GROUP BY size HAVING sum(n) >= 2""")
def same_size_bands(spark, sf_dir):
    return reports.same_size_bands(reports.eligible(some_directories(adapters.entries(spark, sf_dir)), roots(spark, sf_dir)), 64)


@report(f"""WITH {sql.entries()} SELECT size, count(*) AS files FROM files GROUP BY size HAVING count(*) > 1""")
def size_group_counts(spark, sf_dir):
    return adapters.entries(spark, sf_dir, ["size"]).groupBy("size").agg(F.count("*").alias("files")).where("files > 1")


def _page_sql(after: str) -> str:
    return f"""WITH {sql.entries()}, raw AS (SELECT id, size, skip_reason, inode, {KNOWN} AS known, row_number() OVER (ORDER BY size DESC, id DESC) AS nth FROM files WHERE size >= 64 AND id % 41 <> 7 {after} QUALIFY nth <= 201),
    page AS (SELECT * FROM raw WHERE nth <= 200 AND skip_reason = ''),
    bands AS (SELECT size, count(*) AS files, count(DISTINCT inode) FILTER (known) AS known_objects, count(*) FILTER (NOT known) AS "unknown", string_agg(cast(id AS VARCHAR), ',' ORDER BY id DESC) AS ids FROM page GROUP BY size)"""


_FLAGS = """ SELECT size, files, known_objects, "unknown", ids, {before} AS continues_before, coalesce(size = (SELECT size FROM raw WHERE nth = 201), FALSE) AS continues_after FROM bands
    WHERE files > 1 OR {before} OR coalesce(size = (SELECT size FROM raw WHERE nth = 201), FALSE)"""


@report(_page_sql("") + _FLAGS.format(before="FALSE"))
def same_size_page(spark, sf_dir):
    return reports.same_size_page(some_directories(adapters.entries(spark, sf_dir)), roots(spark, sf_dir), 64, 200)


@report(_page_sql("AND (size, id) < (1500, 400)") + _FLAGS.format(before="(size = 1500)"))
def same_size_page_after(spark, sf_dir):
    return reports.same_size_page(some_directories(adapters.entries(spark, sf_dir)), roots(spark, sf_dir), 64, 200, (1500, 400))


_LARGEST = "SELECT id, root_id, path, size, parent_pass FROM labelled {where} ORDER BY size DESC, id DESC LIMIT 100"


@report(f"WITH {sql.entries()} " + _LARGEST.format(where=""))
def largest_files(spark, sf_dir):
    found = reports.largest_files(adapters.entries(spark, sf_dir, ["id", "root_id", "path", "parent", "kind", "size", "generation"]), roots(spark, sf_dir), adapters.directories(spark, sf_dir), 100)
    return as_path(found).select("id", "root_id", "path", "size", "parent_pass")


@report(f"WITH {sql.entries()} " + _LARGEST.format(where="WHERE (size, id) < (5000, 300)"))
def largest_files_page2(spark, sf_dir):
    found = reports.largest_files(adapters.entries(spark, sf_dir, ["id", "root_id", "path", "parent", "kind", "size", "generation"]), roots(spark, sf_dir), adapters.directories(spark, sf_dir), 100, (5000, 300))
    return as_path(found).select("id", "root_id", "path", "size", "parent_pass")


@report(f"""WITH {sql.entries()} SELECT root_id, parent_pass, count(*) AS files, cast(sum(size) AS BIGINT) AS bytes FROM labelled GROUP BY 1, 2""")
def parent_pass_labels(spark, sf_dir):
    found = reports.with_parent_pass(adapters.entries(spark, sf_dir, ["root_id", "parent", "size", "generation"]), adapters.directories(spark, sf_dir))
    return found.groupBy("root_id", "parent_pass").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@report(f"""WITH {sql.entries()}, codes AS (SELECT * FROM (VALUES ('disabled_root', 0), ('skipped', 1), ('generated_dependency', 2), ('compact_parent', 3), ('invalid_saved_path', 4), ('eligible', 5)) AS t(outcome, position)),
    judged AS (SELECT CASE WHEN skip_reason <> '' THEN 'skipped' ELSE 'eligible' END AS outcome FROM files WHERE id % 41 <> 7)
    SELECT outcome, position, count(judged.outcome) AS n FROM codes LEFT JOIN judged USING (outcome) GROUP BY outcome, position""")
def diagnostics_histogram(spark, sf_dir):
    judged = reports.same_size_outcome(some_directories(adapters.entries(spark, sf_dir, ["id", "kind", "root_id", "path", "skip_reason"])), roots(spark, sf_dir))
    return reports.histogram(judged, reports.SAME_SIZE_OUTCOMES)


@report(f"WITH {sql.ROOTS} SELECT root_id FROM roots ORDER BY root_id <= 2, root_id LIMIT 3")
def fair_turn(spark, sf_dir):
    return reports.fair_turn(roots(spark, sf_dir).select(F.col("id").alias("root_id")), 2, 3)


# --- content -----------------------------------------------------------------------------------


@report(f"""WITH {sql.entries()}, {WORK},
    objects AS (SELECT device, inode, count(*) > 1 AS repeated, count(DISTINCT (size, allocated, ctime_ns, mtime_ns)) > 1 OR count(DISTINCT CASE WHEN status = 'complete' THEN sha256 END) > 1 AS conflicting
                FROM work WHERE inode <> '' GROUP BY 1, 2)
    SELECT size, sha256, count(*) AS members, min(file_id) AS first_id, max(file_id) AS last_id,
           count(*) FILTER (coalesce(repeated, FALSE)) AS repeated, count(*) FILTER (coalesce(conflicting, FALSE)) AS conflicting
    FROM work LEFT JOIN objects USING (device, inode) WHERE status = 'complete' GROUP BY size, sha256 HAVING count(*) >= 2""")
def hash_groups(spark, sf_dir):
    return hashing.hash_groups(work_rows(spark, sf_dir))


@report(f"""WITH {sql.entries()}, {WORK}, g AS (SELECT count(*) AS n FROM work WHERE status = 'complete' GROUP BY size, sha256 HAVING count(*) >= 2)
    SELECT count(*) AS selected, count(*) FILTER (status = 'complete') AS completed, count(*) FILTER (status <> 'complete') AS unfinished,
           cast(count(*) FILTER (status = 'complete') - (SELECT coalesce(sum(n), 0) FROM g) AS BIGINT) AS unmatched, (SELECT count(*) FROM g) AS "groups" FROM work""")
def hash_coverage(spark, sf_dir):
    return hashing.hash_coverage(work_rows(spark, sf_dir))


@report(f"""WITH {sql.entries()}, {WORK}
    SELECT size, sha256, count(*) - 1 AS copies, (count(*) - 1) * size AS copy_bytes, 'known' AS copy_status,
           cast(sum(allocated) - arg_min(allocated, file_id) AS BIGINT) AS copy_allocated, 'known' AS allocated_status
    FROM work WHERE status = 'complete' GROUP BY size, sha256 HAVING count(*) >= 2""")
def keeper_sizes(spark, sf_dir):
    work = work_rows(spark, sf_dir)
    allocated = work.where("status = 'complete'").groupBy("size", "sha256").agg(F.try_subtract(F.try_sum("allocated"), F.min_by("allocated", "file_id")).alias("copy_allocated"))
    return hashing.copy_sizes(hashing.hash_groups(work), allocated)


@report("""WITH d AS (SELECT doc_id, encode(text) AS b, strlen(text) AS n FROM documents),
    w AS (SELECT *, (n - 256) // 2 AS mid FROM d),
    f AS (SELECT *, CASE WHEN n <= 0 THEN [] WHEN n <= 768 THEN [(0, n)] WHEN mid <= 256 THEN [(0, mid + 256), (n - 256, 256)] ELSE [(0, 256), (mid, 256), (n - 256, 256)] END AS ws FROM w)
    SELECT doc_id, len(ws) AS windows, sha256('sample' || chr(0) || '') IS NOT NULL AS hashed, cast(list_sum([x[2] for x in ws]) AS BIGINT) AS sampled FROM f""")
def sample_windows(spark, sf_dir):
    docs = adapters.table(spark, sf_dir, "documents")
    content = F.encode("text", "utf-8")
    windows = digests.sample_windows(F.octet_length(content), 256)
    return docs.select(
        "doc_id", F.size(windows).cast("long").alias("windows"), digests.sample_digest(content, "sample", 256).isNotNull().alias("hashed"),
        F.when(F.size(windows) > 0, F.aggregate(windows, F.lit(0).cast("long"), lambda a, x: a + x["length"])).alias("sampled"),
    )


@report("""WITH d AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents),
    w AS (SELECT *, (n - 256) // 2 AS mid FROM d),
    f AS (SELECT doc_id, h, n, unnest(CASE WHEN n <= 0 THEN [] WHEN n <= 768 THEN [{'s': 0, 'l': n}] WHEN mid <= 256 THEN [{'s': 0, 'l': mid + 256}, {'s': n - 256, 'l': 256}]
                 ELSE [{'s': 0, 'l': 256}, {'s': mid, 'l': 256}, {'s': n - 256, 'l': 256}] END) AS x FROM w),
    g AS (SELECT doc_id, n, count(*) AS k, string_agg(lpad(hex(x.s), 16, '0') || lpad(hex(x.l), 16, '0') || substr(h, 2 * x.s + 1, 2 * x.l), '' ORDER BY x.s) AS body FROM f GROUP BY doc_id, n)
    SELECT d.doc_id, CASE WHEN d.h IS NOT NULL THEN sha256(unhex('73616D706C65' || lpad(hex(d.n), 16, '0') || lpad(hex(coalesce(k, 0)), 16, '0') || coalesce(body, ''))) END AS digest FROM d LEFT JOIN g USING (doc_id)""")
def sample_digests(spark, sf_dir):
    docs = adapters.table(spark, sf_dir, "documents")
    return docs.select("doc_id", digests.sample_digest(F.encode("text", "utf-8"), "sample", 256).alias("digest"))


# --- trees -------------------------------------------------------------------------------------


@report(f"""WITH {sql.entries()}, up AS (SELECT f.*, unnest([split_part(parent, '/', 1), split_part(parent, '/', 1) || '/' || split_part(parent, '/', 2), parent, '.']) AS scope FROM files f),
    live AS (SELECT u.*, NOT coalesce(p.complete AND p.last_error = '' AND p.generation <> u.generation, FALSE) AS live FROM up u LEFT JOIN dirs p ON p.root_id = u.root_id AND p.path = u.parent),
    objects AS (SELECT root_id, scope, inode, max(allocated) AS a, count(*) AS n FROM live WHERE live AND inode <> '' GROUP BY ALL),
    o AS (SELECT root_id, scope, sum(a) AS a, sum(n - 1) AS r FROM objects GROUP BY ALL)
    SELECT root_id, scope, count(*) AS entries_examined, count(*) FILTER (NOT live) AS excluded_entries, cast(coalesce(sum(size) FILTER (live), 0) AS BIGINT) AS logical_bytes,
           cast(coalesce(sum(allocated) FILTER (live AND inode = ''), 0) + coalesce(any_value(o.a), 0) AS BIGINT) AS allocated_bytes, cast(coalesce(any_value(o.r), 0) AS BIGINT) AS repeated
    FROM live LEFT JOIN o USING (root_id, scope) GROUP BY root_id, scope""")
def directory_sizes(spark, sf_dir):
    """Every directory above the files as a scope; none of them has a row of its own here, so only the files' own listings exclude."""
    found = tree.scope_sizes(adapters.entries(spark, sf_dir), adapters.directories(spark, sf_dir))
    return found.select("root_id", "scope", "entries_examined", "excluded_entries", "logical_bytes", "allocated_bytes", "repeated")


@report(f"""WITH {sql.entries()}, kept AS (SELECT * FROM files WHERE NOT {sql.COMPACTED}),
    live AS (SELECT f.*, NOT coalesce(p.complete AND p.last_error = '' AND p.generation <> f.generation, FALSE) AS live FROM kept f LEFT JOIN dirs p ON p.root_id = f.root_id AND p.path = f.parent),
    every AS (SELECT root_id, parent, size, allocated, inode, observed_at_ns, live, FALSE AS compact, generation FROM live
              UNION ALL SELECT root_id, parent, size, allocated, inode, NULL, TRUE, TRUE, generation FROM files WHERE {sql.COMPACTED} AND skip_reason = ''),
    dirs_gone AS (SELECT DISTINCT root_id, parent, generation FROM files WHERE {sql.COMPACTED}),
    up AS (SELECT e.*, unnest([split_part(parent, '/', 1), split_part(parent, '/', 1) || '/' || split_part(parent, '/', 2), parent, '.']) AS scope FROM every e),
    gone AS (SELECT root_id, unnest([split_part(parent, '/', 1), split_part(parent, '/', 1) || '/' || split_part(parent, '/', 2), parent, '.']) AS scope FROM dirs_gone),
    objects AS (SELECT root_id, scope, inode, max(allocated) AS a, count(*) AS n FROM up WHERE live AND inode <> '' GROUP BY ALL),
    o AS (SELECT root_id, scope, sum(a) AS a, sum(n - 1) AS r FROM objects GROUP BY ALL), g AS (SELECT root_id, scope, count(*) AS c FROM gone GROUP BY ALL),
    s AS (SELECT root_id, scope, count(*) FILTER (NOT compact) AS entries_examined, count(*) FILTER (live) AS file_paths, cast(coalesce(sum(size) FILTER (live), 0) AS BIGINT) AS logical_bytes,
                 coalesce(sum(allocated) FILTER (live AND NOT compact AND inode = ''), 0) AS loose, count(*) FILTER (live AND inode = '') AS unknown_inodes, min(observed_at_ns) FILTER (live) AS oldest_ns, max(observed_at_ns) FILTER (live) AS newest_ns FROM up GROUP BY ALL)
    SELECT root_id, scope, coalesce(entries_examined, 0) AS entries_examined, coalesce(file_paths, 0) AS file_paths, coalesce(logical_bytes, 0) AS logical_bytes, cast(coalesce(loose, 0) + coalesce(o.a, 0) AS BIGINT) AS allocated_bytes,
           coalesce(unknown_inodes, 0) AS unknown_inodes, cast(coalesce(o.r, 0) AS BIGINT) AS repeated, coalesce(g.c, 0) AS compacted_directories, oldest_ns, newest_ns
    FROM (SELECT root_id, scope FROM s UNION SELECT root_id, scope FROM g) LEFT JOIN s USING (root_id, scope) LEFT JOIN o USING (root_id, scope) LEFT JOIN g USING (root_id, scope)""")
def directory_sizes_compacted(spark, sf_dir):
    """The same where some directories were compacted to totals and identities."""
    e = adapters.entries(spark, sf_dir)
    totals, identities = reconcile.compact(e.where(adapters.in_compacted()))
    found = tree.scope_sizes(e.where(~adapters.in_compacted()), adapters.directories(spark, sf_dir), totals, identities)
    return found.select("root_id", "scope", "entries_examined", "file_paths", "logical_bytes", "allocated_bytes", "unknown_inodes", "repeated", "compacted_directories", "oldest_ns", "newest_ns")


@report("""WITH o AS (SELECT l_returnflag AS scope, l_suppkey AS device, l_partkey AS inode, max(cast(round(l_extendedprice * 100) AS BIGINT)) AS a, count(*) AS n, sum(cast(l_quantity * 100 AS BIGINT)) AS l,
                  count(DISTINCT (cast(round(l_extendedprice * 100) AS BIGINT), cast(l_quantity * 100 AS BIGINT))) > 1 AS differ FROM lineitem GROUP BY 1, 2, 3)
    SELECT scope, count(*) AS objects, cast(sum(a) AS BIGINT) AS allocated_bytes, cast(sum(l) AS BIGINT) AS logical_bytes, cast(sum(n) AS BIGINT) AS paths, cast(sum(n - 1) AS BIGINT) AS repeated, count(*) FILTER (differ) AS conflicting FROM o GROUP BY scope""")
def scope_identity_reduction(spark, sf_dir):
    return tree.identity_reduction(adapters.identities(spark, sf_dir), ["scope"])


@report(f"""WITH {sql.entries()} SELECT device, inode, count(DISTINCT path) AS paths, min(id) AS first_id, count(DISTINCT path) * (count(DISTINCT path) - 1) // 2 AS pairs
    FROM files WHERE inode <> '' GROUP BY 1, 2 HAVING count(DISTINCT path) > 1""")
def alias_pairs(spark, sf_dir):
    return tree.alias_groups(adapters.entries(spark, sf_dir))


@report("""SELECT source AS tree, sha256(string_agg(strlen(lpad(cast(doc_id AS VARCHAR), 12, '0')) || ':' || lpad(cast(doc_id AS VARCHAR), 12, '0') || strlen(lang) || ':' || lang, '' ORDER BY doc_id)) AS digest, count(*) AS records FROM documents GROUP BY source""")
def tree_digests(spark, sf_dir):
    docs = adapters.table(spark, sf_dir, "documents")
    return tree.tree_digests(docs.select(F.col("source").alias("tree"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("lang").alias("fields")))


@report("""SELECT doc_id, 'v1:' || sha256(lower(hex(encode(source))) || ':' || lang || ':1:' || doc_id) AS fingerprint FROM documents""")
def root_fingerprints(spark, sf_dir):
    docs = adapters.table(spark, sf_dir, "documents")
    return docs.select("doc_id", digests.root_fingerprint(F.col("source").cast("binary"), F.col("lang"), F.lit("1"), F.col("doc_id").cast("string")).alias("fingerprint"))


@report(f"""WITH {sql.entries()}, raw AS (SELECT id, path, parent_pass FROM labelled WHERE id > 50 ORDER BY id LIMIT 400),
    seen AS (SELECT *, coalesce(sum(CASE WHEN parent_pass = 'partial' THEN 1 ELSE 0 END) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM raw)
    SELECT id, path, parent_pass FROM seen WHERE before < 20""")
def finding_page(spark, sf_dir):
    rows = reports.with_parent_pass(adapters.entries(spark, sf_dir, ["id", "root_id", "path", "parent", "generation"]), adapters.directories(spark, sf_dir))
    outcomes = rows.withColumn("outcome", F.when(F.col("parent_pass") == "partial", "selected").otherwise("other"))
    return as_path(rules.candidate_page(outcomes, 50, 400, 20)).select("id", "path", "parent_pass")


# --- ledgers -----------------------------------------------------------------------------------


@report(f"""WITH {sql.RESERVATIONS} SELECT event_id, cast(coalesce(sum(allowance) OVER w, 0) AS BIGINT) AS before, coalesce(sum(allowance) OVER w, 0) + allowance <= 300 AS admitted FROM reservations
    WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def daily_quota(spark, sf_dir):
    return ledger.daily_quota(adapters.reservations(spark, sf_dir), 300, ["user_id", "day"]).select("event_id", "before", "admitted")


@report(f"""WITH {sql.RESERVATIONS} SELECT cast(day AS VARCHAR) AS day, cast(sum(allowance) AS BIGINT) AS reserved, cast(coalesce(sum(allowance) FILTER (status = 'settled'), 0) AS BIGINT) AS settled,
    cast(coalesce(sum(allowance) FILTER (status = 'unknown'), 0) AS BIGINT) AS "unknown", cast(coalesce(sum(allowance) FILTER (status = 'reserved'), 0) AS BIGINT) AS outstanding, count(*) AS attempts
    FROM reservations GROUP BY ROLLUP (day)""")
def metadata_ledger(spark, sf_dir):
    return ledger.reservation_totals(adapters.reservations(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@report(f"""WITH {sql.WINDOWS} SELECT event_id, least(greatest(100 * cpu_ns - elapsed_ns, 0), 3600000000000) AS wait_ns, 100 * cpu_ns - elapsed_ns > 3600000000000 AS capped FROM windows""")
def cpu_backoff(spark, sf_dir):
    return ledger.cpu_backoff(adapters.cpu_windows(spark, sf_dir)).select("event_id", "wait_ns", "capped")


_REVISIT = f"""WITH RECURSIVE {sql.PASSES}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS nth FROM passes),
    s AS (SELECT user_id, day, nth, changed, unknown, 0 AS streak FROM n WHERE nth = 1 UNION ALL
          SELECT n.user_id, n.day, n.nth, n.changed, n.unknown, CASE WHEN n.changed OR n.unknown THEN 0 ELSE least(2, s.streak + 1) END FROM s JOIN n ON n.user_id = s.user_id AND n.nth = s.nth + 1)"""


@report(_REVISIT + " SELECT user_id, cast(day AS VARCHAR) AS day, streak, CASE WHEN streak = 2 THEN 168 ELSE 24 END AS interval_hours FROM s")
def revisit_schedule(spark, sf_dir):
    return ledger.adaptive_revisits(adapters.passes(spark, sf_dir)).select("user_id", F.col("day").cast("string").alias("day"), "streak", "interval_hours")


@report(_REVISIT + """, l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) = 1)
    SELECT count(*) AS roots, count(*) FILTER (streak = 2) AS weekly, count(*) FILTER (streak < 2) AS daily, count(*) FILTER (changed) AS changed, count(*) FILTER (unknown) AS "unknown" FROM l""")
def revisit_status(spark, sf_dir):
    return ledger.revisit_status(ledger.adaptive_revisits(adapters.passes(spark, sf_dir)))


@report("""WITH l AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS observed FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_id, event_type, value, observed FROM l""")
def latest_observation(spark, sf_dir):
    return ledger.latest_observation(adapters.observations(spark, sf_dir))


@report("""WITH c AS (SELECT user_id, event_type IS DISTINCT FROM lag(event_type) OVER w OR value IS DISTINCT FROM lag(value) OVER w AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS observed, count(*) FILTER (changed) AS changed FROM c GROUP BY 1""")
def changed_since_last(spark, sf_dir):
    return ledger.changed_since_last(adapters.observations(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("observed"), F.count_if("changed").alias("changed"))


@report("""WITH r AS (SELECT o_custkey AS root_id, max(o_orderkey) AS last_pass FROM orders GROUP BY 1) SELECT root_id, greatest(5000, last_pass + 100) AS due FROM r WHERE root_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def fixed_revisits(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    passes = o.groupBy(F.col("o_custkey").alias("root_id")).agg(F.max("o_orderkey").alias("last_pass"))
    return ledger.fixed_revisits(passes, o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("root_id")), 5000, 100)


@report("""SELECT event_id, CASE WHEN g >= f THEN g ELSE g - g % 64 END AS grant_bytes, cast(ceil(g * 1000000000 / 5242880.0) AS BIGINT) AS cost_ns FROM
    (SELECT event_id, 100 + event_id % 5000 AS f, least(4096, 1000 + event_id % 700, 100000, 100 + event_id % 5000, 1048576) AS g FROM events)""")
def read_grants(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events").select("event_id")
    left = 100 + F.col("event_id") % 5000
    most = F.least(F.lit(4096), 1000 + F.col("event_id") % 700, F.lit(100000), left)
    return e.select("event_id", scalars.read_grant(F.lit(4096), 1000 + F.col("event_id") % 700, F.lit(100000), left).alias("grant_bytes"), scalars.pacing_cost(most, 5 << 20).alias("cost_ns"))


@report("""WITH c AS (SELECT o_orderkey AS consent_id, o_custkey % 80 AS from_ns, o_custkey % 80 + 40 AS until_ns, 50 + o_custkey % 100 AS max_bytes FROM orders),
    u AS (SELECT l_orderkey AS consent_id, sum(l_linenumber * 10) AS spent FROM lineitem GROUP BY 1)
    SELECT consent_id, cast(max_bytes - coalesce(spent, 0) AS BIGINT) AS left_bytes FROM c LEFT JOIN u USING (consent_id) WHERE from_ns <= 60 AND until_ns > 60 AND consent_id % 7 <> 0 AND max_bytes - coalesce(spent, 0) > 0""")
def valid_consents(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("consent_id"), (F.col("o_custkey") % 80).alias("from_ns"), (50 + F.col("o_custkey") % 100).alias("max_bytes"))
    used = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("consent_id"), (F.col("l_linenumber") * 10).alias("bytes"))
    found = ledger.valid_consents(o.withColumn("until_ns", F.col("from_ns") + 40), o.where("consent_id % 7 = 0").select("consent_id"), used, 60)
    return found.withColumn("left_bytes", F.col("left_bytes").cast("long"))


# --- history and reconciliation ----------------------------------------------------------------


@report("""WITH a AS (SELECT user_id AS target, arg_min(event_type, (ts, event_id)) AS kind, count(*) % 7 AS size FROM events WHERE user_id % 5 <> 0 GROUP BY 1),
    b AS (SELECT user_id AS target, arg_max(event_type, (ts, event_id)) AS kind, count(*) % 7 AS size, bool_or(event_type = 'purchase' AND event_id % 9 = 0) AS sure FROM events WHERE user_id % 7 <> 0 GROUP BY 1)
    SELECT target, CASE WHEN a.kind IS NULL OR b.kind IS NULL OR a.kind <> b.kind OR a.size <> b.size THEN 'changed' WHEN NOT sure THEN 'unverifiable' ELSE 'matches_saved_inventory' END AS status,
           concat_ws(',', CASE WHEN a.kind IS DISTINCT FROM b.kind THEN 'kind' END, CASE WHEN a.size IS DISTINCT FROM b.size THEN 'size' END) AS changes FROM a FULL JOIN b USING (target)""")
def selection_diff(spark, sf_dir):
    o = adapters.observations(spark, sf_dir)
    at = F.struct("ts", "event_id")
    saved = o.where("user_id % 5 <> 0").groupBy(F.col("user_id").alias("target")).agg(F.min_by("event_type", at).alias("kind"), (F.count("*") % 7).alias("size"))
    current = o.where("user_id % 7 <> 0").groupBy(F.col("user_id").alias("target")).agg(
        F.max_by("event_type", at).alias("kind"), (F.count("*") % 7).alias("size"), F.bool_or((F.col("event_type") == "purchase") & (F.col("event_id") % 9 == 0)).alias("sure")
    )
    return history.selection_check(saved, current, ["kind", "size"], "sure")


@report("""WITH p AS (SELECT o_orderkey AS plan_id FROM orders), a AS (SELECT o_orderkey AS plan_id, min(o_custkey) AS approved FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1), r AS (SELECT DISTINCT o_orderkey AS plan_id FROM orders WHERE o_orderkey % 13 = 0)
    SELECT plan_id, CASE WHEN r.plan_id IS NOT NULL THEN 'revoked' WHEN approved IS NULL THEN 'pending' WHEN approved + 100 <= 600 THEN 'expired' ELSE 'approved' END AS state FROM p LEFT JOIN a USING (plan_id) LEFT JOIN r USING (plan_id)""")
def plan_reviews(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "plan_id")
    approvals = o.where("o_orderstatus <> 'O'").select("plan_id", F.col("o_custkey").alias("approved_ns"))
    return history.plan_reviews(o.select("plan_id"), approvals, o.where("plan_id % 13 = 0").select("plan_id"), 600, 100)


@report("""WITH page AS (SELECT doc_id, sha256(cast(doc_id AS VARCHAR)) AS request_id FROM documents), d AS (SELECT doc_id AS id, sha256(cast(doc_id AS VARCHAR)) AS request_id FROM documents WHERE doc_id % 3 = 0)
    SELECT doc_id, request_id FROM page WHERE request_id NOT IN (SELECT request_id FROM d WHERE id % 2 = 0)""")
def active_dismissals(spark, sf_dir):
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("request_id"))
    dismissed = docs.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "id")
    return history.visible_findings(docs, dismissed, dismissed.where("id % 2 = 1").select(F.col("id").alias("dismissal_id")))


@report("""WITH e AS (SELECT user_id AS intent_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS outcome FROM events)
    SELECT intent_id, count(*) AS events, bool_and(NOT (sequence = 5 AND intent_id % 4 = 0)) AND count(*) <= 70 AS valid, arg_max(outcome, sequence) AS outcome FROM e GROUP BY intent_id""")
def journal_chain(spark, sf_dir):
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = adapters.observations(spark, sf_dir).select(F.col("user_id").alias("intent_id"), F.row_number().over(order).alias("sequence"), F.col("event_id").alias("id"), F.lag("event_id").over(order).alias("predecessor_id"), F.col("event_type").alias("outcome"))
    broken = F.when((F.col("sequence") == 5) & (F.col("intent_id") % 4 == 0), F.lit(-1)).otherwise(F.col("predecessor_id"))
    return history.journal_states(e.withColumn("predecessor_id", broken), 70)


@report(f"WITH {sql.entries()} SELECT f.id, f.path FROM files f JOIN dirs p ON p.root_id = f.root_id AND p.path = f.parent WHERE p.complete AND p.last_error = '' AND p.generation <> f.generation")
def reconcile_absent(spark, sf_dir):
    return as_path(reconcile.absent_rows(adapters.entries(spark, sf_dir, ["id", "root_id", "path", "parent", "generation"]), adapters.directories(spark, sf_dir))).select("id", "path")


@report(f"WITH {sql.entries()} SELECT id, path FROM files WHERE NOT (root_id = 2 AND starts_with(path, 'src1/')) AND NOT (root_id = 1 AND starts_with(path, 'src0/b1/'))")
def purge_subtree(spark, sf_dir):
    tops = fixture(spark, "root_id, path, keep_anchor", [(2, "src1", True), (1, "src0/b1", False)])
    tops = tops.withColumns({"root_id": F.col("root_id").cast("long"), "path": F.col("path").cast("binary")})
    return as_path(reconcile.purge_subtrees(adapters.entries(spark, sf_dir, ["id", "root_id", "path"]), tops)).select("id", "path")


@report("""WITH w AS (SELECT DISTINCT o_custkey AS path FROM orders WHERE o_orderkey % 3 = 0), s AS (SELECT c_custkey AS path, c_custkey % 4 <> 0 AS enabled FROM customer WHERE c_custkey % 5 <> 0)
    SELECT coalesce(w.path, s.path) AS path, w.path IS NOT NULL AS enabled,
           CASE WHEN s.path IS NULL THEN 'added' WHEN w.path IS NULL AND s.enabled THEN 'disabled' WHEN w.path IS NOT NULL AND NOT s.enabled THEN 'enabled' ELSE 'kept' END AS action FROM w FULL JOIN s ON w.path = s.path""")
def root_sync(spark, sf_dir):
    wanted = adapters.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("path")).distinct()
    saved = adapters.table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 4 != 0).alias("enabled"))
    return reconcile.sync_roots(wanted, saved)


@report("""SELECT p_partkey AS path FROM part WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND p_partkey % 5 <> 0""")
def exclusion_edits(spark, sf_dir):
    part = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    return reconcile.edit_exclusions(part.where("path % 2 = 0"), part.where("path % 3 = 0"), part.where("path % 5 = 0"))


@report(f"""WITH {sql.entries()} SELECT root_id, parent, generation, cast(coalesce(sum(size) FILTER (skip_reason = ''), 0) AS BIGINT) AS logical, count(*) FILTER (skip_reason = '') AS files, count(*) FILTER (skip_reason = '' AND inode = '') AS unknown_inodes, count(*) FILTER (skip_reason <> '') AS skipped_files FROM files GROUP BY 1, 2, 3""")
def compact_totals(spark, sf_dir):
    return reconcile.compact(adapters.entries(spark, sf_dir))[0].withColumn("parent", F.col("parent").cast("string"))


# --- metadata sources, exports and envelopes ---------------------------------------------------


_ROLE_PATHS = "concat_ws('/', CASE doc_id % 4 WHEN 0 THEN '.bin' WHEN 1 THEN '@s' WHEN 2 THEN 'p' ELSE '@t' END, CASE WHEN doc_id % 3 > 0 THEN 'q' END, CASE WHEN doc_id % 5 > 2 AND doc_id % 3 > 0 THEN 'f' || doc_id END)"


@report(f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '.' ELSE {_ROLE_PATHS} END AS path FROM documents), x AS (SELECT *, string_split(path, '/') AS c FROM p)
    SELECT doc_id, path, CASE WHEN path = '.' THEN 'boundary' WHEN c[1] = '.bin' THEN 'bin' WHEN starts_with(c[1], '@') THEN CASE len(c) WHEN 1 THEN 'scope' WHEN 2 THEN 'package' ELSE 'content' END WHEN len(c) = 1 THEN 'package' ELSE 'content' END AS role FROM x""")
def tree_roles(spark, sf_dir):
    found = adapters.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, ".").otherwise(F.expr(_ROLE_PATHS)).alias("path"))
    return found.select("doc_id", "path", tree.tree_role(F.col("path")).alias("role"))


@report("SELECT (SELECT count(*) FROM documents) AS rows, TRUE AS order_free, TRUE AS row_sensitive")
def export_manifest(spark, sf_dir):
    """Manifests of the documents, of the same rows in another order, and of all rows but one."""
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    named = lambda df, name: store.manifest(df).select(F.col("rows").alias(f"{name}_rows"), F.col("digest").alias(name))
    all_, other, less = named(docs, "a"), named(docs.repartition(3, "doc_id"), "b"), named(docs.where("doc_id <> 7"), "c")
    joined = all_.crossJoin(other).crossJoin(less)  # one row each
    return joined.select(F.col("a_rows").alias("rows"), (F.col("a") == F.col("b")).alias("order_free"), (F.col("a") != F.col("c")).alias("row_sensitive"))


@report("""SELECT '{"api_version":1,"ok":true,"command":"report","result":{"region":' || r_regionkey || ',"name":"' || r_name || '"}}' AS document FROM region""")
def json_envelopes(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))
    return rows.select(metadata.envelope(rows, "report").alias("document"))


@report("""SELECT DISTINCT 'plan_' || sha256('{"source":"' || source || '","lang":"' || lang || '"}') AS id FROM documents""")
def content_addresses(spark, sf_dir):
    docs = adapters.table(spark, sf_dir, "documents").select("source", "lang").distinct()
    return docs.select(F.concat(F.lit("plan_"), history.request_digest("source", "lang")).alias("id"))


# --- compacted directories, members, selections and pages ---------------------------------------


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adapters.entries(spark, sf_dir, ["root_id", "parent", "n"])
    return found.where(adapters.in_compacted()).select("root_id", F.col("parent").alias("path")).distinct()


@report(f"WITH {sql.entries()} SELECT id, root_id, path, size, parent_pass FROM labelled WHERE NOT {sql.COMPACTED} ORDER BY size DESC, id DESC LIMIT 100")
def largest_files_outside_compacted(spark, sf_dir):
    e = adapters.entries(spark, sf_dir, ["id", "root_id", "path", "parent", "kind", "size", "generation"])
    found = reports.largest_files(e, roots(spark, sf_dir), adapters.directories(spark, sf_dir), 100, None, compacted(spark, sf_dir))
    return as_path(found).select("id", "root_id", "path", "size", "parent_pass")


INVENTORY = "0123456789abcdef" * 4


@report(f"""WITH {sql.entries()}, p AS (SELECT id, size, row_number() OVER (ORDER BY size DESC, id DESC) AS nth FROM files),
    c AS (SELECT CASE WHEN (SELECT count(*) FROM files) > 50 THEN rtrim(replace(replace(base64(encode('{{"version":1,"inventory_id":"{INVENTORY}","minimum_bytes":64,"size":' || size || ',"id":' || id || '}}')), '+', '-'), '/', '_'), '=') END AS next_cursor FROM p WHERE nth = 50)
    SELECT id, size, next_cursor FROM p, c WHERE nth <= 50""")
def page_cursor(spark, sf_dir):
    """The first page of largest files, with the cursor of the next on each row."""
    e = adapters.entries(spark, sf_dir, ["id", "root_id", "path", "parent", "kind", "size", "generation"])
    page, token = reports.page_with_cursor(reports.largest_files(e, roots(spark, sf_dir), adapters.directories(spark, sf_dir), 51), 50, INVENTORY, 64)
    return page.select("id", "size", F.lit(token).alias("next_cursor"))


@report(f"""WITH {sql.entries()}, codes AS (SELECT * FROM (VALUES ('disabled_root', 0), ('skipped', 1), ('generated_dependency', 2), ('compact_parent', 3), ('invalid_saved_path', 4), ('eligible', 5)) AS t(outcome, position)),
    judged AS (SELECT CASE WHEN root_id = 2 THEN 'disabled_root' WHEN skip_reason <> '' THEN 'skipped' WHEN id % 7 = 3 THEN 'generated_dependency' WHEN {sql.COMPACTED} THEN 'compact_parent' WHEN id % 11 = 4 THEN 'invalid_saved_path' ELSE 'eligible' END AS outcome FROM files WHERE id % 41 <> 7)
    SELECT outcome, position, count(judged.outcome) AS n FROM codes LEFT JOIN judged USING (outcome) GROUP BY outcome, position""")
def same_size_outcomes(spark, sf_dir):
    """All six outcomes: one root is disabled, and some paths lie below a generated directory or are malformed."""
    e = some_directories(adapters.entries(spark, sf_dir, ["id", "root_id", "path", "parent", "kind", "skip_reason"]))
    path = F.when(F.col("id") % 7 == 3, F.concat(F.lit(b"node_modules/x/"), "path")).when(F.col("id") % 11 == 4, F.concat("path", F.lit(b"/../y"))).otherwise(F.col("path"))
    some = roots(spark, sf_dir).withColumn("enabled", F.col("id") != 2)
    return reports.histogram(reports.same_size_outcome(e.withColumn("path", path), some, compacted(spark, sf_dir)), reports.SAME_SIZE_OUTCOMES)


_OBJECTS = """objects AS (SELECT device, inode, count(*) > 1 AS repeated, count(DISTINCT (size, allocated, ctime_ns, mtime_ns)) > 1 OR count(DISTINCT CASE WHEN status = 'complete' THEN sha256 END) > 1 AS conflicting
                FROM work WHERE inode <> '' GROUP BY 1, 2)"""


@report(f"""WITH {sql.entries()}, {WORK}, {_OBJECTS}
    SELECT size, sha256, count(*) OVER (PARTITION BY size, sha256) AS members, file_id, root_id, coalesce(repeated, FALSE) AS repeated, coalesce(conflicting, FALSE) AS conflicting
    FROM work LEFT JOIN objects USING (device, inode) WHERE status = 'complete' QUALIFY members >= 2""")
def hash_group_members(spark, sf_dir):
    return hashing.hash_members(work_rows(spark, sf_dir))


@report(f"""WITH {sql.entries()}, k AS (SELECT inode, count(*) AS n, count(DISTINCT (ctime_ns, mtime_ns, size, allocated)) > 1 AS differ FROM files WHERE {KNOWN} GROUP BY 1)
    SELECT f.id, CASE WHEN NOT ({KNOWN}) THEN 'unknown' WHEN differ THEN 'conflicting' WHEN k.n > 1 THEN 'alias' ELSE 'known' END AS identity_status FROM files f LEFT JOIN k USING (inode)""")
def cache_identities(spark, sf_dir):
    e = adapters.entries(spark, sf_dir, ["id", "device", "inode", "size", "allocated", "ctime_ns", "mtime_ns", "generation"])
    return hashing.identity_status(e, reports.known_identity()).select("id", "identity_status")


TOPS = [(1, "/", False), (2, "/src1", True), (3, "/src1/b1", True), (4, "/src2/b0/c0", True), (5, "/src3", False), (6, "/src", True)]


@report(f"""WITH {sql.entries()}, {sql.values('tops', 'id, path, enabled', TOPS)},
    m AS (SELECT f.id, t.id AS root_id, row_number() OVER (PARTITION BY f.id ORDER BY strlen(t.path) DESC) AS nth FROM files f JOIN tops t ON enabled AND ('/' || f.path = t.path OR starts_with('/' || f.path, CASE t.path WHEN '/' THEN '/' ELSE t.path || '/' END)))
    SELECT f.id, cast(m.root_id AS BIGINT) AS root_id FROM files f LEFT JOIN m ON m.id = f.id AND nth = 1""")
def containing_roots(spark, sf_dir):
    tops = fixture(spark, "id, path, enabled", TOPS).select(F.col("id").cast("long").alias("id"), F.col("path").cast("binary").alias("path"), "enabled")
    e = adapters.entries(spark, sf_dir, ["id", "path"])
    return selection.root_of(e.select("id", F.concat(F.lit(b"/"), "path").alias("path")), tops)


@report(f"""WITH {sql.entries()}, old AS (SELECT * FROM files WHERE id % 9 <> 0)
    SELECT n.id, o.id IS NULL OR n.id % 6 = 1 OR n.id % 10 = 3 AS changed, n.inode = '' OR n.id % 14 = 5 AS "unknown" FROM files n LEFT JOIN old o ON o.id = n.id""")
def entry_changes(spark, sf_dir):
    """Every file against what was saved of it: some are new, some grew, some were skipped since, some have a malformed size."""
    e = adapters.entries(spark, sf_dir, ["id", *ledger.OBSERVED])
    size = F.when(F.col("id") % 6 == 1, F.col("size") + 1).otherwise(F.col("size"))
    reason = F.when(F.col("id") % 10 == 3, F.when(F.col("skip_reason") == "", "excluded or protected").otherwise("")).otherwise(F.col("skip_reason"))
    kind = F.when(F.col("id") % 14 == 5, "door").otherwise("file")
    observed = e.withColumns({"size": size, "skip_reason": reason, "kind": kind})
    return ledger.entry_changes(e.where("id % 9 <> 0").withColumn("kind", kind), observed, ["id"])


ASKED = [(1, 1, "src1/b1/c1/f1"), (2, 1, "src0/b0/c0/f0"), (3, 2, "none"), (4, 1, "src1/b1/c1"), (5, 3, "src2/b2/c2/f2")]


@report(f"""WITH {sql.entries()}, {sql.values('asked', 'ordinal, root_id, path', ASKED)}
    SELECT a.ordinal, cast(a.root_id AS BIGINT) AS root_id, a.path, f.id, CASE WHEN f.id IS NOT NULL THEN 'file' END AS kind, f.size, f.generation, own.complete AS own_complete, up.generation AS parent_generation, up.complete AS parent_complete
    FROM asked a LEFT JOIN files f ON f.root_id = a.root_id AND f.path = a.path LEFT JOIN dirs own ON own.root_id = a.root_id AND own.path = a.path LEFT JOIN dirs up ON up.root_id = a.root_id AND up.path = f.parent""")
def saved_rows_by_key(spark, sf_dir):
    asked = fixture(spark, "ordinal, root_id, path", ASKED).withColumn("root_id", F.col("root_id").cast("long"))
    e = adapters.entries(spark, sf_dir, ["id", "root_id", "path", "parent", "kind", "size", "generation"])
    return selection.lookup_rows(asked, e, adapters.directories(spark, sf_dir))


@report(f"""WITH {sql.entries()}, r AS (SELECT root_id, max(generation) * 10 + root_id AS revision FROM files GROUP BY 1)
    SELECT id, root_id, revision, device || ':' || inode || ':' || ctime_ns || ':' || generation AS binding FROM files JOIN r USING (root_id)""")
def selection_bindings(spark, sf_dir):
    e = adapters.entries(spark, sf_dir, ["id", "root_id", *selection.BINDING])
    revisions = e.groupBy("root_id").agg((F.max("generation") * 10 + F.col("root_id")).alias("revision"))
    return selection.bindings(e, revisions).withColumn("binding", F.concat_ws(":", *[F.col("binding")[c].cast("string") for c in selection.BINDING]))


@report(f"""WITH {sql.entries()} SELECT id, CASE WHEN id % 8 = 0 OR skip_reason <> '' OR id % 5 = 2 THEN 'blocked' ELSE 'metadata_matches' END AS status,
    CASE WHEN id % 8 = 0 THEN 'missing' WHEN skip_reason <> '' THEN 'skipped' WHEN id % 5 = 2 THEN 'changed' ELSE '' END AS reason FROM files""")
def metadata_screen(spark, sf_dir):
    columns = ("size", "mtime_ns", "ctime_ns")
    e = adapters.entries(spark, sf_dir, ["id", "skip_reason", *columns])
    now = e.where("id % 8 <> 0").withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.col("id") % 5 == 2, 1).otherwise(0))
    return selection.metadata_screen(e, now, columns)


@report(f"""WITH {sql.entries()} SELECT id, CASE WHEN id % 6 = 0 THEN 'absent' WHEN inode = '' THEN 'unknown' WHEN id % 4 = 1 THEN 'replaced' ELSE 'present' END AS state FROM files""")
def recovery_locations(spark, sf_dir):
    e = adapters.entries(spark, sf_dir, ["id", "device", "inode"])
    now = e.where("id % 6 <> 0").withColumn("inode", F.when((F.col("id") % 4 == 1) & (F.col("inode") != ""), F.concat(F.lit("9"), "inode")).otherwise(F.col("inode")))
    return selection.locations(e, now)


@report(f"""WITH {sql.entries()}, s AS (SELECT root_id, n, count(*) AS files, cast(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1, 2)
    SELECT root_id, n, CASE WHEN root_id % 2 = 0 AND n % 3 = 0 THEN files + 1 ELSE files END AS files, CASE WHEN root_id % 2 = 0 AND n % 3 = 0 THEN 0 ELSE bytes END AS bytes, CASE WHEN root_id % 2 = 0 AND n % 3 = 0 THEN 'cached_reduction' ELSE 'computed' END AS source FROM s""")
def cached_scopes(spark, sf_dir):
    """Saved figures, marked by other values, stand only where their root's revision is the saved one: that of even roots."""
    e = adapters.entries(spark, sf_dir, ["root_id", "n", "size"])
    now = e.groupBy("root_id", "n").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    saved = now.where("n % 3 = 0").select("root_id", "n", (F.col("files") + 1).alias("files"), F.lit(0).cast("long").alias("bytes"), F.lit(7).cast("long").alias("revision"))
    revisions = roots(spark, sf_dir).select(F.col("id").alias("root_id"), F.when(F.col("id") % 2 == 0, 7).otherwise(8).cast("long").alias("revision"))
    return selection.cached_or_computed(saved, revisions, now, ["root_id", "n"], ["files", "bytes"])


@report("""WITH r AS (SELECT DISTINCT source AS s, cast(substr(source, 4) AS BIGINT) AS root_id FROM documents)
    SELECT root_id, (SELECT count(*) FROM r WHERE root_id > 3) > 10 AS truncated FROM r WHERE root_id > 3 ORDER BY root_id LIMIT 10""")
def root_page(spark, sf_dir):
    found = adapters.table(spark, sf_dir, "documents").select(F.substring("source", 4, 10).cast("long").alias("root_id")).distinct()
    return reports.root_page(found, 3, 10)


@report("""WITH q AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS ready_order FROM orders) SELECT id, CASE WHEN id % 50 = 0 THEN ready_order + (SELECT count(*) FROM q) ELSE ready_order END AS ready_order FROM q""")
def queue_rotation(spark, sf_dir):
    queue = ranking.ranked(adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), [], ["id"], "ready_order")
    return reports.rotation(queue, queue.where("id % 50 = 0"))


@report("SELECT 'nations' AS relation, cast(n_nationkey AS VARCHAR) AS id FROM nation UNION ALL SELECT 'regions', cast(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 'suppliers', cast(s_suppkey AS VARCHAR) FROM supplier")
def existing_records(spark, sf_dir):
    of = lambda name, key: adapters.table(spark, sf_dir, name).select(F.col(key).alias("id"))
    return reports.existing(nations=of("nation", "n_nationkey"), regions=of("region", "r_regionkey"), suppliers=of("supplier", "s_suppkey"))


@report("""SELECT source AS store, CASE WHEN count(*) FILTER (text IS NULL OR doc_id % 997 = 5) = 0 THEN cast(sum(strlen(text)) AS BIGINT) END AS bytes,
    CASE WHEN count(*) FILTER (text IS NULL OR doc_id % 997 = 5) > 0 THEN 'unknown' WHEN sum(strlen(text)) >= 60000 THEN 'limit_reached' ELSE 'within_limit' END AS state FROM documents GROUP BY 1""")
def state_sizes(spark, sf_dir):
    docs = adapters.table(spark, sf_dir, "documents")
    size = F.when(F.col("doc_id") % 997 == 5, F.lit(-1)).otherwise(F.octet_length("text")).cast("long")
    return reports.state_size(docs.select(F.col("source").alias("store"), size.alias("bytes")), 60_000)


@report("""WITH s AS (SELECT s_nationkey AS context, 'k' || s_suppkey AS id, CASE WHEN s_nationkey % 5 = 4 THEN 'door' WHEN s_suppkey % 2 = 0 THEN 'regular' ELSE 'internal' END AS type,
                  CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 = 1 END AS in_use, s_suppkey % 7 AS usage_count FROM supplier),
    c AS (SELECT n_nationkey AS context, (SELECT count(*) FROM s WHERE s.context = n_nationkey) AS n FROM nation),
    v AS (SELECT context, CASE WHEN context % 6 = 5 THEN 'malformed' WHEN n > 128 THEN 'out_of_bounds' WHEN n > 0 AND context % 5 = 4 THEN 'malformed' WHEN n = 0 THEN 'empty' ELSE 'observed' END AS status FROM c)
    SELECT v.context, status, id, type, in_use, CASE WHEN id IS NOT NULL THEN TRUE END AS shared, cast(usage_count AS BIGINT) AS usage_count FROM v LEFT JOIN s ON s.context = v.context AND status = 'observed'""")
def engine_cache(spark, sf_dir):
    """A response for each nation with its suppliers as records; some lack the list, some hold a type that is none."""
    s = adapters.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    kind = F.when(F.col("s_nationkey") % 5 == 4, "door").when(key % 2 == 0, "regular").otherwise("internal")
    record = F.struct(F.concat(F.lit("k"), key).alias("ID"), kind.alias("Type"), F.when(key % 3 > 0, key % 3 == 1).alias("InUse"), F.lit(True).alias("Shared"), (key % 7).alias("UsageCount"))
    lists = s.groupBy(F.col("s_nationkey").alias("context")).agg(F.collect_list(record).alias("BuildCache"))  # a fixture's bodies
    bodies = adapters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("context")).join(lists, "context", "left")
    none = F.array().cast("array<struct<ID:string,Type:string,InUse:boolean,Shared:boolean,UsageCount:bigint>>")
    body = F.when(F.col("context") % 6 == 5, F.lit("{}")).otherwise(F.to_json(F.struct(F.coalesce("BuildCache", none).alias("BuildCache"))))
    return metadata.engine_cache(bodies.select("context", body.alias("body")))


@report(f"""WITH {sql.entries()}, targets AS (SELECT DISTINCT root_id, unnest([split_part(parent, '/', 1), split_part(parent, '/', 1) || '/' || split_part(parent, '/', 2), parent]) AS path FROM files)
    SELECT x.root_id, x.path AS upper, count(*) AS lower_paths FROM targets x JOIN targets y ON x.root_id = y.root_id AND starts_with(y.path, x.path || '/') GROUP BY 1, 2""")
def overlapping_directories(spark, sf_dir):
    """All directories above files as targets: how many others lie below each."""
    e = adapters.entries(spark, sf_dir, ["root_id", "parent"]).distinct()
    t = e.select("root_id", F.explode(F.concat(paths.ancestors(F.col("parent")), F.array(paths.as_text(F.col("parent"))))).alias("path")).where("path <> '.'").distinct()
    t = t.withColumn("id", F.struct("root_id", "path"))
    pairs = tree.overlapping_pairs(t.withColumn("path", F.col("path").cast("binary")))
    upper = F.when(F.startswith(F.col("b.path"), F.concat(F.col("a.path"), F.lit("/"))), F.col("a")).otherwise(F.col("b"))
    return pairs.select(upper.alias("u")).groupBy(F.col("u.root_id").alias("root_id"), F.col("u.path").alias("upper")).agg(F.count("*").alias("lower_paths"))


from cairn import ledger_reports, saved_reports, tree_reports  # noqa: E402, F401  (they register their reports)
