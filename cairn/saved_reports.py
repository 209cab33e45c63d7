"""Reports over selections, records and inputs that are saved, written or read again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import oracles as sql
from cairn.functions import cursors, scalars
from cairn.operators import hashing, history, reconcile, reports, rules, scanning, selection, sessions, tree
from cairn.plans import store
from cairn.plans.clustered import ClusteredTable
from cairn.registry import report
from cairn.sources import adapters, content, filesystem, metadata, projects, schema
from cairn.sources.written import shared_folder, written
from cairn.tree_reports import JOBS, NODE_SQL, PROJECTS, as_path, jobs

DAY, HOUR = sessions.DAY_US, sessions.HOUR_US


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- the store as a whole ----------------------------------------------------------------------------


@report(f"""WITH {PROJECTS}, {JOBS} SELECT (SELECT count(*) FROM r WHERE enabled) AS enabled_roots, (SELECT count(*) FROM pe) AS entries, (SELECT count(*) FROM pe WHERE skip_reason <> '') AS skipped_entries, (SELECT count(*) FROM jobs WHERE status = 'pending') AS pending_jobs,
    (SELECT count(*) FROM jobs WHERE status = 'running') AS running_jobs, (SELECT count(*) FROM pd WHERE complete AND last_error = '') AS complete_directories, (SELECT count(*) FROM pd WHERE last_error <> '') AS directory_errors""")
def store_summary(spark, sf_dir):
    work, roots = jobs(spark, sf_dir)
    return reports.store_summary(roots, projects.entries(spark, sf_dir), work, projects.passes(spark, sf_dir))


@report(f"""WITH {PROJECTS} SELECT kind, count(*) AS n, cast(sum(size) AS BIGINT) AS bytes FROM pe GROUP BY 1""")
def saved_inventory(spark, sf_dir):
    """The inventory written as a declared relation and read again through its reader."""
    folder = new_folder(spark, "inventory")
    schema.write_relation(projects.entries(spark, sf_dir), folder, "entries")
    found = schema.read_relation(spark, folder, "entries")
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


_CHECKS = ("exists", "written_whole", "readable", "schema", "has_rows", "keys_set", "keys_unique")


@report(f"""WITH {PROJECTS}, c AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(_CHECKS))}) AS t(nth, "check")), rl AS (SELECT 'entries' AS relation, CASE WHEN (SELECT count(DISTINCT (root_id, path)) = count(*) FROM pe) THEN 99 ELSE 6 END AS broken
      UNION ALL SELECT 'directories', CASE WHEN (SELECT count(*) FROM pd) = (SELECT count(DISTINCT root_id) FROM pd) THEN 99 ELSE 6 END UNION ALL SELECT 'roots', 3 UNION ALL SELECT 'jobs', 0 UNION ALL SELECT 'revisions', 4)
    SELECT relation, c."check", CASE WHEN nth < broken THEN 'ok' WHEN nth = broken THEN 'failed' ELSE 'not_checked' END AS status FROM rl, c""")
def dataset_health(spark, sf_dir):
    """Checks of a store: one relation is sound, one has a key that is not unique, others lack columns, rows or everything."""
    folder = new_folder(spark, "store")
    schema.write_relation(projects.entries(spark, sf_dir), folder, "entries")
    schema.write_relation(projects.passes(spark, sf_dir), folder, "directories")
    adapters.roots(spark, sf_dir).write.parquet(f"{folder}/roots.parquet")
    spark.createDataFrame([], schema.relation("revisions")).write.parquet(f"{folder}/revisions.parquet")
    return schema.dataset_checks(spark, folder, {"entries": ["root_id", "path"], "directories": ["root_id"], "roots": ["id"], "jobs": ["id"], "revisions": ["root_id"]})


# --- selections --------------------------------------------------------------------------------------


@report(f"WITH {NODE_SQL} SELECT id, path FROM nm WHERE outcome = 'selected' AND id > 500 ORDER BY id LIMIT 12")
def selected_findings(spark, sf_dir):
    """Findings asked for by id, all of which must still be selected."""
    found = written(rules.node_modules(projects.entries(spark, sf_dir), projects.passes(spark, sf_dir), projects.AS_OF), "findings")
    shown = [r.id for r in found.where("outcome = 'selected' and id > 500").orderBy("id").limit(12).collect()]  # a page that a person saw
    return as_path(history.exact_selection(found, shown)).select("id", "path")


@report(f"""WITH {NODE_SQL}, w AS (SELECT id, outcome, coalesce(sum(CASE WHEN outcome = 'selected' THEN 1 ELSE 0 END) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM nm WHERE id > 320 ORDER BY id LIMIT 1000)),
    p AS (SELECT * FROM w WHERE before < 20) SELECT id, 'nm2:30:' || (SELECT max(id) FROM p) AS next_cursor FROM p WHERE outcome = 'selected'""")
def finding_cursors(spark, sf_dir):
    """A page of findings at an age of 30 days, after a cursor of that age, with the cursor of the next."""
    after = cursors.decode_finding("nm2:30:320", 30)
    found = rules.node_modules(projects.entries(spark, sf_dir), projects.passes(spark, sf_dir), projects.AS_OF - 60 * projects.DAY_NS, 30)
    page = written(rules.candidate_page(found, after), "page")
    return page.where("outcome = 'selected'").select("id", F.lit(cursors.encode_finding(page.agg(F.max("id")).first()[0], 30)).alias("next_cursor"))


_SHOWN = "kind = 'file' AND skip_reason = '' AND path LIKE '%/src/text' AND id % 7 = 3"


@report(f"""WITH {PROJECTS}, {f'''up AS (SELECT e.root_id, e.id, unnest([split_part(e.parent, '/', 1), split_part(e.parent, '/', 1) || '/' || split_part(e.parent, '/', 2), e.parent]) AS path FROM pe e WHERE {_SHOWN}),
    ok AS (SELECT u.id FROM up u LEFT JOIN pd p ON p.root_id = u.root_id AND p.path = u.path GROUP BY u.id HAVING bool_and(coalesce(p.complete AND p.last_error = '', FALSE)))'''}
    SELECT e.id, e.root_id, e.path, e.size, e.inode FROM pe e JOIN ok USING (id) ORDER BY e.id LIMIT 20""")
def file_selection(spark, sf_dir):
    """Twenty files as they were shown, frozen with what binds them."""
    e, d = written(projects.entries(spark, sf_dir).drop("link"), "project-entries"), projects.passes(spark, sf_dir)
    rows = e.where("kind = 'file' and skip_reason = '' and endswith(cast(path as string), '/src/text') and id % 7 = 3")
    chains = selection.ancestor_chains(rows.select("id", "root_id", "path"), d).where("chain_valid")
    shown = rows.join(chains.select("id"), "id").orderBy("id").limit(selection.MAX_SELECTED).select("id", "size", "mtime_ns")
    found = selection.select_files(e, d, written(shown, "shown"))
    return as_path(found).select("id", "root_id", "path", "size", F.col("binding.inode").alias("inode"))


LINES = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)"


def lines(spark, sf_dir) -> DataFrame:
    """Lines of orders, each number of an order once."""
    return adapters.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


_COPIES = f"{LINES}, cw AS (SELECT l_orderkey * 8 + l_linenumber AS file_id, l_partkey AS part FROM li), cp AS (SELECT part FROM cw GROUP BY 1 HAVING count(*) >= 5 ORDER BY count(*) DESC, part LIMIT 1)"


@report(f"WITH {_COPIES}, cn AS (SELECT file_id, part, row_number() OVER (ORDER BY file_id) AS nth FROM cw JOIN cp USING (part)) SELECT file_id, CASE WHEN nth = 1 THEN 'keeper' ELSE 'copy' END AS role, part * 100 AS size, sha256(cast(part AS VARCHAR)) AS sha256 FROM cn WHERE nth <= 20")
def keeper_choice(spark, sf_dir):
    """Order lines as files whose content is their part: the first of the most frequent part is kept, up to nineteen others are its copies."""
    li = lines(spark, sf_dir)
    id_ = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    work = written(li.select(id_.alias("file_id"), (F.col("l_partkey") * 100).alias("size"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"), F.lit("complete").alias("status"), F.lit("1").alias("device"), id_.cast("string").alias("inode"),
                             F.lit(1).cast("long").alias("ctime_ns"), F.lit(1).cast("long").alias("mtime_ns"), F.lit(4096).cast("long").alias("allocated")), "work")
    most = work.groupBy("size").agg(F.count("*").alias("n")).where("n >= 5").orderBy(F.desc("n"), "size").first()
    chosen = [r.file_id for r in work.where(F.col("size") == most["size"]).orderBy("file_id").limit(hashing.MAX_SELECTION).collect()]
    return hashing.keeper_preview(work, chosen[0], chosen[1:])


_HASHED = f"""{LINES}, hw AS (SELECT l_orderkey AS selection_id, l_linenumber AS work_id, ['pending', 'running', 'complete', 'complete', 'blocked'][l_partkey % 5 + 1] AS s, l_partkey AS k FROM li),
    hr AS (SELECT *, CASE WHEN k % 83 = 9 THEN 'odd' ELSE s END AS status, 1000 AS size, CASE WHEN k % 89 = 7 THEN 1001 WHEN s = 'complete' AND k % 97 <> 5 THEN 1000 WHEN s = 'complete' THEN 64 ELSE k % 15 * 64 END AS durable_offset,
             CASE WHEN s = 'complete' OR k % 101 = 3 THEN sha256(cast(k AS VARCHAR)) END AS sha256, CASE WHEN s IN ('running', 'complete') THEN CASE WHEN k % 103 = 2 THEN '2024-03-01' ELSE '2024-01-05' END END AS a_day, CASE WHEN s = 'running' AND k % 7 <> 1 THEN 'reserved' WHEN s IN ('running', 'complete') THEN 'settled' END AS a_status FROM hw),
    hb AS (SELECT o_orderkey AS selection_id, '2024-02-01' AS b_day, 100000 AS total FROM orders WHERE o_orderkey % 50 <> 3)"""


@report(f"""WITH {_HASHED}, j AS (SELECT h.*, b.total, CASE WHEN status NOT IN ('pending', 'running', 'complete', 'blocked') THEN 'status_unknown' WHEN durable_offset > size THEN 'offset_outside_file' WHEN status = 'complete' AND (durable_offset <> size OR sha256 IS NULL) THEN 'completed_without_digest'
        WHEN status <> 'complete' AND sha256 IS NOT NULL THEN 'digest_before_completion' WHEN status = 'running' AND coalesce(a_status <> 'reserved', TRUE) THEN 'running_without_reservation' WHEN a_day IS NOT NULL AND total IS NULL THEN 'attempt_without_budget' WHEN a_day > b_day THEN 'attempt_beyond_budget' END AS why FROM hr h LEFT JOIN hb b USING (selection_id)),
    g AS (SELECT selection_id, count(*) AS files, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'blocked') AS blocked, cast(sum(durable_offset) AS BIGINT) AS durable_bytes, coalesce(max(total), 0) AS reserved_bytes,
            arg_min(why, work_id) FILTER (why IS NOT NULL) AS why FROM j GROUP BY 1),
    s AS (SELECT l_orderkey AS selection_id, CASE WHEN l_orderkey % 60 = 4 THEN count(*) + 1 ELSE count(*) END AS targets FROM li GROUP BY 1), v AS (SELECT g.*, CASE WHEN files <> targets THEN 'files_do_not_match' ELSE why END AS reason FROM s JOIN g USING (selection_id))
    SELECT selection_id, CASE WHEN reason IS NULL THEN 'saved_hash_observations' ELSE 'corrupt' END AS source, reason, {', '.join(f'CASE WHEN reason IS NULL THEN {c} END AS {c}' for c in ('files', 'pending', 'running', 'complete', 'blocked', 'durable_bytes', 'reserved_bytes'))} FROM v""")
def hash_snapshots(spark, sf_dir):
    """Orders as selections of files to hash: work, attempts and budgets that agree, or the first reason why they do not."""
    k = F.col("k")
    s = F.element_at(F.array(*[F.lit(x) for x in ("pending", "running", "complete", "complete", "blocked")]), (k % 5 + 1).cast("int"))
    li = lines(spark, sf_dir).select(F.col("l_orderkey").alias("selection_id"), F.col("l_linenumber").cast("long").alias("work_id"), F.col("l_partkey").alias("k")).withColumn("s", s)
    done, began = F.col("s") == "complete", F.col("s").isin("running", "complete")
    work = li.select("selection_id", "work_id", F.when(k % 83 == 9, "odd").otherwise(F.col("s")).alias("status"), F.lit(1000).cast("long").alias("size"),
                     F.when(k % 89 == 7, 1001).when(done & (k % 97 != 5), 1000).when(done, 64).otherwise(k % 15 * 64).cast("long").alias("durable_offset"), F.when(done | (k % 101 == 3), F.sha2(k.cast("string"), 256)).alias("sha256"))
    attempts = li.where(began).select("selection_id", "work_id", F.when(k % 103 == 2, "2024-03-01").otherwise("2024-01-05").alias("day"), F.lit(64).cast("long").alias("reserved"), F.when((F.col("s") == "running") & (k % 7 != 1), "reserved").otherwise("settled").alias("status"))
    o = adapters.table(spark, sf_dir, "orders")
    budgets = o.where("o_orderkey % 50 <> 3").select(F.col("o_orderkey").alias("selection_id"), F.lit("2024-02-01").alias("day"), F.lit(100_000).cast("long").alias("total_reserved"))
    targets = li.groupBy("selection_id").agg(F.count("*").alias("n")).select("selection_id", (F.col("n") + F.when(F.col("selection_id") % 60 == 4, 1).otherwise(0)).alias("targets"))
    return hashing.hash_snapshot(targets, work, attempts, budgets)


_KEPT = "ks AS (SELECT o_custkey AS store, o_orderkey AS ordinal, o_orderpriority AS payload FROM orders)"


@report(f"WITH {_KEPT}, f AS (SELECT store, arg_min(payload, ordinal) AS first, min(ordinal) AS at_first FROM ks GROUP BY 1) SELECT k.store, k.ordinal, sha256(first) AS selection_id, CASE WHEN k.ordinal = at_first THEN 'created' WHEN payload = first THEN 'existing' ELSE 'conflict' END AS state FROM ks k JOIN f USING (store)")
def kept_selections(spark, sf_dir):
    """Orders as requests of customers to keep a selection."""
    o = adapters.table(spark, sf_dir, "orders")
    return sessions.kept_selections(o.select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("payload")))


# --- records, exports and comparisons ----------------------------------------------------------------

_DISMISSED = "dr AS (SELECT user_id % 9 AS store, event_id AS ordinal, CASE WHEN event_id % 6 = 5 THEN 'undo' ELSE 'save' END AS action, 'r' || event_id * 7919 % 41 AS request_id FROM events)"


@report(f"""WITH RECURSIVE {_DISMISSED}, dn AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY ordinal) AS nth FROM dr),
    df(store, nth, ordinal, state, known, undone) AS (SELECT DISTINCT store, cast(0 AS BIGINT), cast(NULL AS BIGINT), cast(NULL AS VARCHAR), cast([] AS VARCHAR[]), cast([] AS VARCHAR[]) FROM dr
      UNION ALL SELECT d.store, n.nth, n.ordinal, CASE WHEN action = 'undo' THEN CASE WHEN list_contains(known, request_id) THEN 'undone' ELSE 'not_found' END WHEN list_contains(undone, request_id) THEN 'undone' WHEN list_contains(known, request_id) OR len(known) < 30 THEN 'dismissed' ELSE 'capacity_reached' END,
        CASE WHEN action = 'save' AND NOT list_contains(known, request_id) AND len(known) < 30 THEN list_append(known, request_id) ELSE known END, CASE WHEN action = 'undo' AND list_contains(known, request_id) THEN list_append(undone, request_id) ELSE undone END
      FROM df d JOIN dn n ON n.store = d.store AND n.nth = d.nth + 1) SELECT store, ordinal, state, len(known) AS records FROM df WHERE nth > 0""")
def dismissal_states(spark, sf_dir):
    """Events as requests to dismiss findings and to undo that, in stores of thirty records."""
    id_ = F.col("event_id")
    requests = adapters.table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("store"), id_.alias("ordinal"), F.when(id_ % 6 == 5, "undo").otherwise("save").alias("action"), F.concat(F.lit("r"), (id_ * 7919 % 41).cast("string")).alias("request_id"))
    return sessions.dismissal_history(requests, "store", 30)


@report("""SELECT 'plan_' || sha256('{"nation":' || n_nationkey || ',"name":"' || n_name || '"}') AS id, n_nationkey AS nation FROM nation""")
def saved_plans(spark, sf_dir):
    """Nations as plans appended to a store of records, twice, and read again by their ids."""
    nations = adapters.table(spark, sf_dir, "nation")
    payloads = nations.select(F.to_json(F.struct(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))).alias("payload"))
    plans = store.RecordStore(spark, new_folder(spark, "plans"), "plan_")
    plans.append(payloads.where("payload like '%A%'"))
    plans.append(payloads)
    return plans.read().select("id", F.get_json_object("payload", "$.nation").cast("long").alias("nation"))


@report("SELECT o_orderstatus AS part, count(*) AS rows, TRUE AS intact, FALSE AS intact_after_edit FROM orders GROUP BY 1")
def verified_exports(spark, sf_dir):
    """Orders exported by status: each copy matches its manifest, and none once a row of it is changed."""
    o = adapters.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = []
    for (status,) in o.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect():  # three
        folder, own = new_folder(spark, "export"), o.where(F.col("o_orderstatus") == status)
        store.export(own, folder)
        intact = store.verify_export(spark, folder, own)
        rows = spark.read.parquet(f"{folder}/rows")
        low = rows.agg(F.min("o_orderkey")).first()[0]
        edited = new_folder(spark, "edited")
        rows.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") == low, 1).otherwise(0)).write.parquet(f"{edited}/rows")
        spark.read.parquet(f"{folder}/manifest").write.parquet(f"{edited}/manifest")
        out.append((status, rows.count(), intact, store.verify_export(spark, edited)))
    return spark.createDataFrame(out, "part string, rows long, intact boolean, intact_after_edit boolean")


@report(f"""WITH {PROJECTS}, a AS (SELECT root_id, kind, size FROM pe), b AS (SELECT root_id, kind, CASE WHEN id % 9 = 2 THEN size + 1 ELSE size END AS size FROM pe WHERE id % 11 <> 3), u AS (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b)
    SELECT root_id, kind, size, cast(sum(n) AS BIGINT) AS more FROM u GROUP BY 1, 2, 3 HAVING sum(n) <> 0""")
def multiset_differences(spark, sf_dir):
    """Kinds and sizes of an inventory and of a later one, repeats counted."""
    e = projects.entries(spark, sf_dir)
    later = e.where("id % 11 <> 3").withColumn("size", F.col("size") + F.when(F.col("id") % 9 == 2, 1).otherwise(0))
    return reconcile.differences(e.select("root_id", "kind", "size"), later.select("root_id", "kind", "size"))


@report(f"""WITH {PROJECTS}, n AS (SELECT root_id, path, kind, CASE WHEN id % 5 = 1 THEN size + 9 ELSE size END AS size, observed_at_ns + CASE WHEN id % 10 = 1 THEN -1 ELSE 1 END AS observed_at_ns FROM pe WHERE id % 4 = 1 UNION ALL SELECT root_id, path || '.new', kind, 1, observed_at_ns FROM pe WHERE id % 20 = 7),
    u AS (SELECT root_id, path, kind, size, observed_at_ns FROM pe UNION ALL SELECT * FROM n) SELECT root_id, path, arg_max(kind, observed_at_ns) AS kind, arg_max(size, observed_at_ns) AS size, max(observed_at_ns) AS observed_at_ns FROM u GROUP BY 1, 2""")
def upserted_entries(spark, sf_dir):
    """Saved rows and a scan's batch: the later observation of a path stands, also where the batch is behind."""
    columns = ["root_id", "path", "kind", "size", "observed_at_ns"]
    e = as_path(projects.entries(spark, sf_dir))
    seen = e.where("id % 4 = 1").withColumns({"size": F.col("size") + F.when(F.col("id") % 5 == 1, 9).otherwise(0), "observed_at_ns": F.col("observed_at_ns") + F.when(F.col("id") % 10 == 1, -1).otherwise(1)})
    new = e.where("id % 20 = 7").withColumns({"path": F.concat("path", F.lit(".new")), "size": F.lit(1).cast("long")})
    return reconcile.upsert(e.select(*columns), seen.select(*columns).union(new.select(*columns)), ["root_id", "path"], ["observed_at_ns"])


@report("""WITH d AS (SELECT source AS tree, lpad(cast(doc_id AS VARCHAR), 12, '0') AS path, coalesce(lang, '') AS f, doc_id FROM documents), g AS (SELECT tree, sha256(string_agg(strlen(path) || ':' || path || strlen(f) || ':' || f, '' ORDER BY path)) AS digest, count(*) AS records,
        bool_or(doc_id % 97 = 5 OR doc_id % 89 = 3) AS touched FROM d GROUP BY 1) SELECT tree, CASE WHEN touched THEN 'tree_changed_during_check' ELSE 'metadata_observed' END AS status, CASE WHEN NOT touched THEN digest END AS digest, CASE WHEN NOT touched THEN records END AS records FROM g""")
def stable_trees(spark, sf_dir):
    """Two passes over every source's documents; some changed or were gone at the second."""
    docs = adapters.table(spark, sf_dir, "documents").select(F.col("source").alias("tree"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.coalesce("lang", F.lit("")).alias("fields"), "doc_id")
    second = docs.where("doc_id % 97 <> 5").withColumn("fields", F.when(F.col("doc_id") % 89 == 3, F.concat("fields", F.lit("!"))).otherwise(F.col("fields")))
    return tree.stable_trees(docs.drop("doc_id"), second.drop("doc_id"))


# --- paced requests and late rows ----------------------------------------------------------------------

_PACED = f"""pq AS (SELECT user_id % 12 AS scope, event_id AS ordinal, epoch_us(ts) - CASE WHEN event_id % 41 = 8 THEN {DAY * 2} ELSE 0 END AS at_us FROM events)"""


@report(f"""WITH RECURSIVE {_PACED}, pn AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ordinal) AS nth FROM pq),
    pf(scope, nth, ordinal, outcome, used, day, spent, last_us, then_us) AS (SELECT DISTINCT scope, cast(0 AS BIGINT), cast(NULL AS BIGINT), cast(NULL AS VARCHAR), cast(0 AS BIGINT), cast(-1 AS BIGINT), cast(0 AS BIGINT), cast(-4611686018427387904 AS BIGINT), cast(-4611686018427387904 AS BIGINT) FROM pq
      UNION ALL SELECT scope, nth, ordinal, CASE WHEN why = '' THEN 'dispatched' ELSE why END, CASE WHEN why = '' THEN u + 1 ELSE u END, CASE WHEN why = '' THEN d ELSE day END, CASE WHEN why = '' THEN u + 1 ELSE spent END, CASE WHEN why = '' THEN at_us ELSE last_us END, CASE WHEN why = '' THEN at_us + {HOUR} ELSE then_us END
      FROM (SELECT *, CASE WHEN at_us < last_us THEN 'clock_rollback' WHEN u >= 6 THEN 'daily_chunk_limit' WHEN at_us < then_us THEN 'cadence' ELSE '' END AS why FROM
        (SELECT f.scope, n.nth, n.ordinal, n.at_us, f.day, f.spent, f.last_us, f.then_us, greatest(f.day, n.at_us // {DAY}) AS d, CASE WHEN f.day >= n.at_us // {DAY} THEN f.spent ELSE 0 END AS u FROM pf f JOIN pn n ON n.scope = f.scope AND n.nth = f.nth + 1)))
    SELECT scope, ordinal, outcome, used FROM pf WHERE nth > 0""")
def paced_dispatches(spark, sf_dir):
    """Events as requests for a chunk of work: one an hour, six a day."""
    id_ = F.col("event_id")
    requests = adapters.observations(spark, sf_dir).select((F.col("user_id") % 12).alias("scope"), id_.alias("ordinal"), (F.unix_micros("ts") - F.when(id_ % 41 == 8, 2 * DAY).otherwise(0)).cast("long").alias("at_us"))
    return sessions.dispatches(requests, "scope", HOUR, 6)


@report(f"""WITH lo AS (SELECT user_id, event_id AS ordinal, epoch_us(ts) - CASE WHEN event_id % 13 = 6 THEN {HOUR * 20} WHEN event_id % 13 = 7 THEN {HOUR * 60} ELSE 0 END AS at_us FROM events)
    SELECT user_id, ordinal, at_us, CASE WHEN coalesce(at_us < max(at_us) OVER (PARTITION BY user_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DAY}, FALSE) THEN 'clock_rollback' ELSE 'accepted' END AS state FROM lo""")
def late_observations(spark, sf_dir):
    """Events that came more than a day behind the latest of their user: told, not dropped."""
    id_ = F.col("event_id")
    at = F.unix_micros("ts") - F.when(id_ % 13 == 6, 20 * HOUR).when(id_ % 13 == 7, 60 * HOUR).otherwise(0)
    return sessions.late_observations(adapters.observations(spark, sf_dir).select("user_id", id_.alias("ordinal"), at.cast("long").alias("at_us")), "user_id", DAY)


# --- inputs and sizes for people -----------------------------------------------------------------------


@report("SELECT p_partkey AS id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KiB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.1f MiB', s / 1048576.0) ELSE printf('%.1f GiB', s / 1073741824.0) END AS size FROM (SELECT p_partkey, p_partkey * p_partkey * (p_partkey % 40) AS s FROM part)")
def sizes_for_people(spark, sf_dir):
    size = F.col("p_partkey") * F.col("p_partkey") * (F.col("p_partkey") % 40)
    return adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalars.human_size(size, "GiB").alias("size"))


@report(f"WITH {sql.entries()} SELECT id, size FROM files WHERE size >= 64 ORDER BY size DESC, id DESC LIMIT 20")
def report_files(spark, sf_dir):
    """A report of the largest files, written as one JSON document and read back as a selection."""
    page = adapters.entries(spark, sf_dir, ["id", "size"]).where("size >= 64").orderBy(F.desc("size"), F.desc("id")).limit(20)
    files = F.array_sort(F.collect_list(F.struct("id", "size")))
    body = page.agg(F.lit(1).alias("version"), F.lit("report").alias("command"), files.alias("files"))
    folder = new_folder(spark, "report")
    body.select(F.to_json(F.struct("version", "command", "files")).alias("value")).coalesce(1).write.text(folder)
    return schema.read_report(spark, folder, body.schema)


@report("""WITH d AS (SELECT doc_id, 's' || doc_id % 5 AS a, 't' || doc_id % 7 AS b, strlen(coalesce(text, '')) AS size FROM documents), x AS (SELECT * FROM d WHERE a <> 's3')
    SELECT a || '/' || b || '/f' || doc_id AS path, 'file' AS kind, size, '' AS skip_reason, TRUE AS listed FROM x UNION ALL SELECT DISTINCT a || '/' || b, 'directory', NULL, '', TRUE FROM x UNION ALL SELECT DISTINCT a, 'directory', NULL, CASE WHEN a = 's3' THEN 'excluded or protected' ELSE '' END, a <> 's3' FROM d""")
def scanned_files(spark, sf_dir):
    """The documents' texts as files in folders, scanned; one folder is excluded, so it is told and not entered."""
    docs = adapters.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string"), F.lit("/t"), (F.col("doc_id") % 7).cast("string")).alias("folder"))
    top = "/" + new_folder(spark, "tree").removeprefix("file:").lstrip("/")
    content.write_files(docs, top).write.format("noop").mode("overwrite").save()
    os.makedirs(top, exist_ok=True)
    entries, passes = filesystem.scan_tree(spark, top, new_folder(spark, "scan"), 4, exclude=(b"s3",), step=64)
    listed = passes.where("complete").select("path", F.lit(True).alias("_own"))
    own = entries.join(listed, "path", "left")
    is_file = F.col("kind") == "file"
    return own.select(F.col("path").cast("string").alias("path"), "kind", F.when(is_file, F.col("size")).alias("size"), "skip_reason", (is_file | F.coalesce("_own", F.lit(False))).alias("listed"))


# --- batches of listings, and copies hashed again --------------------------------------------------------

_LISTED = """ls AS (SELECT root_id, path, 6 AS generation, id // 64 % 9 <> 2 AS complete, CASE WHEN id // 64 % 21 = 6 THEN 'listing failed' ELSE '' END AS fault, 1700000000000000007 AS at_ns FROM pe WHERE id > 0 AND id % 64 = 0 AND id // 64 % 3 = 0),
    lc AS (SELECT e.root_id, e.parent, e.path, CASE WHEN e.id % 64 = 8 OR e.path LIKE '%/bin' THEN 'file' ELSE e.kind END AS kind, e.size + 1 AS size, e.skip_reason FROM pe e JOIN ls l ON l.root_id = e.root_id AND l.path = e.parent WHERE e.id % 5 <> 2
           UNION ALL SELECT root_id, path, path || '/new', 'directory', 0, '' FROM ls),
    good AS (SELECT * FROM ls WHERE fault = ''), told AS (SELECT c.*, g.generation FROM lc c JOIN good g ON g.root_id = c.root_id AND g.path = c.parent),
    e2 AS (SELECT coalesce(t.root_id, e.root_id) AS root_id, coalesce(t.path, e.path) AS path, coalesce(t.parent, e.parent) AS parent, coalesce(t.kind, e.kind) AS kind, coalesce(t.generation, e.generation) AS generation FROM pe e FULL JOIN told t ON t.root_id = e.root_id AND t.path = e.path),
    d2 AS (SELECT coalesce(l.root_id, d.root_id) AS root_id, coalesce(l.path, d.path) AS path, CASE WHEN l.path IS NULL OR l.fault <> '' THEN coalesce(d.generation, 0) ELSE l.generation END AS generation, CASE WHEN l.path IS NULL OR l.fault <> '' THEN coalesce(d.complete, FALSE) ELSE l.complete END AS complete, coalesce(l.fault, d.last_error) AS last_error
           FROM pd d FULL JOIN ls l ON l.root_id = d.root_id AND l.path = d.path),
    j1 AS (SELECT root_id, path FROM pe WHERE kind = 'directory' AND id % 7 = 1), j2 AS (SELECT * FROM j1 UNION ALL SELECT DISTINCT root_id, path FROM told WHERE kind = 'directory' AND skip_reason = '' AND (root_id, path) NOT IN (SELECT (root_id, path) FROM j1))"""


def listed(spark, sf_dir) -> dict[str, DataFrame]:
    """Every third project's folder listed anew: some children are gone, some directories became files, some listings failed or ended early."""
    e, d = written(projects.entries(spark, sf_dir).drop("link"), "project-entries"), written(projects.passes(spark, sf_dir), "project-passes")
    doc = F.expr("id div 64")
    tops = e.where((F.col("id") > 0) & (F.col("id") % 64 == 0) & (doc % 3 == 0))
    listings = tops.select("root_id", "path", F.lit(6).cast("long").alias("generation"), (doc % 9 != 2).alias("complete"), F.when(doc % 21 == 6, "listing failed").otherwise("").alias("fault"), F.lit(1_700_000_000_000_000_007).alias("at_ns"))
    flat = (F.col("id") % 64 == 8) | F.endswith(F.col("path").cast("string"), F.lit("/bin"))
    found = e.where("id % 5 <> 2").join(listings.select("root_id", F.col("path").alias("parent")), ["root_id", "parent"]).withColumns({"kind": F.when(flat, "file").otherwise(F.col("kind")), "size": F.col("size") + 1})
    new = tops.withColumns({"parent": F.col("path"), "path": F.concat("path", F.lit(b"/new")), "size": F.lit(0).cast("long"), "skip_reason": F.lit("")})
    children = found.unionByName(new).drop("generation", "observed_at_ns")
    jobs = e.where("kind = 'directory' and id % 7 = 1").select("root_id", F.lit("scan").alias("kind"), "path")
    revisions = e.select("root_id").distinct().withColumn("revision", F.col("root_id") * 10)
    return scanning.commit_listings(listings, children, e, d, jobs, revisions) | {"before": e}


@report(f"""WITH {PROJECTS}, {_LISTED} SELECT 'entries' AS relation, root_id, path, generation, kind AS state FROM e2 UNION ALL SELECT 'directories', root_id, path, generation, CASE WHEN last_error <> '' THEN last_error WHEN complete THEN 'complete' ELSE 'partial' END FROM d2
    UNION ALL SELECT 'jobs', root_id, path, 0, 'scan' FROM j2 UNION ALL SELECT 'revisions', root_id, '', root_id * 10 + CASE WHEN root_id IN (SELECT root_id FROM good) THEN 1 ELSE 0 END, '' FROM (SELECT DISTINCT root_id FROM pe) UNION ALL SELECT 'reconcile', root_id, path, generation, '' FROM good WHERE complete""")
def committed_listings(spark, sf_dir):
    """Rows, passes, work, revisions and reconciliations after a batch of listings."""
    after = listed(spark, sf_dir)
    rows = lambda name, path, generation, state: after[name].select(F.lit(name).alias("relation"), F.col("root_id").cast("long").alias("root_id"), path.cast("string").alias("path"), generation.cast("long").alias("generation"), state.alias("state"))
    none, zero, path, own = F.lit(""), F.lit(0), F.col("path"), F.col("generation")
    passes = F.when(F.col("last_error") != "", F.col("last_error")).when(F.col("complete"), "complete").otherwise("partial")
    return rows("entries", path, own, F.col("kind")).union(rows("directories", path, own, passes)).union(rows("jobs", path, zero, F.col("kind"))).union(rows("revisions", none, F.col("revision"), none)).union(rows("reconcile", path, own, none))


@report(f"""WITH {PROJECTS}, {_LISTED}, due AS (SELECT g.root_id, g.path, g.generation FROM good g JOIN d2 d ON d.root_id = g.root_id AND d.path = g.path AND d.generation = g.generation AND d.complete AND d.last_error = '' WHERE g.complete),
    ck AS (SELECT e.root_id, e.path, e.kind, e.generation <> u.generation AS absent FROM e2 e JOIN due u ON u.root_id = e.root_id AND u.path = e.parent)
    SELECT root_id, path, NOT absent AS preserve_entry FROM ck c WHERE absent OR (kind <> 'directory' AND (EXISTS (SELECT 1 FROM d2 d WHERE d.root_id = c.root_id AND d.path = c.path) OR EXISTS (SELECT 1 FROM e2 x WHERE x.root_id = c.root_id AND starts_with(x.path, c.path || '/'))))""")
def retired_subtrees(spark, sf_dir):
    """What is to be retired after those listings: children that are gone, and what directories left that are none any more."""
    after = listed(spark, sf_dir)
    return as_path(scanning.retirements(after["entries"], after["directories"], after["reconcile"])).select(F.col("root_id").cast("long").alias("root_id"), "path", "preserve_entry")


@report("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keeper, count(*) OVER (PARTITION BY coalesce(text, '')) AS n FROM documents),
    f AS (SELECT *, doc_id % 11 = 5 AS gone, CASE WHEN doc_id % 7 = 3 THEN text || '!' ELSE text END AS now FROM d WHERE n > 1), k AS (SELECT keeper, gone AS k_gone, now AS k_now FROM f WHERE doc_id = keeper)
    SELECT keeper AS job_id, count(*) AS copies, ['historical_hashes_match', 'historical_hashes_differ', 'incomplete', 'blocked'][max(CASE WHEN gone OR k_gone THEN 3 WHEN now <> k_now THEN 1 ELSE 0 END) + 1] AS relation FROM f JOIN k USING (keeper) WHERE doc_id <> keeper GROUP BY 1""")
def fresh_copies(spark, sf_dir):
    """Equal documents as a keeper and its copies, hashed again from their files: some changed since, some went after they were asked for."""
    docs = adapters.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    groups = docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("id").alias("job_id"), F.count("*").alias("n")).where("n > 1")
    jobs = written(docs.withColumn("sha", F.sha2("text", 256)).join(groups, "sha").select("job_id", "id", F.concat("text", F.when(F.col("id") % 7 == 3, "!").otherwise("")).alias("content")), "jobs")
    folder = "/" + new_folder(spark, "copies").removeprefix("file:").lstrip("/")
    files = written(content.write_files(jobs.select("id", "content"), folder), "copies-saved")
    gone = F.concat("path", F.when(F.col("id") % 11 == 5, F.lit(b".gone")).otherwise(F.lit(b"")))
    hashed = content.hash_files(files.withColumn("path", gone))
    rows = jobs.drop("content").join(hashed, "id").select("job_id", F.when(F.col("id") == F.col("job_id"), "keeper").otherwise("copy").alias("role"), "status", "sha256")
    return hashing.fresh_comparison(rows)


@report("SELECT event_id, CASE WHEN event_id % 70 <= 64 AND event_id * 977 % 6000000000 <= 5000000000 THEN event_id % 70 = 0 OR cast(ceil(event_id % 70 * 1000000000 / 5000.0) AS BIGINT) <= event_id * 977 % 6000000000 // 4 END AS fits FROM events")
def pacing_capacity(spark, sf_dir):
    """Whether the least read of each event fits the time it has left."""
    id_ = F.col("event_id")
    return adapters.table(spark, sf_dir, "events").select("event_id", scalars.pacing_fits(id_ % 70, 5000, id_ * 977 % 6_000_000_000).alias("fits"))


@report(f"""WITH {PROJECTS}, {_LISTED}, due AS (SELECT g.root_id, g.path, g.generation FROM good g JOIN d2 d ON d.root_id = g.root_id AND d.path = g.path AND d.generation = g.generation AND d.complete AND d.last_error = '' WHERE g.complete),
    ck AS (SELECT e.root_id, e.path, e.kind, e.generation <> u.generation AS absent FROM e2 e JOIN due u ON u.root_id = e.root_id AND u.path = e.parent),
    rt AS (SELECT root_id, path, NOT absent AS preserve FROM ck c WHERE absent OR (kind <> 'directory' AND (EXISTS (SELECT 1 FROM d2 d WHERE d.root_id = c.root_id AND d.path = c.path) OR EXISTS (SELECT 1 FROM e2 x WHERE x.root_id = c.root_id AND starts_with(x.path, c.path || '/')))))
    SELECT 'entries' AS relation, root_id, path FROM e2 x WHERE NOT EXISTS (SELECT 1 FROM rt t WHERE t.root_id = x.root_id AND (starts_with(x.path, t.path || '/') OR (x.path = t.path AND NOT preserve)))
    UNION ALL SELECT 'directories', root_id, path FROM d2 x WHERE NOT EXISTS (SELECT 1 FROM rt t WHERE t.root_id = x.root_id AND (x.path = t.path OR starts_with(x.path, t.path || '/')))""")
def retired_inventory(spark, sf_dir):
    """Rows and passes that are left once there is nothing more to retire."""
    after = listed(spark, sf_dir)
    entries, directories = scanning.retire_all(written(after["entries"], "entries"), written(after["directories"], "directories"), written(after["reconcile"], "tasks"))
    rows = lambda name, df: as_path(df).select(F.lit(name).alias("relation"), F.col("root_id").cast("long").alias("root_id"), "path")
    return rows("entries", entries).union(rows("directories", directories))


_PLANNED = f"pq AS (SELECT user_id % 30 AS plan_id, event_id AS ordinal, ['save', 'approve', 'use', 'use', 'use', 'use', 'use', 'use'][event_id * 31 % 8 + 1] AS a, event_id % 97 = 11 AS v, epoch_us(ts) AS at_us FROM events), pr AS (SELECT plan_id, ordinal, CASE WHEN v THEN 'revoke' ELSE a END AS action, at_us FROM pq)"


@report(f"""WITH {_PLANNED}, ps AS (SELECT plan_id, min(ordinal) AS s FROM pr WHERE action = 'save' GROUP BY 1), pa AS (SELECT p.plan_id, min(ordinal) AS a, min(at_us) AS a_us FROM pr p JOIN ps USING (plan_id) WHERE action = 'approve' AND ordinal > s GROUP BY 1),
    pv AS (SELECT p.plan_id, min(ordinal) AS r FROM pr p JOIN pa USING (plan_id) WHERE action = 'revoke' AND ordinal > a GROUP BY 1), j AS (SELECT p.*, s, a, a_us, r, coalesce(ordinal > s, FALSE) AS known,
      CASE WHEN coalesce(ordinal > r, FALSE) THEN 'revoked' WHEN NOT coalesce(ordinal > a, FALSE) THEN 'pending' WHEN at_us < a_us + {DAY} THEN 'approved' ELSE 'expired' END AS st FROM pr p LEFT JOIN ps USING (plan_id) LEFT JOIN pa USING (plan_id) LEFT JOIN pv USING (plan_id))
    SELECT plan_id, ordinal, CASE WHEN action <> 'save' AND NOT known THEN 'absent' WHEN ordinal = a AND action = 'approve' THEN 'approved' WHEN ordinal = r AND action = 'revoke' THEN 'revoked' ELSE st END AS state,
      CASE WHEN action = 'save' THEN CASE WHEN known THEN 'existing' ELSE 'created' END WHEN NOT known THEN 'refused' WHEN (action = 'approve' AND ordinal = a) OR (action = 'revoke' AND ordinal = r) THEN 'recorded' WHEN action = 'use' THEN CASE WHEN st = 'approved' THEN 'allowed' ELSE 'refused' END
           WHEN (action = 'approve' AND st = 'approved') OR (action = 'revoke' AND st = 'revoked') THEN 'existing' ELSE 'refused' END AS result FROM j""")
def plan_histories(spark, sf_dir):
    """Events as requests about plans: saved once, approved once and for a day, revoked for good."""
    id_ = F.col("event_id")
    action = F.element_at(F.array(*[F.lit(a) for a in ("save", "approve", *["use"] * 6)]), (id_ * 31 % 8 + 1).cast("int"))
    requests = adapters.observations(spark, sf_dir).select((F.col("user_id") % 30).alias("plan_id"), id_.alias("ordinal"), F.when(id_ % 97 == 11, "revoke").otherwise(action).alias("action"), F.unix_micros("ts").alias("at_us"))
    return sessions.plan_history(requests)


@report("""SELECT n_nationkey AS context, 'c' || c_custkey AS id, 'i' || c_custkey % 9 AS image, CASE c_custkey % 8 WHEN 0 THEN 'running' WHEN 1 THEN 'exited' WHEN 2 THEN 'unknown' ELSE 'created' END AS state, c_custkey * 3 AS created, n > 128 AS truncated
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) JOIN nation ON n_nationkey = c_nationkey WHERE nth <= 128""")
def engine_containers(spark, sf_dir):
    """An engine for each nation with its customers as containers."""
    key = F.col("c_custkey")
    state = F.when(key % 8 == 0, "running").when(key % 8 == 1, "exited").when(key % 8 == 2, "odd").otherwise("created")
    item = F.struct(key, F.struct(F.concat(F.lit("c"), key.cast("string")).alias("Id"), F.concat(F.lit("i"), (key % 9).cast("string")).alias("Image"), state.alias("State"), (key * 3).alias("Created")).alias("c"))
    bodies = adapters.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("context")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"])).alias("body"))  # a response's objects are one body
    return metadata.engine_containers(bodies)


@report(f"WITH {PROJECTS}, t AS (SELECT root_id, path FROM pe WHERE kind = 'directory' AND id > 0 AND id % 64 = 0 AND id // 64 % 60 = 7) SELECT t.path AS top, e.path, e.kind FROM t JOIN pe e ON e.root_id = t.root_id AND (e.path = t.path OR starts_with(e.path, t.path || '/'))")
def clustered_subtrees(spark, sf_dir):
    """Some projects read as subtrees of a relation in the order of its paths, each from the files that may hold it."""
    e = written(projects.entries(spark, sf_dir).drop("link"), "project-entries")
    table = ClusteredTable(spark, new_folder(spark, "clustered"))
    table.write(e, max(32, e.count() // 200_000))
    tops = table.read().where("kind = 'directory' and id > 0 and id % 64 = 0 and id div 64 % 60 = 7").select("root_id", "path")
    found = table.subtrees(written(tops, "tops"))
    return found.select(F.col("_top").cast("string").alias("top"), F.col("path").cast("string").alias("path"), "kind")


_SEEN = """SELECT doc_id % 40 AS observation_id, doc_id AS finding_id, strlen(coalesce(text, '')) AS manifest_bytes, sha256(coalesce(text, '')) AS manifest_sha256, doc_id % 50 AS lock_bytes, sha256(source) AS lock_sha256, 3 AS lock_version, doc_id % 9 AS locked_packages, sha256(coalesce(lang, '')) AS metadata_sha256,
    doc_id % 30 + 3 AS entries, doc_id % 30 AS directories, 2 AS regular_files, 1 AS internal_links FROM documents"""
_CHANGED = ["doc_id % 11 = 3", "doc_id % 13 = 4", "doc_id % 17 = 5", "doc_id % 19 = 6", "doc_id % 23 = 7"]


@report(f"""WITH b AS ({_SEEN}), j AS (SELECT observation_id, finding_id, CASE WHEN finding_id % 211 = 8 THEN 'no_evidence' WHEN finding_id % 67 = 9 THEN 'blocked' WHEN {' OR '.join(c.replace('doc_id', 'finding_id') for c in _CHANGED)} THEN 'changed' ELSE 'matches_observation' END AS status,
      concat_ws(',', {', '.join(f"CASE WHEN {c.replace('doc_id', 'finding_id')} THEN '{name}' END" for c, (name, _) in zip(_CHANGED, history.CHANGES))}) AS changes FROM b)
    SELECT observation_id, finding_id, status, CASE WHEN status = 'blocked' THEN 'tree_limit' END AS code, CASE WHEN status = 'changed' THEN changes ELSE '' END AS changes,
           ['matches_observation', 'changed', 'blocked', 'no_evidence'][max(list_position(['matches_observation', 'changed', 'blocked', 'no_evidence'], status)) OVER (PARTITION BY observation_id)] AS observation_status FROM j""")
def compared_observations(spark, sf_dir):
    """Documents as captured targets of forty observations against live ones, of which some changed, were blocked or are missing."""
    d, id_ = adapters.table(spark, sf_dir, "documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    long = lambda c: c.cast("long")
    base = d.select(
        (id_ % 40).alias("observation_id"), id_.alias("finding_id"), long(F.octet_length(text)).alias("manifest_bytes"), F.sha2(text, 256).alias("manifest_sha256"), long(id_ % 50).alias("lock_bytes"), F.sha2("source", 256).alias("lock_sha256"), F.lit(3).alias("lock_version"), long(id_ % 9).alias("locked_packages"),
        F.sha2(F.coalesce("lang", F.lit("")), 256).alias("metadata_sha256"), long(id_ % 30 + 3).alias("entries"), long(id_ % 30).alias("directories"), long(F.lit(2)).alias("regular_files"), long(F.lit(1)).alias("internal_links"),
    )
    tests = [F.expr(c.replace("doc_id", "finding_id")) for c in _CHANGED]
    more = lambda c, i: F.col(c) + F.when(tests[i], 1).otherwise(0)
    live = base.where("finding_id % 211 <> 8").withColumns({"manifest_bytes": more("manifest_bytes", 0), "lock_bytes": more("lock_bytes", 1), "locked_packages": more("locked_packages", 2), "entries": more("entries", 4), "metadata_sha256": F.when(tests[3], "x").otherwise(F.col("metadata_sha256"))})
    blocked = F.col("finding_id") % 67 == 9
    live = live.select(*[F.when(~blocked | F.lit(c in ("observation_id", "finding_id")), F.col(c)).alias(c) for c in live.columns], F.when(blocked, "blocked").otherwise("observed").alias("status"), F.when(blocked, "tree_limit").otherwise("").alias("code"))
    return history.compare_observations(base, live)
