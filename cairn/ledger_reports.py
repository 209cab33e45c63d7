"""Reports whose rows depend on those before: sessions, reservations, admissions, refreshes, journals, turns; and files read by range."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import history, ranking, sessions
from cairn.registry import report
from cairn.sources import adapters, content, metadata
from cairn.sources.written import shared_folder, written

HOUR, DAY, MINUTE = sessions.HOUR_US, sessions.DAY_US, 60_000_000
#: A session is idle after so long, seen from the end of the observed time.
IDLE, NOW = 2 * DAY, 1_706_745_600_000_000  # 2024-02-01

# --- sessions --------------------------------------------------------------------------------------

_SAMPLES = f"""sm AS (SELECT user_id * 8 + (epoch_us(ts) // {DAY}) % 8 AS session, event_id AS ordinal, epoch_us(ts) - CASE WHEN event_id % 31 = 5 THEN {HOUR * 30} ELSE 0 END AS at_us,
        CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL WHEN event_id % 29 = 7 THEN event_id * 500 WHEN event_id % 101 = 9 THEN -1 ELSE event_id * 1000 + event_id % 997 END AS cpu_ns,
        CASE WHEN event_id % 61 = 11 THEN 0 ELSE 1000000 + event_id % 1000 END AS elapsed_ns, CASE WHEN event_type = 'error' THEN 'cpu_unavailable' END AS reason FROM events)"""
_CHARGES = f"""{_SAMPLES}, sl AS (SELECT *, lag(cpu_ns) OVER w AS last_cpu, lag(ordinal) OVER w AS last_ordinal, max(at_us) OVER (PARTITION BY session ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, lead(ordinal) OVER w IS NULL AS at_end FROM sm WINDOW w AS (PARTITION BY session ORDER BY ordinal)),
    sf AS (SELECT *, CASE WHEN last_ordinal IS NOT NULL AND at_us < high THEN 'cpu_clock_rollback' WHEN cpu_ns IS NULL THEN coalesce(reason, 'cpu_unknown') WHEN cpu_ns < 0 THEN 'cpu_observation_invalid' WHEN last_ordinal IS NOT NULL AND elapsed_ns <= 0 THEN 'elapsed_window_invalid'
             WHEN last_ordinal IS NOT NULL AND cpu_ns < last_cpu THEN 'cpu_observation_regressed' END AS fault FROM sl),
    so AS (SELECT f.*, CASE WHEN f.ordinal > e.first_fault THEN 'refused' WHEN f.ordinal = e.first_fault THEN 'unknown' WHEN at_end AND greatest(at_us, coalesce(high, at_us)) + {IDLE} <= {NOW} THEN 'recovered_unknown' ELSE 'charged' END AS outcome, greatest(at_us, coalesce(high, at_us)) AS booked
           FROM sf f LEFT JOIN (SELECT session, min(ordinal) AS first_fault FROM sf WHERE fault IS NOT NULL GROUP BY 1) e USING (session)),
    sc AS (SELECT session, ordinal, booked AS at_us, CASE WHEN outcome IN ('charged', 'recovered_unknown') THEN cpu_ns - CASE WHEN last_ordinal IS NULL THEN 0 ELSE last_cpu END ELSE 0 END AS charged_ns, outcome,
             CASE outcome WHEN 'unknown' THEN fault WHEN 'recovered_unknown' THEN 'interrupted_session' END AS reason FROM so)"""


def samples(spark, sf_dir) -> DataFrame:
    """Events as samples of counters: a session for each user and weekday in eight; some fall, are unknown, or run back."""
    e = adapters.table(spark, sf_dir, "events")
    id_, at = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    cpu = F.when((F.col("event_type") == "error") & (id_ % 3 == 0), None).when(id_ % 29 == 7, id_ * 500).when(id_ % 101 == 9, -1).otherwise(id_ * 1000 + id_ % 997)
    return e.select(
        (F.col("user_id") * 8 + F.floor(at / DAY) % 8).cast("long").alias("session"), id_.alias("ordinal"), (at - F.when(id_ % 31 == 5, HOUR * 30).otherwise(0)).alias("at_us"), cpu.cast("long").alias("cpu_ns"),
        F.when(id_ % 61 == 11, 0).otherwise(1_000_000 + id_ % 1000).cast("long").alias("elapsed_ns"), F.when(F.col("event_type") == "error", "cpu_unavailable").alias("reason"),
    )


@report(f"WITH {_CHARGES} SELECT session, ordinal, at_us, charged_ns, outcome, reason FROM sc")
def session_charges(spark, sf_dir):
    return sessions.session_charges(samples(spark, sf_dir), NOW, IDLE)


_SLOTS = "SELECT '{name}' AS slot, at_us - at_us % {us} AS slot_us, cast(sum(charged_ns) AS BIGINT) AS charged_ns, bool_or(outcome <> 'charged') AS blocked, count(DISTINCT session) AS sessions FROM sc WHERE outcome <> 'refused' GROUP BY 2"


@report(f"WITH {_CHARGES} {_SLOTS.format(name='hour', us=HOUR)} UNION ALL {_SLOTS.format(name='day', us=DAY)}")
def hour_day_charges(spark, sf_dir):
    """Charges by the hour and by the day that their samples end in."""
    charges = sessions.session_charges(samples(spark, sf_dir), NOW, IDLE)
    slots = lambda name, us: sessions.slot_totals(charges, us).select(F.lit(name).alias("slot"), "slot_us", "charged_ns", "blocked", "sessions")
    return slots("hour", HOUR).union(slots("day", DAY))


# --- reservations ----------------------------------------------------------------------------------

WINDOW = 30 * MINUTE
_LEDGER = f"""rv AS (SELECT event_id AS token, ts AS at, event_id % 64 + 1 AS allowance FROM events),
    st AS (SELECT event_id AS token, ts + CASE WHEN event_id % 4 = 0 THEN INTERVAL 45 MINUTE ELSE INTERVAL 5 MINUTE * (event_id % 5) END AS at, CASE WHEN event_id % 7 = 0 THEN event_id % 64 + 2 ELSE event_id % 64 // 2 END AS observed FROM events WHERE event_type <> 'error'
           UNION ALL SELECT event_id, ts + INTERVAL 20 MINUTE, event_id % 64 + 1 FROM events WHERE event_type = 'click'),
    rs AS (SELECT r.token, r.at, r.allowance, arg_min(s.observed, (s.at, s.observed)) AS observed FROM rv r LEFT JOIN st s ON s.token = r.token AND s.at >= r.at AND s.at < r.at + INTERVAL 30 MINUTE AND s.observed BETWEEN 0 AND r.allowance GROUP BY ALL)"""


def reservations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Events as reservations and settlements: some come late, claim too much, come twice or never."""
    e = adapters.observations(spark, sf_dir)
    id_ = F.col("event_id")
    after = lambda minutes: F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    reserved = e.select(id_.alias("token"), F.col("ts").alias("at"), (id_ % 64 + 1).alias("allowance"))
    first = e.where("event_type <> 'error'").select(id_.alias("token"), after(F.when(id_ % 4 == 0, 45).otherwise(5 * (id_ % 5)).cast("int")).alias("at"), F.when(id_ % 7 == 0, id_ % 64 + 2).otherwise(F.floor(id_ % 64 / 2)).cast("long").alias("observed"))
    again = e.where("event_type = 'click'").select(id_.alias("token"), after(F.lit(20)).alias("at"), (id_ % 64 + 1).alias("observed"))
    return reserved, first.union(again)


@report(f"WITH {_LEDGER} SELECT token, CASE WHEN observed IS NULL THEN 'unknown' ELSE 'settled' END AS status, allowance, observed FROM rs")
def reservation_outcomes(spark, sf_dir):
    return sessions.settled_reservations(*reservations(spark, sf_dir), WINDOW).select("token", "status", "allowance", "observed")


@report(f"""WITH {_LEDGER} SELECT cast(cast(r_at AS DATE) AS VARCHAR) AS day, cast(sum(allowance) AS BIGINT) AS reserved, cast(coalesce(sum(observed), 0) AS BIGINT) AS observed, cast(coalesce(sum(allowance) FILTER (observed IS NULL AND r_at < TIMESTAMP '2024-01-30'), 0) AS BIGINT) AS unknown_reserved,
    cast(coalesce(sum(allowance) FILTER (r_at >= TIMESTAMP '2024-01-30'), 0) AS BIGINT) AS outstanding, count(*) AS attempts FROM (SELECT rs."at" AS r_at, allowance, CASE WHEN rs."at" < TIMESTAMP '2024-01-30' THEN observed END AS observed FROM rs) GROUP BY 1""")
def reservation_ledger(spark, sf_dir):
    """Charges of each day; reservations of the last are still open."""
    reserved, settled = reservations(spark, sf_dir)
    over = F.col("at") < F.lit("2024-01-30").cast("timestamp")
    found = sessions.reservation_ledger(sessions.settled_reservations(reserved.where(over), settled, WINDOW), reserved.where(~over))
    return found.withColumn("day", F.col("day").cast("string"))


# --- admission -------------------------------------------------------------------------------------

DAY_CAP, LIFETIME_CAP, FROM, UNTIL = 3_000, 30_000, 1_704_153_600_000_000, 1_706_572_800_000_000  # 2 to 30 January 2024
_ASKED = f"""rq AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 20 + 1 END AS consent, event_id, epoch_us(ts) - CASE WHEN event_id % 17 = 4 THEN {HOUR * 12} ELSE 0 END AS at_us, event_id * 37 % 900 AS asked,
        CASE WHEN user_id % 20 = 6 AND event_id % 3 <> 0 THEN 1705363200000000 END AS revoked_us FROM events)"""


def consent_requests(spark, sf_dir) -> DataFrame:
    """Events as requests to read: a third of them under one consent."""
    e = adapters.observations(spark, sf_dir)
    id_, hot = F.col("event_id"), F.col("event_id") % 3 == 0
    at = F.unix_micros("ts") - F.when(id_ % 17 == 4, HOUR * 12).otherwise(0)
    return e.select(
        F.when(hot, 0).otherwise(F.col("user_id") % 20 + 1).cast("long").alias("consent"), "event_id", at.cast("long").alias("at_us"), (id_ * 37 % 900).cast("long").alias("asked"),
        F.lit(DAY_CAP).cast("long").alias("day_cap"), F.lit(LIFETIME_CAP).cast("long").alias("total_cap"), F.lit(FROM).cast("long").alias("from_us"), F.lit(UNTIL).cast("long").alias("until_us"),
        F.when((F.col("user_id") % 20 == 6) & ~hot, F.lit(1_705_363_200_000_000)).cast("long").alias("revoked_us"),
    )


@report(f"""WITH RECURSIVE {_ASKED}, rn AS (SELECT *, row_number() OVER (PARTITION BY consent ORDER BY event_id) AS nth FROM rq),
    fd(consent, nth, event_id, outcome, granted, day, day_used, total, high) AS (
        SELECT consent, cast(0 AS BIGINT), cast(NULL AS BIGINT), cast(NULL AS VARCHAR), cast(0 AS BIGINT), cast(-1 AS BIGINT), cast(0 AS BIGINT), cast(0 AS BIGINT), cast(-4611686018427387904 AS BIGINT) FROM (SELECT DISTINCT consent FROM rq)
        UNION ALL SELECT consent, nth, event_id, CASE WHEN g > 0 OR (why IS NULL AND asked = 0) THEN 'admitted' ELSE coalesce(why, CASE WHEN total >= {LIFETIME_CAP} THEN 'lifetime_byte_limit' WHEN used >= {DAY_CAP} THEN 'daily_byte_limit' ELSE 'durable_quantum' END) END,
            g, CASE WHEN g > 0 OR (why IS NULL AND asked = 0) THEN today ELSE day END, CASE WHEN g > 0 OR (why IS NULL AND asked = 0) THEN used + g ELSE day_used END, total + g, high
        FROM (SELECT *, CASE WHEN why IS NOT NULL THEN 0 WHEN asked <= room THEN asked ELSE room - room % 64 END AS g FROM
             (SELECT *, greatest(least({DAY_CAP} - used, {LIFETIME_CAP} - total), 0) AS room FROM
               (SELECT f.consent, r.nth, r.event_id, r.asked, f.day, f.day_used, f.total, greatest(f.high, r.at_us) AS high, r.at_us // {DAY} AS today, CASE WHEN f.day = r.at_us // {DAY} THEN f.day_used ELSE 0 END AS used,
                  CASE WHEN r.at_us < f.high THEN 'clock_rollback' WHEN r.revoked_us IS NOT NULL AND r.at_us >= r.revoked_us THEN 'read_consent_revoked' WHEN r.at_us < {FROM} OR r.at_us >= {UNTIL} THEN 'read_consent_expired' END AS why
                FROM fd f JOIN rn r ON r.consent = f.consent AND r.nth = f.nth + 1))))
    SELECT consent, event_id, outcome, granted, day_used, total AS total_used FROM fd WHERE nth > 0""")
def sequential_admission(spark, sf_dir):
    """Requests decided one after the other: those refused spend nothing, and the clock does not go back."""
    return sessions.admissions(consent_requests(spark, sf_dir), "consent", ["event_id"])


# --- requested refreshes -----------------------------------------------------------------------------

_KINDS = "['request', 'activate', 'witness', 'finalize', 'restart']"


@report(f"""WITH RECURSIVE ev AS (SELECT user_id AS root_id, event_id AS "at", {_KINDS}[event_id * 7 % 5 + 1] AS kind, CASE WHEN event_id % 6 <> 1 THEN user_id % 3 + event_id % 2 END AS generation, event_id % 8 <> 3 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
    ph(root_id, nth, "at", phase, witness) AS (SELECT DISTINCT user_id, cast(0 AS BIGINT), cast(NULL AS BIGINT), 'none', cast(0 AS BIGINT) FROM events
      UNION ALL SELECT p.root_id, e.nth, e."at", CASE WHEN kind = 'request' AND phase IN ('none', 'completed', 'unknown') THEN 'pending' WHEN kind = 'activate' AND phase = 'pending' AND ok THEN 'active' WHEN phase = 'active' AND kind = 'restart' AND witness = 0 THEN 'unknown'
          WHEN phase = 'active' AND kind = 'finalize' THEN CASE WHEN ok AND witness > 0 AND witness = coalesce(generation, -1) THEN 'completed' ELSE 'unknown' END ELSE phase END,
        CASE WHEN (kind = 'request' AND phase IN ('none', 'completed', 'unknown')) OR (kind = 'activate' AND phase = 'pending' AND ok) OR (phase = 'active' AND kind = 'restart' AND witness = 0) THEN 0 WHEN phase = 'active' AND kind = 'witness' AND coalesce(generation, 0) > 0 THEN generation ELSE witness END
      FROM ph p JOIN ev e ON e.root_id = p.root_id AND e.nth = p.nth + 1)
    SELECT root_id, "at", phase, CASE phase WHEN 'active' THEN 'historical_root_listing_pending' WHEN 'completed' THEN 'historical_pass_completed' WHEN 'unknown' THEN 'activation_lineage_unknown' ELSE '' END AS qualification FROM ph WHERE nth > 0""")
def manual_refresh_states(spark, sf_dir):
    """The refresh of each user's root after each of its events."""
    id_, user = F.col("event_id"), F.col("user_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("request", "activate", "witness", "finalize", "restart")]), (id_ * 7 % 5 + 1).cast("int"))
    events = adapters.table(spark, sf_dir, "events").select(user.alias("root_id"), id_.alias("at"), kind.alias("kind"), F.when(id_ % 6 != 1, user % 3 + id_ % 2).alias("generation"), (id_ % 8 != 3).alias("ok"))
    return sessions.refresh_phases(events)


# --- journals ----------------------------------------------------------------------------------------

PREFIX = "journal-event-v1-"
#: What is done to a saved event, by its id: a byte of its payload, its sequence, its place, its time.
_DAMAGE = "CASE event_id % 211 WHEN 5 THEN 'byte' WHEN 6 THEN 'gone' WHEN 7 THEN 'sequence' WHEN 8 THEN 'stranger' ELSE '' END"
_PAYLOAD = """'{"intent_id":"' || intent || '","expected_sequence":' || nth || ',"predecessor_id":' || CASE WHEN before IS NULL THEN 'null' ELSE '"' || before || '"' END || ',"created_at_us":' || at_us || ',"kind":"' || kind || '","outcome":"' || event_type || '"}'"""


def journal(spark, sf_dir) -> DataFrame:
    """Events as journals of some sixteen events each, chained by their digests, and damaged here and there."""
    e = adapters.observations(spark, sf_dir)
    id_ = F.col("event_id")
    intent = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.expr("event_id div 2000").cast("string"))
    kind = F.when(id_ % 5 == 0, "attempt_recorded").otherwise("observation_recorded")
    at = F.unix_micros("ts") - F.when(id_ % 223 == 9, 90 * DAY).otherwise(0)
    rows = e.select(intent.alias("intent"), id_.alias("event_id"), at.alias("at_us"), kind.alias("kind"), "event_type")
    # an intent has a bounded number of events, so its chain is one array
    grouped = rows.groupBy("intent").agg(F.array_sort(F.collect_list(F.struct("event_id", "at_us", "kind", "event_type"))).alias("es"))
    text = lambda before, e, n: F.concat(
        F.lit('{"intent_id":"'), F.col("intent"), F.lit('","expected_sequence":'), n.cast("string"), F.lit(',"predecessor_id":'), F.when(before.isNull(), "null").otherwise(F.concat(F.lit('"'), before, F.lit('"'))),
        F.lit(',"created_at_us":'), e["at_us"].cast("string"), F.lit(',"kind":"'), e["kind"], F.lit('","outcome":"'), e["event_type"], F.lit('"}'),
    )
    last = lambda acc: F.try_element_at(acc, F.lit(-1))["id"]
    item = lambda acc, e: F.transform(F.array(text(last(acc), e, F.size(acc) + 1)), lambda p: F.struct(F.concat(F.lit(PREFIX), F.sha2(p.cast("binary"), 256)).alias("id"), p.alias("payload"), e["event_id"].alias("event_id"), (F.size(acc)).cast("int").alias("seq")))
    start = F.array().cast("array<struct<id:string,payload:string,event_id:bigint,seq:int>>")
    chained = grouped.select("intent", F.explode(F.aggregate("es", start, lambda acc, e: F.concat(acc, item(acc, e)))).alias("x"))
    saved = chained.select("intent", F.col("x.event_id").alias("event_id"), (F.col("x.seq") + 1).alias("nth"), F.col("x.id").alias("id"), F.col("x.payload").alias("payload")).withColumn("damage", F.expr(_DAMAGE))
    return saved.where("damage <> 'gone'").select(
        F.when(F.col("damage") == "stranger", F.concat("intent", F.lit("x"))).otherwise(F.col("intent")).alias("intent_id"), (F.col("nth") + F.when(F.col("damage") == "sequence", 100).otherwise(0)).alias("sequence"), "id",
        F.when(F.col("damage") == "byte", F.replace("payload", F.lit('"outcome":"'), F.lit('"outcome": "'))).otherwise(F.col("payload")).alias("payload"),
    )


@report(f"""WITH RECURSIVE je AS (SELECT user_id || '-' || event_id // 2000 AS intent, event_id, epoch_us(ts) - CASE WHEN event_id % 223 = 9 THEN {90 * DAY} ELSE 0 END AS at_us, CASE WHEN event_id % 5 = 0 THEN 'attempt_recorded' ELSE 'observation_recorded' END AS kind, event_type,
        row_number() OVER (PARTITION BY user_id, event_id // 2000 ORDER BY event_id) AS nth FROM events),
    jc(intent, nth, event_id, at_us, kind, event_type, before, payload, id) AS (
        SELECT intent, nth, event_id, at_us, kind, event_type, NULL::VARCHAR, {_PAYLOAD.replace('before', 'NULL::VARCHAR')}, '{PREFIX}' || sha256({_PAYLOAD.replace('before', 'NULL::VARCHAR')}) FROM je WHERE nth = 1
        UNION ALL SELECT intent, nth, event_id, at_us, kind, event_type, before, p, '{PREFIX}' || sha256(p) FROM (SELECT *, {_PAYLOAD} AS p FROM (SELECT e.*, c.id AS before FROM jc c JOIN je e ON e.intent = c.intent AND e.nth = c.nth + 1))),
    jd AS (SELECT *, {_DAMAGE} AS damage FROM jc),
    js AS (SELECT CASE WHEN damage = 'stranger' THEN intent || 'x' ELSE intent END AS intent_id, nth + CASE WHEN damage = 'sequence' THEN 100 ELSE 0 END AS sequence, * EXCLUDE (intent) RENAME (nth AS told), intent AS own FROM jd WHERE damage <> 'gone'),
    jl AS (SELECT *, row_number() OVER w AS n, lag(id) OVER w AS last_id, lag(at_us) OVER w AS last_at FROM js WINDOW w AS (PARTITION BY intent_id ORDER BY sequence, id)),
    jf AS (SELECT *, CASE WHEN damage = 'byte' THEN 'digest_differs' WHEN own <> intent_id THEN 'other_intent' WHEN sequence <> n OR told <> sequence THEN 'sequence_broken' WHEN before IS DISTINCT FROM last_id THEN 'predecessor_differs' WHEN last_at IS NOT NULL AND at_us < last_at THEN 'time_runs_back' WHEN n > 16 THEN 'too_many_events' END AS fault FROM jl)
    SELECT intent_id, count(*) AS events, count(fault) = 0 AS valid, min(n) FILTER (fault IS NOT NULL) AS broken_at, arg_min(fault, n) FILTER (fault IS NOT NULL) AS reason,
           CASE WHEN count(fault) = 0 THEN arg_max(CASE WHEN kind = 'attempt_recorded' THEN 'outcome_unknown' ELSE event_type END, n) ELSE 'outcome_unknown' END AS state FROM jf GROUP BY 1""")
def verified_journals(spark, sf_dir):
    """Every journal with its first broken link."""
    return history.verified_journal(journal(spark, sf_dir), PREFIX)


# --- turns -------------------------------------------------------------------------------------------

CURSOR, DUE = 17, 700
_WORK = f"""wr AS (SELECT i AS root_id, i % 9 <> 4 AS enabled, i % 5 = 1 AS busy FROM range(60) AS t(i)),
    wk AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey % 50 END AS root_id, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'maintenance' ELSE 'source' END AS kind, o_custkey * 7 % 1000 AS due_at FROM orders)"""


@report(f"""WITH {_WORK}, rd AS (SELECT w.*, kind = 'maintenance' AS late FROM wk w JOIN wr r USING (root_id) WHERE enabled AND (kind = 'source' AND due_at <= {DUE} OR kind = 'maintenance' AND NOT busy)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY late, due_at, id) AS nth FROM rd)
    SELECT row_number() OVER (ORDER BY nth, root_id <= {CURSOR}, root_id) AS turn, root_id, nth AS round, kind, id FROM rk""")
def fair_turns(spark, sf_dir):
    """Orders as work of roots, of which one has a third: turns from the root after the last one served."""
    o = adapters.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    work = o.select(F.when(key % 3 == 0, 7).otherwise(F.col("o_custkey") % 50).cast("long").alias("root_id"), key.alias("id"), F.when(F.col("o_orderstatus") == "F", "maintenance").otherwise("source").alias("kind"), (F.col("o_custkey") * 7 % 1000).alias("due_at"))
    roots = spark.range(60).select(F.col("id").alias("root_id"), (F.col("id") % 9 != 4).alias("enabled"), (F.col("id") % 5 == 1).alias("busy"))
    return ranking.fair_turns(work, roots, CURSOR, DUE)


@report("""SELECT o_orderpriority AS queue, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS nth FROM orders""")
def queue_positions(spark, sf_dir):
    """Positions in queues of any length, dealt by range."""
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("queue"), "o_totalprice", F.col("o_orderkey").alias("id"))
    return ranking.ranked(o, ["queue"], ["o_totalprice", "id"]).select("queue", "id", "nth")


# --- files read by range -----------------------------------------------------------------------------


def files(spark, sf_dir) -> DataFrame:
    """The documents' texts as files below the shared folder, a thousand ids in a folder."""
    docs = adapters.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), F.expr("cast(doc_id div 1000 as string)").alias("folder"))
    folder = f"{shared_folder(spark).removeprefix('file:').rstrip('/')}/files-{uuid.uuid4().hex}"
    return written(content.write_files(docs, "/" + folder.lstrip("/")), "file-rows")


_SAMPLED = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents), w AS (SELECT *, (n - 256) // 2 AS mid FROM d),
    f AS (SELECT doc_id, h, n, unnest(CASE WHEN n <= 0 THEN [] WHEN n <= 768 THEN [{'s': 0, 'l': n}] WHEN mid <= 256 THEN [{'s': 0, 'l': mid + 256}, {'s': n - 256, 'l': 256}] ELSE [{'s': 0, 'l': 256}, {'s': mid, 'l': 256}, {'s': n - 256, 'l': 256}] END) AS x FROM w),
    g AS (SELECT doc_id, n, count(*) AS k, sum(x.l) AS bytes, string_agg(lpad(hex(x.s), 16, '0') || lpad(hex(x.l), 16, '0') || substr(h, 2 * x.s + 1, 2 * x.l), '' ORDER BY x.s) AS body FROM f GROUP BY doc_id, n)
    SELECT d.doc_id, 'complete' AS status, sha256(unhex('73616D706C65' || lpad(hex(d.n), 16, '0') || lpad(hex(coalesce(k, 0)), 16, '0') || coalesce(body, ''))) AS digest, cast(coalesce(bytes, 0) AS BIGINT) AS read FROM d LEFT JOIN g USING (doc_id)"""


@report(_SAMPLED)
def file_samples(spark, sf_dir):
    """Sample digests of files of which only the windows are read."""
    return content.sample_files(files(spark, sf_dir), "sample", 256).select(F.col("id").alias("doc_id"), "status", "digest", "read")


@report("SELECT doc_id, 'complete' AS status, sha256(encode(coalesce(text, ''))) AS sha256, strlen(coalesce(text, '')) AS read FROM documents")
def file_hashes(spark, sf_dir):
    return content.hash_files(files(spark, sf_dir)).select(F.col("id").alias("doc_id"), "status", "sha256", "read")


# --- power supplies ----------------------------------------------------------------------------------

_SUPPLIES = """ps AS (SELECT user_id AS host, 's' || lpad(cast(event_id AS VARCHAR), 9, '0') AS name, ['System', 'System', 'Device', 'System', 'Unknown', 'System'][user_id % 6 + 1] AS scope, CASE WHEN user_id % 9 = 3 AND event_id % 40 = 0 THEN NULL WHEN event_id % 2 = 0 THEN ['Mains', 'USB_C', 'Wireless'][event_id % 3 + 1] ELSE 'Battery' END AS type,
    CASE WHEN user_id % 7 = 2 AND event_id % 30 = 4 THEN '3' ELSE cast(event_id % 3 AS VARCHAR) END AS online, CASE WHEN user_id % 8 = 5 AND event_id % 20 = 7 THEN NULL ELSE cast(CASE WHEN event_id % 4 = 1 THEN 0 ELSE 1 END AS VARCHAR) END AS present,
    CASE WHEN user_id % 10 = 1 AND event_id % 50 = 3 THEN 'Unknown' WHEN user_id % 4 = 3 AND event_id % 35 = 11 THEN 'Discharging' ELSE ['Charging', 'Not charging', 'Full'][event_id % 3 + 1] END AS status FROM events)"""


@report(f"""WITH {_SUPPLIES}, pc AS (SELECT host, name, CASE WHEN scope = 'Device' THEN 'outside' WHEN scope IS DISTINCT FROM 'System' THEN 'system_scope_unconfirmed' WHEN type IS NULL THEN 'supply_type_unconfirmed'
        WHEN type <> 'Battery' THEN CASE WHEN type NOT IN ('Mains', 'USB', 'USB_DCP', 'USB_CDP', 'USB_ACA', 'USB_C', 'USB_PD', 'USB_PD_DRP', 'BrickID', 'Wireless') THEN 'supply_type_outside_profile' WHEN online IN ('0', '1', '2') THEN 'external' ELSE 'external_supply_unconfirmed' END
        WHEN present IS NULL OR present NOT IN ('0', '1') THEN 'battery_presence_unconfirmed' WHEN present = '0' THEN 'absent' WHEN status = 'Discharging' THEN 'discharging' WHEN status IN ('Charging', 'Not charging', 'Full') THEN 'battery' ELSE 'battery_status_unconfirmed' END AS c FROM ps)
    SELECT host, CASE WHEN count(*) FILTER (c = 'discharging') > 0 THEN 'system_battery_discharging_observed' ELSE 'unknown' END AS status,
        CASE WHEN count(*) FILTER (c = 'discharging') > 0 THEN 'confirmed_system_battery_discharge_witness' ELSE coalesce(arg_min(c, name) FILTER (c IN ('system_scope_unconfirmed', 'supply_type_unconfirmed', 'supply_type_outside_profile', 'external_supply_unconfirmed', 'battery_presence_unconfirmed', 'battery_status_unconfirmed')), 'no_system_battery_discharge_witness') END AS reason,
        count(*) FILTER (c IN ('battery', 'discharging')) AS confirmed_batteries, count(*) FILTER (c = 'discharging') AS discharging_batteries, count(*) FILTER (c LIKE '%unconfirmed' OR c = 'supply_type_outside_profile') AS ambiguous FROM pc GROUP BY 1""")
def power_states(spark, sf_dir):
    """Events as power supplies of hosts."""
    e = adapters.observations(spark, sf_dir)
    id_, user = F.col("event_id"), F.col("user_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    supplies = e.select(
        user.alias("host"), F.concat(F.lit("s"), F.lpad(id_.cast("string"), 9, "0")).alias("name"), pick(["System", "System", "Device", "System", "Unknown", "System"], user % 6).alias("scope"),
        F.when((user % 9 == 3) & (id_ % 40 == 0), None).when(id_ % 2 == 0, pick(["Mains", "USB_C", "Wireless"], id_ % 3)).otherwise("Battery").alias("type"),
        F.when((user % 7 == 2) & (id_ % 30 == 4), "3").otherwise((id_ % 3).cast("string")).alias("online"), F.when((user % 8 == 5) & (id_ % 20 == 7), None).otherwise(F.when(id_ % 4 == 1, "0").otherwise("1")).alias("present"),
        F.when((user % 10 == 1) & (id_ % 50 == 3), "Unknown").when((user % 4 == 3) & (id_ % 35 == 11), "Discharging").otherwise(pick(["Charging", "Not charging", "Full"], id_ % 3)).alias("status"),
    )
    return metadata.power_state(supplies)
