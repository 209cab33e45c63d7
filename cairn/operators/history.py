"""Differences between evidence, and append-only review records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changed_aspects(columns: list[str], a: str = "a", b: str = "b") -> Column:
    """Names of the columns in which two sides differ; nulls are equal."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), c) for c in columns]))


def selection_check(saved: DataFrame, current: DataFrame, columns: list[str], verifiable: str) -> DataFrame:
    """Each selected target against the current evidence: a change outweighs evidence that cannot be verified."""
    a = saved.select("target", F.struct(*columns).alias("a"))
    b = current.select("target", F.struct(*columns).alias("b"), F.col(verifiable).alias("_sure"))
    joined = a.join(b, "target", "full").withColumn("changes", changed_aspects(columns))
    status = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.size("changes") > 0), "changed").when(~F.col("_sure"), "unverifiable").otherwise("matches_saved_inventory")
    return joined.select("target", status.alias("status"), F.concat_ws(",", "changes").alias("changes"))


#: What a later observation of a dependency tree can differ in, in the order in which it is told, and the columns that each is of (fixed values).
CHANGES = (
    ("manifest_bytes_changed", ("manifest_bytes", "manifest_sha256")), ("lock_bytes_changed", ("lock_bytes", "lock_sha256")), ("input_summary_changed", ("lock_version", "locked_packages")),
    ("tree_metadata_changed", ("metadata_sha256",)), ("tree_counts_changed", ("entries", "directories", "regular_files", "internal_links")),
)


def compare_observations(baseline: DataFrame, live: DataFrame) -> DataFrame:
    """Each target (observation_id, finding_id) of a captured observation against a live one, with what changed in a fixed order, and the status of its observation.

    A live target is ``observed`` or ``blocked`` with a code; one that is missing, or observed without its evidence, is
    no evidence and leaves its whole observation so. Blocked outweighs changed.
    """
    key, columns = ["observation_id", "finding_id"], [c for _, own in CHANGES for c in own]
    a = baseline.select(*key, F.struct(*columns).alias("a"))
    b = live.select(*key, F.col("status").alias("_live"), F.col("code").alias("_code"), F.struct(*columns).alias("b"))
    joined = a.join(b, key, "left")
    whole = ~F.exists(F.array(*[F.col(f"b.{c}").isNull() for c in columns]), lambda missing: missing)
    codes = F.array_compact(F.array(*[F.when(~F.struct(*[F.col(f"a.{c}") for c in own]).eqNullSafe(F.struct(*[F.col(f"b.{c}") for c in own])), name) for name, own in CHANGES]))
    status = (
        F.when(F.col("_live").isNull() | ~F.col("_live").isin("observed", "blocked") | ((F.col("_live") == "observed") & ~whole), "no_evidence")
        .when(F.col("_live") == "blocked", "blocked")
        .when(F.size(codes) > 0, "changed")
        .otherwise("matches_observation")
    )
    judged = joined.select(*key, status.alias("status"), F.when(status == "blocked", F.col("_code")).alias("code"), F.when(status == "changed", F.array_join(codes, ",")).otherwise("").alias("changes"))
    rank = F.array(*[F.lit(s) for s in ("matches_observation", "changed", "blocked", "no_evidence")])
    overall = judged.groupBy("observation_id").agg(F.max(F.array_position(rank, F.col("status"))).alias("_r")).select("observation_id", F.element_at(rank, F.col("_r").cast("int")).alias("observation_status"))
    return judged.join(overall, "observation_id")


def plan_reviews(plans: DataFrame, approvals: DataFrame, revocations: DataFrame, now: int, lifetime: int) -> DataFrame:
    """State of each plan: revoked outweighs expired, expired approved, approved pending."""
    a = approvals.groupBy("plan_id").agg(F.min("approved_ns").alias("_a"))
    r = revocations.select("plan_id", F.lit(True).alias("_r")).distinct()
    state = F.when(F.col("_r"), "revoked").when(F.col("_a").isNull(), "pending").when(F.col("_a") + lifetime <= now, "expired").otherwise("approved")
    return plans.join(a, "plan_id", "left").join(r, "plan_id", "left").select("plan_id", state.alias("state"))


def active_dismissals(dismissals: DataFrame, undone: DataFrame) -> DataFrame:
    return dismissals.join(undone.select(F.col("dismissal_id").alias("id")), "id", "left_anti")


def visible_findings(page: DataFrame, dismissals: DataFrame, undone: DataFrame) -> DataFrame:
    """A page of findings without those dismissed; the page was cut before and is not filled again."""
    return page.join(active_dismissals(dismissals, undone).select("request_id"), "request_id", "left_anti")


def journal_states(events: DataFrame, most: int = 16) -> DataFrame:
    """Outcome of each intent's journal, and whether its events form one chain from 1 on."""
    order = Window.partitionBy("intent_id").orderBy("sequence")
    linked = events.withColumn(
        "_ok", F.col("predecessor_id").eqNullSafe(F.lag("id").over(order)) & (F.col("sequence") == F.row_number().over(order))
    )
    return linked.groupBy("intent_id").agg(
        F.count("*").alias("events"), (F.bool_and("_ok") & (F.count("*") <= most)).alias("valid"), F.max_by("outcome", "sequence").alias("outcome")
    )


def verified_journal(events: DataFrame, prefix: str, most: int = 16) -> DataFrame:
    """Journals (intent_id, sequence, id, payload) checked event by event; payload is the JSON that was saved.

    An event's id must be the digest of its payload's bytes; the payload must name the intent, the
    sequence, the event before by its id and a time not before that event's; sequences must run from 1
    without gaps, ``most`` at most. So a byte changed anywhere breaks its own event, and an event put in, left
    out or moved breaks the next. The first broken link of an intent is told with its reason; its state
    then is unknown, and else that of its last event.
    """
    record = F.from_json("payload", "intent_id string, expected_sequence int, predecessor_id string, created_at_us long, kind string, outcome string")
    order = Window.partitionBy("intent_id").orderBy("sequence", "id")
    rows = events.withColumn("_r", record)
    rows = rows.withColumns({"_nth": F.row_number().over(order), "_before": F.lag("id").over(order), "_time": F.lag("_r.created_at_us").over(order)})
    no = lambda c: ~F.coalesce(c, F.lit(False))
    fault = (
        F.when(no(F.col("id") == F.concat(F.lit(prefix), F.sha2(F.col("payload").cast("binary"), 256))), "digest_differs")
        .when(no(F.col("_r.intent_id") == F.col("intent_id").cast("string")), "other_intent")
        .when((F.col("sequence") != F.col("_nth")) | no(F.col("_r.expected_sequence") == F.col("sequence")), "sequence_broken")
        .when(no(F.col("_r.predecessor_id").eqNullSafe(F.col("_before"))), "predecessor_differs")
        .when(F.col("_time").isNotNull() & no(F.col("_r.created_at_us") >= F.col("_time")), "time_runs_back")
        .when(F.col("_nth") > most, "too_many_events")
    )
    first = F.min(F.when(F.col("_fault").isNotNull(), F.struct("_nth", "_fault")))
    state = F.max_by(F.when(F.col("_r.kind") == "attempt_recorded", "outcome_unknown").otherwise(F.col("_r.outcome")), "_nth")
    found = rows.withColumn("_fault", fault).groupBy("intent_id").agg(F.count("*").alias("events"), first.alias("_first"), state.alias("_state"))
    whole = F.col("_first").isNull()
    return found.select("intent_id", "events", whole.alias("valid"), F.col("_first._nth").cast("long").alias("broken_at"), F.col("_first._fault").alias("reason"), F.when(whole, F.col("_state")).otherwise("outcome_unknown").alias("state"))


def exact_selection(findings: DataFrame, ids: list[int]) -> DataFrame:
    """The findings asked for; refused unless all of them, each once, are still selected."""
    if len(set(ids)) != len(ids) or not 1 <= len(ids) <= 20:
        raise ValueError("1 to 20 different ids are needed")
    chosen = findings.where(F.col("id").isin(ids) & (F.col("outcome") == "selected"))
    if chosen.count() != len(ids):
        raise ValueError("a finding asked for is no longer selected")
    return chosen


def request_digest(*columns: str) -> Column:
    """Content address of a request: the digest of its canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
