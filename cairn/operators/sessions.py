"""Ledgers whose outcome depends on what came before: sessions, reservations, admissions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from cairn.shipping import ship

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000

# --- sessions of a growing counter ---------------------------------------------------------------


def session_fault(cpu: Column, elapsed: Column, reason: Column, at: Column, ordinal: Column, last_cpu: Column, high_water: Column, last_ordinal: Column) -> Column:
    """Why a sample ends its session, if it does: an unknown counter, one that fell, a window without length, or a clock behind the highest seen."""
    begins = last_ordinal.isNull()
    return (
        F.when(~begins & (at < high_water), "cpu_clock_rollback")
        .when(cpu.isNull(), F.coalesce(reason, F.lit("cpu_unknown")))
        .when(cpu < 0, "cpu_observation_invalid")
        .when(~begins & F.coalesce(elapsed <= 0, F.lit(True)), "elapsed_window_invalid")
        .when(~begins & (cpu < last_cpu), "cpu_observation_regressed")
    )


def session_charges(samples: DataFrame, now_us: int | None = None, idle_us: int | None = None) -> DataFrame:
    """Samples (session, ordinal, at_us, cpu_ns, elapsed_ns, reason) with what each is charged and how it ends its session.

    The first sample is charged its whole counter, later ones what it grew by, up to the first fault,
    which closes the session: it is charged nothing, its slots are unknown, and what comes after is
    refused. A session without a fault whose last sample lies ``idle_us`` before ``now_us`` is
    recovered as unknown. The charge counts in the slots its sample ends in.
    """
    order = Window.partitionBy("session").orderBy("ordinal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = samples.withColumns({"_cpu": F.lag("cpu_ns").over(order), "_ordinal": F.lag("ordinal").over(order), "_high": F.max("at_us").over(before)})
    fault = session_fault(*[F.col(c) for c in ("cpu_ns", "elapsed_ns", "reason", "at_us", "ordinal", "_cpu", "_high", "_ordinal")])
    rows = rows.withColumn("_fault", fault)
    ended = F.count_if(F.col("_fault").isNotNull()).over(before)
    # the clock that a fault is booked at is never behind the highest seen
    rows = rows.withColumns({"_ended": F.coalesce(ended, F.lit(0)) > 0, "at_us": F.greatest("at_us", F.coalesce("_high", F.col("at_us")))})
    rows = rows.withColumn("_last", F.lead("ordinal").over(order).isNull())
    idle = F.lit(False) if now_us is None else F.col("_last") & (F.col("at_us") + F.lit(idle_us) <= F.lit(now_us))
    outcome = F.when(F.col("_ended"), "refused").when(F.col("_fault").isNotNull(), "unknown").when(idle, "recovered_unknown").otherwise("charged")
    charge = F.when(outcome.isin("charged", "recovered_unknown"), F.col("cpu_ns") - F.when(F.col("_ordinal").isNull(), 0).otherwise(F.col("_cpu"))).otherwise(0)
    reason = F.when(outcome == "unknown", F.col("_fault")).when(outcome == "recovered_unknown", "interrupted_session")
    return rows.select("session", "ordinal", "at_us", charge.cast("long").alias("charged_ns"), outcome.alias("outcome"), reason.alias("reason"))


def slot_totals(charges: DataFrame, slot_us: int) -> DataFrame:
    """Charges by slot of their samples' ends, and whether something unknown blocks the slot."""
    counted = charges.where("outcome <> 'refused'")
    return counted.groupBy((F.col("at_us") - F.pmod(F.col("at_us"), F.lit(slot_us))).alias("slot_us")).agg(
        F.sum("charged_ns").alias("charged_ns"), F.bool_or(F.col("outcome").isin("unknown", "recovered_unknown")).alias("blocked"), F.count_distinct("session").alias("sessions")
    )


# --- reservations that are settled or not --------------------------------------------------------


def settle_condition(window_us: int) -> Column:
    """A settlement belongs to a reservation of its token, from it on for so long; needs the sides named r and s."""
    return (F.col("r.token") == F.col("s.token")) & (F.col("s.at") >= F.col("r.at")) & (F.col("s.at") < F.col("r.at") + F.expr(f"INTERVAL {window_us} MICROSECONDS"))


def settled_reservations(reservations: DataFrame, settlements: DataFrame, window_us: int) -> DataFrame:
    """Reservations (token, at, allowance) with their status once their time is over: settled with what was observed, or unknown.

    Nothing is refunded: the whole allowance stays charged either way. Of several settlements the
    first counts, repeated or not; one that claims more than was allowed, or comes late, does not.
    """
    valid = settlements.join(reservations.select("token", "allowance"), "token").where((F.col("observed") >= 0) & (F.col("observed") <= F.col("allowance"))).drop("allowance")
    joined = reservations.alias("r").join(valid.alias("s"), settle_condition(window_us), "left")
    first = joined.groupBy("r.token", "r.at", "r.allowance").agg(F.min(F.struct(F.col("s.at").alias("at"), F.col("s.observed").alias("observed"))).alias("_s"))
    observed = F.col("_s.observed")
    return first.select("token", "at", "allowance", F.when(observed.isNull(), "unknown").otherwise("settled").alias("status"), observed.alias("observed"))


def reservation_ledger(outcomes: DataFrame, open_: DataFrame | None = None) -> DataFrame:
    """Charges of each UTC day from reservations with their status; ``open_`` are those whose time is not over."""
    rows = outcomes.select("at", "allowance", "status", "observed")
    if open_ is not None:
        rows = rows.unionByName(open_.select("at", "allowance", F.lit("reserved").alias("status"), F.lit(None).cast("long").alias("observed")))
    of = lambda status, c: F.coalesce(F.sum(F.when(F.col("status") == status, F.col(c))), F.lit(0)).cast("long")
    return rows.groupBy(F.to_date("at").alias("day")).agg(
        F.sum("allowance").alias("reserved"), of("settled", "observed").alias("observed"), of("unknown", "allowance").alias("unknown_reserved"), of("reserved", "allowance").alias("outstanding"), F.count("*").alias("attempts")
    )


# --- admission, one request after the other ------------------------------------------------------

class Admission:
    """What one key has used. A refused request spends nothing; the clock never goes back."""

    __slots__ = ("day", "day_used", "total", "high")

    def __init__(self, day: int = -1, day_used: int = 0, total: int = 0, high: int = -(1 << 62)):
        self.day, self.day_used, self.total, self.high = day, day_used, total, high

    def admit(self, at_us: int, asked: int, day_cap: int, total_cap: int, from_us: int, until_us: int, revoked_us: int | None) -> tuple[str, int]:
        """Outcome of one request and what it is granted: all that is asked, or as much as is left in whole blocks of 64."""
        if at_us < self.high:
            return "clock_rollback", 0
        self.high = at_us
        if revoked_us is not None and at_us >= revoked_us:
            return "read_consent_revoked", 0
        if not from_us <= at_us < until_us:
            return "read_consent_expired", 0
        day = at_us // DAY_US
        used = self.day_used if day == self.day else 0
        left = min(day_cap - used, total_cap - self.total)
        grant = min(asked, max(left, 0))
        if grant < asked:
            grant -= grant % 64
        if grant == 0 and asked > 0:
            return ("lifetime_byte_limit" if self.total >= total_cap else "daily_byte_limit" if used >= day_cap else "durable_quantum"), 0
        self.day, self.day_used, self.total = day, used + grant, self.total + grant
        return "admitted", grant


def folded(rows: DataFrame, key: str, order: list[str], values: list[str], output: StructType, start, step) -> DataFrame:
    """Rows of a key taken one after the other: ``step(state, *values)`` gives the next state and the output's columns.

    Each row depends on all before it, so a key is one stream. Its rows are sorted by Spark, which
    spills, and folded batch by batch with the key's state carried along: a task holds one batch and one
    state, however many rows a key has.
    """
    ship(rows.sparkSession)
    kept = [key, *order]
    sorted_ = rows.select(*kept, *values).repartition(key).sortWithinPartitions(key, *order)
    schema = StructType([rows.schema[c] for c in kept] + output.fields)
    arrow = to_arrow_schema(schema)
    width = len(output.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, begun = None, None, False
        for batch in batches:
            out = []
            for k, *given in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in range(len(kept), batch.num_columns))):
                if not begun or k != own:
                    own, state, begun = k, start(), True
                state, found = step(state, *given)
                out.append(found)
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [[]] * width, list(arrow)[len(kept) :])]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).cast(arrow.field(i).type) for i in range(len(kept))], *columns], schema=arrow)

    return sorted_.mapInArrow(run, schema)


REQUEST = ["at_us", "asked", "day_cap", "total_cap", "from_us", "until_us", "revoked_us"]


def admissions(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Requests (key, at_us, asked, day_cap, total_cap, from_us, until_us, revoked_us) decided one after the other within their key."""

    def step(state: Admission, *values) -> tuple[Admission, tuple]:
        outcome, granted = state.admit(*values)
        return state, (outcome, granted, state.day_used, state.total)

    output = StructType([StructField("outcome", StringType()), *[StructField(c, LongType()) for c in ("granted", "day_used", "total_used")]])
    return folded(requests, key, order, REQUEST, output, Admission, step)


# --- requested refreshes ---------------------------------------------------------------------------


def next_phase(phase: str, witness: int, kind: str, generation: int | None, ok: bool) -> tuple[str, int]:
    """Phase of a requested refresh after an event, and the generation of the root's listing that was witnessed (0: none).

    A request opens a refresh unless one is open; a drained root activates it; a listing read to its
    end is its witness; a restart before that loses it; and at the end it is completed only if the
    root's complete listing is still the witnessed one.
    """
    if kind == "request" and phase in ("none", "completed", "unknown"):
        return "pending", 0
    if kind == "activate" and phase == "pending" and ok:
        return "active", 0
    if phase == "active":
        if kind == "witness" and generation:
            return phase, generation
        if kind == "restart" and not witness:
            return "unknown", 0
        if kind == "finalize":
            return ("completed" if ok and witness and witness == generation else "unknown"), witness
    return phase, witness


QUALIFICATIONS = {"active": "historical_root_listing_pending", "completed": "historical_pass_completed", "unknown": "activation_lineage_unknown"}


def refresh_phases(events: DataFrame) -> DataFrame:
    """Phase of each root's requested refresh after each of its events (root_id, at, kind, generation, ok)."""

    def step(state: tuple[str, int], kind, generation, ok) -> tuple[tuple[str, int], tuple]:
        state = next_phase(*state, kind, generation, bool(ok))
        return state, (state[0], QUALIFICATIONS.get(state[0], ""))

    output = StructType([StructField("phase", StringType()), StructField("qualification", StringType())])
    return folded(events, "root_id", ["at"], ["kind", "generation", "ok"], output, lambda: ("none", 0), step)


# --- paced dispatch, records kept once -------------------------------------------------------------


def dispatches(requests: DataFrame, key: str, interval_us: int, daily: int) -> DataFrame:
    """Requests (key, ordinal, at_us) for one chunk of work each, decided one after the other: a pause after each, so many a day.

    The day only goes forward: a clock that runs back keeps the saved day and is told last, whatever else
    would defer the request.
    """

    def step(state: tuple, at: int) -> tuple[tuple, tuple]:
        day, used, last, then = state
        today = at // DAY_US
        own, spent = (day, used) if day >= today else (today, 0)
        reason = "cadence" if at < then else ""
        reason = "daily_chunk_limit" if spent >= daily else reason
        reason = "clock_rollback" if at < last else reason
        if reason:
            return state, (reason, spent)
        return (own, spent + 1, at, at + interval_us), ("dispatched", spent + 1)

    output = StructType([StructField("outcome", StringType()), StructField("used", LongType())])
    return folded(requests, key, ["ordinal"], ["at_us"], output, lambda: (-1, 0, -(1 << 62), -(1 << 62)), step)


MAX_DISMISSALS = 128


def dismissal_history(requests: DataFrame, key: str = "store", capacity: int = MAX_DISMISSALS) -> DataFrame:
    """Requests (store, ordinal, action, request_id) to dismiss a finding or undo that, and what becomes of each.

    A store keeps ``capacity`` records, undone ones included. Saving one that is there changes nothing: one that was
    undone stays undone. The state of a store is its records, so it is bounded.
    """

    def step(state: dict, action: str, request: str) -> tuple[dict, tuple]:
        known = state.get(request)
        if action == "undo":
            if known is None:
                return state, ("not_found", len(state))
            state[request] = "undone"
            return state, ("undone", len(state))
        if known is None and len(state) >= capacity:
            return state, ("capacity_reached", len(state))
        state.setdefault(request, "dismissed")
        return state, (state[request], len(state))

    output = StructType([StructField("state", StringType()), StructField("records", LongType())])
    return folded(requests, key, ["ordinal"], ["action", "request_id"], output, dict, step)


def kept_selections(requests: DataFrame) -> DataFrame:
    """Requests (store, ordinal, payload) to keep a selection: a store's first stands, the same again is the same, another conflicts."""
    named = requests.withColumn("selection_id", F.sha2("payload", 256))
    first = named.groupBy("store").agg(F.min(F.struct("ordinal", "selection_id")).alias("_first"))
    state = F.when(F.col("ordinal") == F.col("_first.ordinal"), "created").when(F.col("selection_id") == F.col("_first.selection_id"), "existing").otherwise("conflict")
    return named.join(first, "store").select("store", "ordinal", F.col("_first.selection_id").alias("selection_id"), state.alias("state"))


def late_observations(observations: DataFrame, key: str, lateness_us: int) -> DataFrame:
    """Observations (key, ordinal, at_us) in the order they came, with those too far behind the latest of their key told as rolled back instead of dropped."""
    before = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    high = F.max("at_us").over(before)
    return observations.select(key, "ordinal", "at_us", F.when(F.coalesce(F.col("at_us") < high - lateness_us, F.lit(False)), "clock_rollback").otherwise("accepted").alias("state"))


LIFETIME_US = DAY_US


def plan_history(requests: DataFrame, key: str = "plan_id", lifetime_us: int = LIFETIME_US) -> DataFrame:
    """Requests (plan_id, ordinal, action, at_us) to save, approve, revoke or use a plan, and what becomes of each.

    A plan is saved once and approved once, for ``lifetime_us``; approving it again changes nothing, not even when the
    approval has run out. A revocation is for good. A plan can be used while it is approved.
    """

    def told(state: dict, at: int) -> str:
        if "revoked" in state:
            return "revoked"
        if "approved" not in state:
            return "pending"
        return "approved" if at < state["approved"] + lifetime_us else "expired"

    def step(state: dict, action: str, at: int) -> tuple[dict, tuple]:
        if action == "save":
            known = "saved" in state
            state.setdefault("saved", at)
            return state, (told(state, at), "existing" if known else "created")
        if "saved" not in state:
            return state, ("absent", "refused")
        before = told(state, at)
        if action == "approve" and before == "pending":
            state["approved"] = at
            return state, ("approved", "recorded")
        if action == "revoke" and before in ("approved", "expired"):
            state["revoked"] = at
            return state, ("revoked", "recorded")
        if action == "use":
            return state, (before, "allowed" if before == "approved" else "refused")
        return state, (before, "existing" if (action, before) in (("approve", "approved"), ("revoke", "revoked")) else "refused")

    output = StructType([StructField("state", StringType()), StructField("result", StringType())])
    return folded(requests, key, ["ordinal"], ["action", "at_us"], output, dict, step)
