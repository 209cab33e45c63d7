"""Sessions, reservations and admissions as streams, with the rules of their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.sessions import Admission, settle_condition

CHARGE = "session long, ordinal long, at_us long, charged_ns long, outcome string, reason string"
SESSION = "cpu long, ordinal long, high_us long, ended boolean"


def sample_step(state: tuple | None, ordinal: int, at: int, cpu: int | None, elapsed: int | None, reason: str | None) -> tuple[tuple, tuple]:
    """State of a session after a sample, and the sample's row without its session."""
    last, nth, high, ended = state or (None, None, None, False)
    first = state is None
    booked = at if first else max(at, high)
    if ended:
        return (last, ordinal, booked, True), (ordinal, booked, 0, "refused", None)
    if not first and at < high:
        fault = "cpu_clock_rollback"
    elif cpu is None:
        fault = reason or "cpu_unknown"
    elif cpu < 0:
        fault = "cpu_observation_invalid"
    elif not first and (elapsed is None or elapsed <= 0):
        fault = "elapsed_window_invalid"
    elif not first and cpu < last:
        fault = "cpu_observation_regressed"
    else:
        return (cpu, ordinal, booked, False), (ordinal, booked, cpu - (0 if first else last), "charged", None)
    return (last if cpu is None else cpu, ordinal, booked, True), (ordinal, booked, 0, "unknown", fault)


def session_stream(samples: DataFrame, idle_us: int, lateness: str = "1 minute") -> DataFrame:
    """Charges of a stream of samples (session, ordinal, at, at_us, cpu_ns, elapsed_ns, reason), ``at`` being the event time.

    A session without a fault that the watermark leaves ``idle_us`` behind is closed by a timer: a further
    row for its last sample tells it as recovered and unknown, and later samples are refused.
    """
    nothing = lambda v: None if pd.isna(v) else v

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CHARGE.split(", ")]
        if state.hasTimedOut:
            cpu, ordinal, high, _ = state.get
            state.update((cpu, ordinal, high, True))
            yield pd.DataFrame([(key[0], ordinal, high, 0, "recovered_unknown", "interrupted_session")], columns=columns)
            return
        own = state.get if state.exists else None
        rows = []
        for sample in sorted((r for b in batches for r in zip(b["ordinal"], b["at_us"], b["cpu_ns"], b["elapsed_ns"], b["reason"])), key=lambda r: r[0]):
            ordinal, at, cpu, elapsed, reason = sample
            cpu, elapsed = nothing(cpu), nothing(elapsed)
            own, row = sample_step(own, int(ordinal), int(at), cpu if cpu is None else int(cpu), elapsed if elapsed is None else int(elapsed), nothing(reason))
            rows.append((key[0], *row))
        state.update(own)
        if not own[3]:
            state.setTimeoutTimestamp(max((own[2] + idle_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=columns)

    marked = samples.withWatermark("at", lateness).groupBy("session")
    return marked.applyInPandasWithState(step, CHARGE, SESSION, "append", GroupStateTimeout.EventTimeTimeout)


def reservation_stream(reservations: DataFrame, settlements: DataFrame, window_us: int, lateness: str = "1 minute") -> DataFrame:
    """Reservations with the settlements that belong to them, as both arrive; one whose time has passed without comes out as unknown.

    An outer join of two streams under watermarks: state is kept for the window only. A reservation
    settled more than once has a row for each; the first by time is the one that counts, as in the batch form.
    """
    r, s = reservations.withWatermark("at", lateness).alias("r"), settlements.withWatermark("at", lateness).alias("s")
    valid = (F.col("s.observed") >= 0) & (F.col("s.observed") <= F.col("r.allowance"))
    joined = r.join(s, settle_condition(window_us) & valid, "leftOuter")
    observed = F.col("s.observed")
    return joined.select("r.token", "r.at", "r.allowance", F.when(observed.isNull(), "unknown").otherwise("settled").alias("status"), observed.alias("observed"), F.col("s.at").alias("settled_at"))


def admission_stream(requests: DataFrame, key: str, order: str) -> DataFrame:
    """Outcomes of a stream of requests (key, order, and what ``Admission.admit`` takes), one after the other within their key; only what is used is kept."""
    names = ["at_us", "asked", "day_cap", "total_cap", "from_us", "until_us", "revoked_us"]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Admission(*state.get) if state.exists else Admission()
        rows = []
        for nth, *values, revoked in sorted((r for b in batches for r in zip(b[order], *(b[c] for c in names))), key=lambda r: r[0]):
            outcome, granted = own.admit(*(int(v) for v in values), None if pd.isna(revoked) else int(revoked))
            rows.append((k[0], nth, outcome, granted, own.day_used, own.total))
        state.update((own.day, own.day_used, own.total, own.high))
        yield pd.DataFrame(rows, columns=[key, order, "outcome", "granted", "day_used", "total_used"])

    ddl = f"{key} {requests.schema[key].dataType.simpleString()}, {order} {requests.schema[order].dataType.simpleString()}, outcome string, granted long, day_used long, total_used long"
    return requests.groupBy(key).applyInPandasWithState(step, ddl, "day long, day_used long, total long, high long", "append", GroupStateTimeout.NoTimeout)
