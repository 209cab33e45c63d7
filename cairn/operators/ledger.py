"""Quotas, reservations, charges and revisits in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import paths
from cairn.functions.scalars import cpu_wait, cpu_wait_capped

DAY_HOURS, WEEK_HOURS = 24, 168


def daily_quota(reservations: DataFrame, limit: int, by: list[str]) -> DataFrame:
    """Each request with what its day had granted before it, and whether it still fits; requests that do not fit are charged too, as allowances are reserved up front."""
    order = Window.partitionBy(*by).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("allowance").over(order), F.lit(0))
    return reservations.withColumn("before", before).withColumn("admitted", F.col("before") + F.col("allowance") <= limit)


def reservation_totals(reservations: DataFrame) -> DataFrame:
    """Reserved, settled, unknown and outstanding allowances of each day and, with a null day, of all."""
    part = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.col("allowance"))), F.lit(0))
    return reservations.rollup("day").agg(
        F.sum("allowance").alias("reserved"), part("settled").alias("settled"), part("unknown").alias("unknown"), part("reserved").alias("outstanding"), F.count("*").alias("attempts")
    )


def cpu_backoff(windows: DataFrame) -> DataFrame:
    """The pause after each window, and whether it reaches the cap."""
    wait = cpu_wait(F.col("cpu_ns"), F.col("elapsed_ns"))
    return windows.withColumn("wait_ns", wait).withColumn("capped", cpu_wait_capped(F.col("cpu_ns"), F.col("elapsed_ns")))


def adaptive_revisits(passes: DataFrame) -> DataFrame:
    """Streak and interval after each pass: two quiet passes in a row make the interval a week. The first pass counts as unknown."""
    order = Window.partitionBy("user_id").orderBy("day")
    nth = F.row_number().over(order)
    quiet = ~F.col("changed") & ~F.col("unknown") & (nth > 1)
    rows = passes.withColumn("_quiet", quiet)
    broken = F.sum((~F.col("_quiet")).cast("int")).over(order)
    rows = rows.withColumn("_island", broken)
    streak = F.least(F.sum(F.col("_quiet").cast("int")).over(Window.partitionBy("user_id", "_island").orderBy("day")), F.lit(2))
    return rows.withColumn("streak", streak.cast("int")).withColumn("interval_hours", F.when(F.col("streak") == 2, WEEK_HOURS).otherwise(DAY_HOURS))


def revisit_status(revisits: DataFrame) -> DataFrame:
    """Roots by their last pass: weekly, daily, changed, unknown."""
    last = revisits.groupBy("user_id").agg(F.max_by(F.struct("changed", "unknown", "streak"), "day").alias("l"))
    return last.agg(
        F.count("*").alias("roots"),
        F.count_if(F.col("l.streak") == 2).alias("weekly"),
        F.count_if(F.col("l.streak") < 2).alias("daily"),
        F.count_if("l.changed").alias("changed"),
        F.count_if("l.unknown").alias("unknown"),
    )


def changed_since_last(observations: DataFrame) -> DataFrame:
    """Each observation against the one before of its key; the first is a change."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag(F.struct("event_type", "value")).over(order)
    return observations.withColumn("changed", ~before.eqNullSafe(F.struct("event_type", "value")))


#: What one observation of an entry is compared in with the one before.
OBSERVED = ("kind", "size", "allocated", "mtime_ns", "ctime_ns", "device", "inode", "skip_reason")


def comparable(entry: str) -> Column:
    """Whether an observation (a struct column) is well formed, so that equality means something."""
    at = lambda c: F.col(f"{entry}.{c}")
    sane = at("kind").isin("file", "directory", "symlink", "other") & (at("size") >= 0) & (at("allocated") >= 0) & at("skip_reason").isin("", "excluded or protected")
    return F.coalesce(sane & paths.is_unsigned(at("device"), positive=True) & paths.is_unsigned(at("inode"), positive=True) & at("mtime_ns").isNotNull() & at("ctime_ns").isNotNull(), F.lit(False))


def entry_changes(saved: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Each observed entry against the saved one: a new one is changed; one of two that is malformed leaves the comparison unknown."""
    old, new = saved.select(*key, F.struct(*OBSERVED).alias("old")), observed.select(*key, F.struct(*OBSERVED).alias("new"))
    changed = F.col("old").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    unknown = ~comparable("new") | (F.col("old").isNotNull() & ~comparable("old"))
    return new.join(old, key, "left").select(*key, changed.alias("changed"), unknown.alias("unknown"))


def latest_observation(observations: DataFrame) -> DataFrame:
    """The last observation of each key by time and id."""
    return observations.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("l"), F.count("*").alias("observed")).select(
        "user_id", "l.event_id", "l.event_type", "l.value", "observed"
    )


def fixed_revisits(roots: DataFrame, pending: DataFrame, now: int, interval: int) -> DataFrame:
    """When roots without pending work are due again: an interval after their last pass, not before now."""
    idle = roots.join(pending.select("root_id").distinct(), "root_id", "left_anti")
    return idle.select("root_id", F.greatest(F.lit(now), F.col("last_pass") + interval).alias("due"))


def valid_consents(consents: DataFrame, revocations: DataFrame, used: DataFrame, now: int) -> DataFrame:
    """Consents that are neither expired, revoked nor used up, with what is left of them."""
    spent = used.groupBy("consent_id").agg(F.sum("bytes").alias("spent"))
    live = consents.where((F.col("from_ns") <= now) & (F.col("until_ns") > now)).join(revocations.select("consent_id"), "consent_id", "left_anti")
    left = F.col("max_bytes") - F.coalesce("spent", F.lit(0))
    return live.join(spent, "consent_id", "left").withColumn("left_bytes", left).where("left_bytes > 0").select("consent_id", "left_bytes")
