"""Scalar rules of the ledgers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
STEP_BYTES, GRAIN = 1 << 20, 64


def cpu_wait(cpu_ns: Column, elapsed_ns: Column, cap_ns: int = HOUR_NS) -> Column:
    """Idle time after which the window's share is one per cent, with a cap; none for a negative share or a window that has no length."""
    wait = F.lit(100).cast("decimal(38,0)") * cpu_ns - elapsed_ns
    return F.when((cpu_ns < 0) | (elapsed_ns <= 0), F.lit(0)).otherwise(F.least(F.greatest(wait, F.lit(0)), F.lit(cap_ns))).cast("long")


def cpu_wait_capped(cpu_ns: Column, elapsed_ns: Column, cap_ns: int = HOUR_NS) -> Column:
    """Whether the wait would be longer than its cap."""
    return (cpu_ns >= 0) & (elapsed_ns > 0) & (F.lit(100).cast("decimal(38,0)") * cpu_ns - elapsed_ns > cap_ns)


def pacing_cost(nbytes: Column, rate: int) -> Column:
    """Nanoseconds that so many bytes take at a rate, rounded up."""
    return F.ceil(nbytes.cast("decimal(38,0)") * 1_000_000_000 / rate).cast("long")


def pacing_fits(least: Column, rate: int, window_ns: Column) -> Column:
    """Whether the least read, of 64 bytes at most, takes no more than a quarter of the time left; nothing to read always fits. Null where the figures make no sense."""
    sane = (least >= 0) & (least <= GRAIN) & (window_ns >= 0) & (window_ns <= 5_000_000_000)
    return F.when(sane, (least == 0) | (pacing_cost(least, rate) <= F.floor(window_ns / 4)))


def read_grant(wanted: Column, day_left: Column, lifetime_left: Column, file_left: Column) -> Column:
    """Bytes of one step; a step that does not finish its file ends on a whole grain."""
    most = F.least(wanted, day_left, lifetime_left, file_left, F.lit(STEP_BYTES))
    return F.when(most >= file_left, most).otherwise(most - most % GRAIN).cast("long")


def human_bytes(n: int) -> str:
    """A size for people."""
    value, unit = float(n), "B"
    for unit in ("B", "KiB", "MiB", "GiB", "TiB", "PiB"):
        if value < 1024 or unit == "PiB":
            break
        value /= 1024
    return f"{n} B" if unit == "B" else f"{value:.1f} {unit}"


UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def human_size(size: Column, largest: str = UNITS[-1]) -> Column:
    """A size for people, as a column: whole bytes, else one digit after the point; no unit beyond the ``largest``."""
    last = UNITS.index(largest)
    nth = F.when(size < 1024, 0)
    for i in range(1, last):
        nth = nth.when(size < 1024 ** (i + 1), i)
    nth = nth.otherwise(last)
    value = F.format_string("%.1f", F.bround(size.cast("double") / F.pow(F.lit(1024.0), nth), 1))  # halves go to the even digit
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(value, F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in UNITS]), (nth + 1).cast("int"))))
