"""Framed digests and sample windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 32 << 10


def big_endian(n: Column) -> Column:
    """A number as eight bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def sample_windows(size: Column, window: int = WINDOW) -> Column:
    """(start, length) of the first, middle and last window of so many bytes; windows that overlap or touch are one."""
    raw = F.when(size <= 0, F.array().cast("array<struct<start:bigint,length:bigint>>"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.cast("long").alias("length")))
    middle = F.floor((size - window) / 2)
    three = F.array(*[F.struct(s.cast("long").alias("start"), F.lit(window).cast("long").alias("length")) for s in (F.lit(0), middle, size - window)])
    two = F.array(
        F.struct(F.lit(0).cast("long").alias("start"), (middle + window).cast("long").alias("length")),
        F.struct((size - window).cast("long").alias("start"), F.lit(window).cast("long").alias("length")),
    )
    return raw.when(size <= 3 * window, whole).when(middle <= window, two).otherwise(three)


def sample_digest(content: Column, domain: str, window: int = WINDOW) -> Column:
    """SHA-256 over the domain, the size, the number of windows, and offset, length and bytes of each."""
    size = F.octet_length(content)
    windows = sample_windows(size, window)
    frame = lambda acc, w: F.concat(acc, big_endian(w["start"]), big_endian(w["length"]), F.substring(content, (w["start"] + 1).cast("int"), w["length"].cast("int")))
    head = F.concat(F.lit(domain.encode()), big_endian(size), big_endian(F.size(windows)))
    return F.sha2(F.aggregate(windows, head, frame), 256)


def root_fingerprint(path: Column, volume: Column, device: Column, inode: Column) -> Column:
    return F.concat(F.lit("v1:"), F.sha2(F.concat_ws(":", F.lower(F.hex(path)), volume, device, inode), 256))
