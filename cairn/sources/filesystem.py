"""A directory tree as rows, step by step and resumable inside directories; links are never followed."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.shipping import ship

#: Names whose contents are not listed.
EXCLUDED_NAMES = (b".git", b".Trash", b".Trashes", b".snapshots", b"Backups.backupdb")
#: Children of a directory that are told at once, and of one piece of work; kinds of the rows that end a listing or say where it goes on.
BATCH, STEP, LISTING, CURSOR = 128, 100_000, "listing", "cursor"
#: Directories, and places inside directories, that a task has at a time where there are many.
PLACES_OF_TASK = 64
FIELDS = pa.schema(
    [
        ("path", pa.binary()), ("parent", pa.binary()), ("kind", pa.string()), ("size", pa.int64()), ("allocated", pa.int64()), ("mtime_ns", pa.int64()),
        ("ctime_ns", pa.int64()), ("device", pa.string()), ("inode", pa.string()), ("skip_reason", pa.string()),
    ]
)
DDL = "path binary, parent binary, kind string, size long, allocated long, mtime_ns long, ctime_ns long, device string, inode string, skip_reason string"


def observe(top: bytes, path: bytes, device: int, excluded: frozenset[bytes] = frozenset()) -> tuple:
    """A row for one path below the root; ``excluded`` holds paths, not names."""
    found = os.lstat(os.path.join(top, path))
    kind = "directory" if stat.S_ISDIR(found.st_mode) else "symlink" if stat.S_ISLNK(found.st_mode) else "file" if stat.S_ISREG(found.st_mode) else "other"
    left_out = os.path.basename(path) in EXCLUDED_NAMES or path in excluded
    skip = "excluded or protected" if left_out else "mount boundary" if found.st_dev != device else ""
    return (path, os.path.dirname(path) or b".", kind, max(found.st_size, 0), max(found.st_blocks * 512, 0), found.st_mtime_ns, found.st_ctime_ns, str(found.st_dev), str(found.st_ino), skip)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, FIELDS)], schema=FIELDS)


def list_directory(top: bytes, directory: bytes, device: int, excluded: frozenset[bytes], limit: int | None = None) -> Iterator[list[tuple]]:
    """Rows of the children of one directory, ``limit`` of them, in batches of ``BATCH``.

    Then one of kind ``listing`` that tells the fault, if any, in its skip_reason. Where more children follow there
    are rows of kind ``cursor`` instead, each with the names of ``limit`` of them for ``list_names``. A directory
    is read once, in its own order, and no more names than ``limit`` are held.
    """
    names, first, fault = [], None, ""
    try:
        with os.scandir(os.path.join(top, directory)) as found:
            for entry in found:
                if limit and len(names) == limit:
                    if first is None:
                        first = names
                    else:
                        yield [_cursor(directory, names)]
                    names = []
                names.append(entry.name)
    except OSError as failed:
        fault = os.strerror(failed.errno) if failed.errno else "listing failed"
    if first is not None:
        yield [_cursor(directory, names, True, fault)]
    yield from _observed(top, directory, names if first is None else first, device, excluded)
    if first is None:
        yield [_end(directory, fault)]


def list_names(top: bytes, directory: bytes, names: bytes, device: int, excluded: frozenset[bytes], last: bool, fault: str) -> Iterator[list[tuple]]:
    """Rows of the children that a cursor names, and of kind ``listing`` after the last cursor of a directory."""
    yield from _observed(top, directory, names.split(b"/"), device, excluded)
    if last:
        yield [_end(directory, fault)]


def _cursor(directory: bytes, names: list[bytes], last: bool = False, fault: str = "") -> tuple:
    return (directory, b"/".join(names), CURSOR, int(last), None, None, None, None, None, fault)


def _end(directory: bytes, fault: str) -> tuple:
    return (directory, b"", LISTING, None, None, None, None, None, None, fault)


def _observed(top: bytes, directory: bytes, names: list[bytes], device: int, excluded: frozenset[bytes]) -> Iterator[list[tuple]]:
    for at in range(0, len(names), BATCH):
        rows = []
        for name in names[at : at + BATCH]:
            try:
                rows.append(observe(top, name if directory == b"." else directory + b"/" + name, device, excluded))
            except FileNotFoundError:  # gone since it was listed
                continue
        yield rows


def scan_tree(spark: SparkSession, root: str, store: str, parallel: int = 8, exclude: tuple[bytes, ...] = (), step: int | None = STEP, steps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries and listing passes of everything below a root that executors can reach.

    The work of a step is directories, and places inside directories: at most ``step`` children of each
    are told. A directory with more is read once; the names of the others are left as places for the next
    step, so there are twice as many steps as levels at most, however large a directory is. Steps are
    written below ``store``, so a scan that was broken off goes on from its last whole step, inside a
    large directory as well, and nothing is held in memory. ``steps`` ends a call after so many steps; a
    later call goes on. ``parallel`` is the least number of tasks of a step.
    """
    ship(spark)
    top, excluded = os.fsencode(root), frozenset(exclude)
    device = os.lstat(top).st_dev

    def list_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for directory, names, last, fault in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found = list_directory(top, directory, device, excluded, step) if names is None else list_names(top, directory, names, device, excluded, bool(last), fault)
                for rows in found:
                    yield _batch(rows)

    hadoop = spark._jvm.org.apache.hadoop.fs
    work, folders, begun = spark.createDataFrame([(bytearray(b"."), None, None, None)], "path binary, names binary, last long, fault string"), [], 0
    places = 1
    while steps is None or begun < steps:
        folder = f"{store.rstrip('/')}/step-{len(folders):06d}"
        done = hadoop.Path(folder, "_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            work.repartition(max(parallel, min(100_000, -(-places // PLACES_OF_TASK)))).mapInArrow(list_step, DDL).write.mode("overwrite").parquet(folder)
            begun += 1
        folders.append(folder)
        found = spark.read.schema(DDL).parquet(folder)
        below = found.where((F.col("kind") == "directory") & (F.col("skip_reason") == "")).select("path", F.lit(None).cast("binary").alias("names"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("string").alias("fault"))
        work = below.union(found.where(F.col("kind") == CURSOR).select("path", F.col("parent").alias("names"), F.col("size").alias("last"), F.col("skip_reason").alias("fault")))
        places = work.count()
        if not places:
            break
    rows = spark.read.schema(DDL).parquet(*folders)
    passes = rows.where(F.col("kind") == LISTING).select("path", (F.col("skip_reason") == "").alias("complete"), F.col("skip_reason").alias("last_error"))
    return rows.where(~F.col("kind").isin(LISTING, CURSOR)), passes
