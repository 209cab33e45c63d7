"""Contents of files by byte range: three-window samples and whole digests of saved files.

Files are rows (id, path, size, mtime_ns, ctime_ns, device, inode) that executors can open. A sample
plans one row for each window and deals the windows, not the files, to tasks; a task seeks, reads that
range and nothing else, so a file costs at most 96 KiB however large it is. A whole digest streams the
file in steps of 1 MiB. Before and after a range is read the file must still be the saved object,
with its size and times; otherwise it is blocked with the reason and has no digest.
"""

from __future__ import annotations

import hashlib
import os
import stat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import digests
from cairn.functions.evidence import differ
from cairn.shipping import ship

STEP = 1 << 20
#: Windows, or whole files, that a task has at a time.
RANGES_OF_TASK = 10_000
#: Rows, and bytes of contents, that go back to Spark at once.
ROWS_OF_BATCH, BYTES_OF_BATCH = 1000, 4 << 20
EVIDENCE = ("size", "mtime_ns", "ctime_ns", "device", "inode")
_RANGE = "id long, start long, length long, content binary, code string, requested long, read long"
_WHOLE = "id long, sha256 string, code string, requested long, read long"


class Blocked(Exception):
    """A file is not, or no longer, what was saved of it."""


def _same(fd: int, saved: tuple) -> None:
    found = os.fstat(fd)
    if not stat.S_ISREG(found.st_mode):
        raise Blocked("not_regular_file")
    if (found.st_size, found.st_mtime_ns, found.st_ctime_ns, str(found.st_dev), str(found.st_ino)) != saved:
        raise Blocked("file_changed")


def _pieces(path: bytes, saved: tuple, start: int, length: int, used: list[int]):
    """Yields a range of a saved file in steps; ``used`` gets the bytes asked for and read, also of reads that fail."""
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except FileNotFoundError:
        raise Blocked("missing") from None
    except OSError:
        raise Blocked("unreadable") from None
    try:
        _same(fd, saved)
        at, end = start, start + length
        while at < end:
            want = min(STEP, end - at)
            used[0] += want
            try:
                data = os.pread(fd, want, at)
            except OSError:
                raise Blocked("read_failed") from None
            used[1] += len(data)
            if len(data) != want:
                raise Blocked("read_incomplete")
            yield data
            at += want
        _same(fd, saved)
    finally:
        os.close(fd)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batches(rows, schema: pa.Schema):
    """Rows (tuples) as record batches; a row is sent alone only if it is as large as a batch."""
    held, size = [], 0
    content = schema.get_field_index("content")

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[content] or b"") if content >= 0 else 0
        if len(held) >= ROWS_OF_BATCH or size >= BYTES_OF_BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Rows dealt evenly; work, not files, decides how many tasks there are."""
    ship(rows.sparkSession)
    return rows.repartition(tasks or max(1, min(100_000, -(-rows.count() // RANGES_OF_TASK))))


def read_ranges(ranges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Ranges (id, path, start, length and the saved evidence) with their bytes, or why they were blocked."""
    schema = _schema(_RANGE)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                used, content, code = [0, 0], None, ""
                try:
                    content = b"".join(_pieces(row["path"], tuple(row[c] for c in EVIDENCE), row["start"], row["length"], used))
                except Blocked as why:
                    code = str(why)
                yield row["id"], row["start"], row["length"], content, code, *used

    def run(batches):
        return _batches(read(batches), schema)

    return _dealt(ranges.select("id", "path", "start", "length", *EVIDENCE), tasks).mapInArrow(run, _RANGE)


def sample_files(files: DataFrame, domain: str, window: int = digests.WINDOW, tasks: int | None = None) -> DataFrame:
    """Sample digest of each file (id, status, code, digest, requested, read): its windows read by range and framed in order.

    Equal digests do not mean equal files. Two rows that disagree about one object are both blocked
    before anything is read. An empty file has no window and the digest of its frame.
    """
    objects = files.groupBy("device", "inode").agg(differ("size", "mtime_ns", "ctime_ns").alias("_conflict"))
    judged = files.join(objects, ["device", "inode"], "left")
    plan = judged.where("not _conflict").select("id", "path", *EVIDENCE, F.explode_outer(digests.sample_windows(F.col("size"), window)).alias("w"))
    read = read_ranges(plan.where("w is not null").select("id", "path", F.col("w.start").alias("start"), F.col("w.length").alias("length"), *EVIDENCE), tasks)
    frame = F.struct("start", "length", "content")
    parts = read.groupBy("id").agg(F.array_sort(F.collect_list(frame)).alias("_parts"), F.max("code").alias("_code"), F.sum("requested").alias("requested"), F.sum("read").alias("read"))
    found = judged.select("id", "size", "_conflict").join(parts, "id", "left")
    code = F.when(F.col("_conflict"), "identity_conflict").otherwise(F.coalesce("_code", F.lit("")))
    body = F.coalesce("_parts", F.array().cast("array<struct<start:bigint,length:bigint,content:binary>>"))
    return found.select(
        "id", F.when(code == "", "complete").otherwise("blocked").alias("status"), code.alias("code"), F.when(code == "", framed_digest(domain, F.col("size"), body)).alias("digest"),
        F.coalesce("requested", F.lit(0)).cast("long").alias("requested"), F.coalesce("read", F.lit(0)).cast("long").alias("read"),
    )


def framed_digest(domain: str, size: Column, parts: Column) -> Column:
    """SHA-256 of the domain, the size, the number of parts, and offset, length and bytes of each part."""
    head = F.concat(F.lit(domain.encode()), digests.big_endian(size), digests.big_endian(F.size(parts)))
    return F.sha2(F.aggregate(parts, head, lambda acc, p: F.concat(acc, digests.big_endian(p["start"]), digests.big_endian(p["length"]), p["content"])), 256)


def hash_files(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """SHA-256 of each whole file (id, status, code, sha256, requested, read), streamed in steps; a step's bytes are all that is held.

    A digest is of one stream, so a file is one task's work; a task that is lost begins its file again.
    """
    schema = _schema(_WHOLE)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                used, digest, code = [0, 0], hashlib.sha256(), ""
                try:
                    for data in _pieces(row["path"], tuple(row[c] for c in EVIDENCE), 0, row["size"], used):
                        digest.update(data)
                except Blocked as why:
                    code = str(why)
                yield row["id"], None if code else digest.hexdigest(), code, *used

    def run(batches):
        return _batches(read(batches), schema)

    found = _dealt(files.select("id", "path", *EVIDENCE), tasks).mapInArrow(run, _WHOLE)
    return found.select("id", F.when(F.col("code") == "", "complete").otherwise("blocked").alias("status"), "code", "sha256", "requested", "read")


def write_files(rows: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """Rows (id, content, folder if there is one) as files that executors write below a folder they share, with what a scan would save of each. A task run again writes the same files.

    Rows are written where they are read, so that contents do not move; ``tasks`` deals them anew.
    """
    ddl = "id long, path binary, size long, mtime_ns long, ctime_ns long, device string, inode string"
    ship(rows.sparkSession)
    schema = _schema(ddl)
    top = os.fsencode(folder)

    def write(batches):
        made = set()
        for batch in batches:
            for id_, content, inner in zip(*(batch.column(i).to_pylist() for i in range(3))):
                folder = os.path.join(top, os.fsencode(inner))
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                path = os.path.join(folder, b"f%d" % id_)
                data = content or b""
                if not os.path.exists(path):
                    own = b"%s.%d" % (path, os.getpid())
                    with open(own, "wb") as out:
                        out.write(data)
                    os.utime(own, ns=(id_ * 10**9, id_ * 10**9))
                    os.replace(own, path)
                found = os.stat(path)
                yield id_, path, found.st_size, found.st_mtime_ns, found.st_ctime_ns, str(found.st_dev), str(found.st_ino)

    def run(batches):
        return _batches(write(batches), schema)

    inner = F.col("folder") if "folder" in rows.columns else F.lit("")
    found = rows.select("id", F.col("content").cast("binary").alias("content"), inner.alias("folder"))
    return (found.repartition(tasks) if tasks else found).mapInArrow(run, ddl)
