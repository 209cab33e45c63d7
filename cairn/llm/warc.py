"""WARC archives with a two-level capture index.

Pages become records of WARC files, one gzip member for each record. Of pages with equal payloads
the one with the largest id is a ``response`` and the others are ``revisit`` records that refer to
it. Spark writes the archives through its committer, each as one row (name, bytes) in a row group
of its own, so a lost executor's half-written archives are never seen and a reader skips all
archives but those named.

The index has one entry for each record: reversed-host key, archive, offset, length. Entries are
range-sorted and packed into compressed blocks; the sparse directory holds one row for each block.
A lookup searches the directory for each key, the keys of a block are then searched in it at once,
and of an archive only the bytes of the wanted ranges are unpacked. A lookup of few urls
(``read_urls``) reads the archives by name and moves none of them; the round trip of all pages looks
every page's url up in the same way and meets the archives by a join.

Which record answers for equal payloads is decided on (id, digest, size) rows alone: groups are
aggregated before the shuffle, joined in ``SALTS`` parts, and the answer is joined to the payloads
by page, so copies of one page never meet in one task.

A null html is an empty payload. A null url has the empty key and no target header. Repeated rows
with equal ids and payloads are all written as the response. Pages without an id are written too;
they are a response only if no page with an id has their payload. An empty table gives an empty
result. A payload is one row's cell: one of hundreds of MB takes a few times that in a worker. Extra
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import arrow_schema, frugal, materialise

ARCHIVE_BYTES = 4 << 20
BLOCK_ENTRIES = 512
#: The directory is searched in memory, some hundred bytes a row; blocks grow when it would have more rows.
DIRECTORY_ROWS = 100_000
#: Parts that the copies of one payload are joined in.
SALTS = 16
#: Archives that ``read_urls`` names in its scan at most; beyond, it joins.
NAMED_ARCHIVES = 1000
#: WARC dates name the capture; these tables have none, so a fixed one keeps archives reproducible.
CAPTURED = "2000-01-01T00:00:00Z"


def reversed_host_key(url: str | None) -> str:
    """Sort key of a url: host labels from right to left, then port, path and query; scheme, user and fragment are left out."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return f")/{url}"
    labels = ",".join(reversed(host.split(".")))
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{query}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {CAPTURED}"]
    if url:
        lines.append(f"WARC-Target-URI: {quote(url, safe=chr(33) + '#$%&()*+,-./:;=?@[]_~' + chr(39))}")
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP header and payload of one record; the digests of what is there are checked."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return headers, http, payload


@dataclass
class Collection:
    archives: DataFrame  # archive, bytes
    blocks: DataFrame  # block, first_key, last_key, entries, data
    block_entries: int


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


ARCHIVE = "archive string, bytes binary, captures array<struct<key:string,offset:long,length:long>>"


def write_collection(pages: DataFrame, min_payload: int = 0) -> Collection:
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    pages = pages.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    names = pages.where(F.col("n") >= min_payload).select("page_id", "digest", "n")
    copied = names.groupBy("digest", "n").agg(F.max("page_id").alias("response_id"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
    copied = copied.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = names.distinct().withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    answers = named.join(copied, ["digest", "n", "_salt"]).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("n").alias("_n"), "response_id")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n"))
    pages = pages.join(answers.hint("shuffle_hash"), same, "left").select("page_id", "url", "payload", "response_id")
    schema = arrow_schema(ARCHIVE)

    def write(batches):
        part, seq, size, members, captures = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            for page, url, payload, response in zip(*(batch.column(i) for i in range(4))):
                page, url, response = page.as_py(), url.as_py(), response.as_py()
                member = record(page, url, payload.as_py(), response, response is not None and response != page)
                captures.append({"key": reversed_host_key(url), "offset": size, "length": len(member)})
                members.append(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    yield _batch(schema, [(f"part-{part:06d}-{seq:06d}.warc.gz", b"".join(members), captures)])
                    seq, size, members, captures = seq + 1, 0, [], []
        if members:
            yield _batch(schema, [(f"part-{part:06d}-{seq:06d}.warc.gz", b"".join(members), captures)])

    archives = materialise(pages.mapInArrow(frugal(write), ARCHIVE), "warc-archives", options={"parquet.block.size": str(ARCHIVE_BYTES)})
    entries = archives.select("archive", F.explode("captures").alias("c")).select("c.key", "archive", "c.offset", "c.length")
    per_block = max(BLOCK_ENTRIES, -(-archives.agg(F.sum(F.size("captures"))).first()[0] // DIRECTORY_ROWS) if archives.head(1) else 0)
    out = "block string, first_key string, last_key string, entries int, data binary"
    block_schema = arrow_schema(out)

    def pack(batches):
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def close(rows):
            nonlocal seq
            data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode(), 6)
            seq += 1
            return (f"{part:06d}-{seq - 1:09d}", rows[0][0], rows[-1][0], len(rows), data)

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            full = len(held) // per_block * per_block
            if full:
                yield _batch(block_schema, [close(held[i : i + per_block]) for i in range(0, full, per_block)])
                held = held[full:]
        if held:
            yield _batch(block_schema, [close(held)])

    ordered = entries.repartitionByRange("key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    return Collection(archives.select("archive", "bytes"), materialise(ordered.mapInArrow(frugal(pack), out), "warc-index"), per_block)


CAPTURE = "key string, archive string, offset long, length long"


def find(collection: Collection, keys: DataFrame) -> DataFrame:
    """Entries of the index for the keys asked for (column ``key``), each once.

    The directory, ``DIRECTORY_ROWS`` rows at most, is searched in the tasks; the keys of a block
    meet it by its name and are searched in it.
    """
    directory = collection.blocks.select("first_key", "last_key", "block").orderBy("first_key", "last_key", "block").collect()
    shared = keys.sparkSession.sparkContext.broadcast(([r.first_key for r in directory], [r.last_key for r in directory], [r.block for r in directory]))
    asked_schema, schema = arrow_schema("block string, key string"), arrow_schema(CAPTURE)

    def blocks_of(batches):
        first, last, names = shared.value
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                i = bisect_left(last, key)
                while i < len(first) and first[i] <= key:
                    rows.append((names[i], key))
                    i += 1
            yield _batch(asked_schema, rows)

    def search(batches):
        for batch in batches:
            for data, wanted in zip(batch.column(0), batch.column(1)):
                rows = [json.loads(line) for line in zlib.decompress(data.as_py()).decode().split("\n")]
                found = []
                for key in wanted.as_py():
                    i = bisect_left(rows, key, key=lambda r: r[0])
                    while i < len(rows) and rows[i][0] == key:
                        found.append(tuple(rows[i]))
                        i += 1
                yield _batch(schema, found)

    asked = keys.select("key").distinct().mapInArrow(blocks_of, "block string, key string").groupBy("block").agg(F.collect_list("key").alias("keys"))
    return collection.blocks.select("block", "data").join(asked, "block").select("data", "keys").mapInArrow(frugal(search), CAPTURE)


def with_keys(urls: DataFrame) -> DataFrame:
    """(url, key) of the different urls."""
    schema = arrow_schema("url string, key string")

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reversed_host_key(u) for u in batch.column(0).to_pylist()], pa.string())], schema=schema)

    return urls.select("url").distinct().mapInArrow(keys, "url string, key string")


def lookup(collection: Collection, urls: DataFrame) -> DataFrame:
    """Entries of the index for the urls asked for (column ``url``)."""
    asked = with_keys(urls)
    return asked.join(find(collection, asked), "key").select("url", "key", "archive", "offset", "length")


def read_urls(collection: Collection, urls: DataFrame) -> DataFrame:
    """The records of some urls: archives are read by name where they are, their ranges come with the task."""
    entries = materialise(find(collection, with_keys(urls)), "warc-found")
    names = [r.archive for r in entries.select("archive").distinct().limit(NAMED_ARCHIVES + 1).collect()]
    if len(names) > NAMED_ARCHIVES:
        return read_records(collection, entries)
    ranges = entries.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    named = collection.archives.where(F.col("archive").isin(names))
    return _records(named.join(F.broadcast(ranges), "archive"))  # NAMED_ARCHIVES rows at most, each below its archive


def read_records(collection: Collection, entries: DataFrame) -> DataFrame:
    """The records of index entries: each archive is met by the list of ranges wanted of it."""
    ranges = entries.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    return _records(collection.archives.join(ranges.hint("merge"), "archive"))


def _records(met: DataFrame) -> DataFrame:
    out = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    schema = arrow_schema(out)

    def number(urn: str) -> int | None:
        digits = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def read(batches):
        for batch in batches:
            for data, ranges in zip(batch.column(0), batch.column(1)):
                view, rows = memoryview(data.as_buffer()), []
                for r in ranges.as_py():
                    headers, http, payload = parse(view[r["offset"] : r["offset"] + r["length"]])
                    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind == "response" and digest != payload_digest(payload):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                    refers = number(headers["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), int(fields["Content-Length"]), digest, kind, refers, payload))
                yield _batch(schema, rows)

    return met.select("bytes", "ranges").mapInArrow(frugal(read), out)


def page_records(pages: DataFrame) -> DataFrame:
    """Each page as its record reads after a round trip: found by its url through directory and block, read by its range."""
    collection = write_collection(pages)
    found = read_records(collection, find(collection, with_keys(pages)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export_archives(collection: Collection, folder: str) -> list[str]:
    """Write the archives as files to a folder on this machine, one at a time."""
    from pathlib import Path

    names = []
    for name, data in collection.archives.toLocalIterator():
        (Path(folder) / name).write_bytes(data)
        names.append(name)
    return sorted(names)
