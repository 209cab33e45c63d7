"""A directory tree as a stream whose offset is a place inside the tree.

Directories are taken in the order of their paths, parents first, and their children in the order of
their names; an offset is a directory and the last name told of it. A batch tells ``children`` children, of
one directory or of several. The driver reads names only, to find where a batch ends; tasks look at the
children themselves. A query that was killed goes on from its checkpoint, in the middle of a directory
too. Names that turn up before the place where the scan stands are left for the next scan.

Options: ``path``, ``children`` (128) and ``exclude``, paths below the root between NUL characters.
Names are compared as bytes; excluded and foreign directories are told and not entered.
"""

from __future__ import annotations

import heapq
import os
import stat
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cairn.shipping import ship
from cairn.sources import filesystem

FORMAT = "cairn_scan"
#: The place before the first child of the root, and the one after the last of all.
START, DONE = {"directory": "2e", "after": "", "done": False}, {"directory": "", "after": "", "done": True}


@dataclass
class Segment(InputPartition):
    """Children of a directory whose names lie after one and not after another; the last segment of a directory ends its listing."""

    directory: bytes
    after: bytes
    last: bytes
    ends: bool

    def __init__(self, directory: bytes, after: bytes, last: bytes, ends: bool):
        super().__init__((directory, after, last, ends))
        self.directory, self.after, self.last, self.ends = directory, after, last, ends


class Walk:
    """The order of a tree: what follows a place."""

    def __init__(self, top: bytes, excluded: frozenset[bytes]):
        self.top, self.excluded = top, excluded
        self.device = os.lstat(top).st_dev

    def names(self, directory: bytes, after: bytes, limit: int) -> list[bytes]:
        """The names of children after one, ``limit`` of them and one to look ahead; none of a directory that is gone."""
        try:
            with os.scandir(os.path.join(self.top, directory)) as found:
                return heapq.nsmallest(limit + 1, (e.name for e in found if e.name > after))
        except OSError:
            return []

    def first_below(self, directory: bytes, after: bytes) -> bytes | None:
        """The first directory to enter below one whose name follows ``after``."""

        def enters(name: bytes) -> bool:
            path = name if directory == b"." else directory + b"/" + name
            if name in filesystem.EXCLUDED_NAMES or path in self.excluded:
                return False
            try:
                found = os.lstat(os.path.join(self.top, path))
            except OSError:
                return False
            return stat.S_ISDIR(found.st_mode) and found.st_dev == self.device

        try:
            with os.scandir(os.path.join(self.top, directory)) as found:
                name = min((e.name for e in found if e.name > after and enters(e.name)), default=None)
        except OSError:
            return None
        return name if name is None or directory == b"." else directory + b"/" + name

    def following(self, directory: bytes) -> bytes | None:
        """The directory after one that is told to its end: its first child, or the next of a sibling or of one above."""
        found = self.first_below(directory, b"")
        while found is None and directory != b".":
            parent, name = os.path.split(directory)
            directory = parent or b"."
            found = self.first_below(directory, name)
        return found

    def advance(self, offset: dict, children: int) -> tuple[list[Segment], dict]:
        """The segments of the next batch from an offset, and where it ends."""
        if offset["done"]:
            return [], offset
        directory, after, left, out = bytes.fromhex(offset["directory"]), bytes.fromhex(offset["after"]), children, []
        while True:
            names = self.names(directory, after, left)
            ends = len(names) <= left
            last = names[-1] if ends and names else names[left - 1] if names else after
            out.append(Segment(directory, after, last, ends))
            left -= min(len(names), left)
            if not ends:
                return out, {"directory": directory.hex(), "after": last.hex(), "done": False}
            found = self.following(directory)
            if found is None:
                return out, DONE
            directory, after = found, b""
            if left == 0 or len(out) >= children:
                return out, {"directory": directory.hex(), "after": "", "done": False}


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.top = os.fsencode(options["path"])
        self.children = int(options.get("children", filesystem.BATCH))
        self.excluded = frozenset(os.fsencode(p) for p in options.get("exclude", "").split("\0") if p)
        self.place: dict | None = None
        self.planned: tuple[dict, dict, list[Segment]] | None = None

    def walk(self) -> Walk:
        return Walk(self.top, self.excluded)

    def initialOffset(self) -> dict:
        return START

    def latestOffset(self) -> dict:
        start = self.place or START
        segments, end = self.walk().advance(start, self.children)
        self.planned, self.place = (start, end, segments), end
        return end

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.place = self.place or end  # a query begun again plans its last batch first
        if start == end:
            return []
        if self.planned and self.planned[:2] == (start, end):
            return self.planned[2]
        # a batch planned before the query was killed: its segments are found again up to its end
        out, at, walk = [], start, self.walk()
        while at != end and not at["done"]:
            segments, at = walk.advance(at, 1 if end["done"] is False else self.children)
            out += segments
            if self._beyond(at, end):
                break
        return self._cut(out, end)

    @staticmethod
    def _key(directory: bytes, name: bytes) -> tuple:
        return (tuple(directory.split(b"/")) if directory != b"." else (), name)

    def _beyond(self, at: dict, end: dict) -> bool:
        if end["done"] or at["done"]:
            return at["done"]
        place = lambda o: self._key(bytes.fromhex(o["directory"]), bytes.fromhex(o["after"]))
        return place(at) >= place(end)

    def _cut(self, segments: list[Segment], end: dict) -> list[Segment]:
        """Segments up to an end; names of the last directory beyond it belong to the next batch."""
        if end["done"]:
            return segments
        directory, after = bytes.fromhex(end["directory"]), bytes.fromhex(end["after"])
        out = []
        for s in segments:
            if s.directory == directory:
                if s.after < after:
                    out.append(Segment(s.directory, s.after, min(s.last, after), False))
            elif self._key(s.directory, b"") < self._key(directory, b""):
                out.append(s)
        return out

    def read(self, partition: Segment):
        top, device = self.top, os.lstat(self.top).st_dev
        rows, fault, names = [], "", []
        try:
            with os.scandir(os.path.join(top, partition.directory)) as found:
                names = sorted(e.name for e in found if partition.after < e.name <= partition.last)
        except OSError as failed:
            fault = os.strerror(failed.errno) if failed.errno else "listing failed"
        for name in names:
            try:
                rows.append(filesystem.observe(top, name if partition.directory == b"." else partition.directory + b"/" + name, device, self.excluded))
            except FileNotFoundError:  # gone since it was planned
                continue
        if partition.ends:
            rows.append((partition.directory, b"", filesystem.LISTING, None, None, None, None, None, None, fault))
        columns = zip(*rows) if rows else [[] for _ in filesystem.FIELDS]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, filesystem.FIELDS)], schema=filesystem.FIELDS)


class TreeScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return filesystem.DDL

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def scan_stream(spark: SparkSession, root: str, children: int = filesystem.BATCH, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The stream of a tree's rows; rows of kind ``listing`` end a directory and tell its fault, if any, in their skip_reason."""
    ship(spark)
    spark.dataSource.register(TreeScan)
    return spark.readStream.format(FORMAT).option("path", root).option("children", children).option("exclude", "\0".join(exclude)).load()
