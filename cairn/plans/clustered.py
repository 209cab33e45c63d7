"""Relations stored in the order of their paths, so that a subtree is a pruned scan and a purge rewrites only the files it meets."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.sources.written import written

#: Tops that are sent to the manifest to find the files that they meet; for more, all files are read.
MAX_TOPS = 1000


class ClusteredTable:
    """A relation with root_id and a path column, range-sorted into files; a manifest tells each file's first and last key.

    A version is a manifest written whole by Spark's committer; it names the files that count, so a write
    or a purge that broke off changes nothing and old readers keep what they read. The manifest is a
    table with a row for each file. ``path_column`` is the column that a subtree is told by.
    """

    MANIFEST = "file string, rows long, first_root long, first_path binary, last_root long, last_path binary"

    def __init__(self, spark: SparkSession, folder: str, path_column: str = "path"):
        self.spark, self.folder, self.column = spark, folder.rstrip("/"), path_column
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    def version(self) -> int:
        """The last whole version; -1 without one."""
        root = self.hadoop.Path(self.folder)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [-1]
        for status in store.listStatus(root) if store.exists(root) else []:
            match = re.fullmatch(r"manifest-(\d+)", status.getPath().getName())
            if match and store.exists(self.hadoop.Path(status.getPath(), "_SUCCESS")):
                found.append(int(match[1]))
        return max(found)

    def manifest(self) -> DataFrame:
        version = self.version()
        return self.spark.read.schema(self.MANIFEST).parquet(f"{self.folder}/manifest-{version:08d}") if version >= 0 else self.spark.createDataFrame([], self.MANIFEST)

    def _write_rows(self, rows: DataFrame, files: int) -> DataFrame:
        """New files of rows, and their manifest rows."""
        data = f"{self.folder}/data-{uuid.uuid4().hex}"
        ordered = rows.repartitionByRange(max(files, 1), "root_id", self.column).sortWithinPartitions("root_id", self.column)
        ordered.write.parquet(data)
        key = F.struct(F.col("root_id").cast("long").alias("root_id"), F.col(self.column).alias("path"))
        found = self.spark.read.schema(rows.schema).parquet(data).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), F.min(key).alias("a"), F.max(key).alias("b"))
        return found.select("file", "rows", F.col("a.root_id").alias("first_root"), F.col("a.path").alias("first_path"), F.col("b.root_id").alias("last_root"), F.col("b.path").alias("last_path"))

    def _publish(self, manifest: DataFrame) -> None:
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest-{self.version() + 1:08d}")

    def write(self, rows: DataFrame, files: int) -> None:
        """All rows anew, in about so many files."""
        self.schema = rows.schema
        rows.limit(0).write.mode("overwrite").parquet(f"{self.folder}/schema")
        self._publish(self._write_rows(rows, files))

    def _files(self, manifest: DataFrame) -> list[str]:
        return [r.file for r in manifest.select("file").orderBy("file").toLocalIterator()]

    def _rows(self, files: list[str]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/schema").schema
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._rows(self._files(self.manifest()))

    @staticmethod
    def _bounds(top: bytes) -> tuple[bytes, bytes]:
        """First key of a subtree, the top itself, and the first key beyond all below it."""
        return (b"", b"\xff" * 8) if top == b"." else (top, top + b"0")

    def _met(self, tops: list[tuple[int, bytes]]) -> DataFrame:
        """Files whose keys may hold a top or something below it; the names between a top and its children lie in no subtree but in the range."""
        low = lambda t: F.struct(F.lit(t[0]).cast("long"), F.lit(self._bounds(t[1])[0]))
        high = lambda t: F.struct(F.lit(t[0]).cast("long"), F.lit(self._bounds(t[1])[1]))
        ranges = F.array(*[F.struct(low(t).alias("low"), high(t).alias("high")) for t in tops])
        first, last = F.struct("first_root", "first_path"), F.struct("last_root", "last_path")
        # keys of a file meet the range, as bytes
        return self.manifest().where(F.exists(ranges, lambda r: (first <= r["high"]) & (last >= r["low"])))

    def subtree(self, root: int, top: bytes) -> DataFrame:
        """Rows of one subtree, from the files that may hold them; within these the range prunes row groups."""
        met = self._met([(root, top)])
        return self._rows(self._files(met)).where((F.col("root_id") == root) & paths.in_subtree(F.col(self.column), top))

    def _near(self, tops: DataFrame) -> list[str]:
        """Files that may hold something at or below the tops (root_id, path): pruned for some tops, all for many, which meet most files anyway."""
        asked = [(r.root_id, bytes(r.path)) for r in tops.limit(MAX_TOPS + 1).collect()]
        if not asked:
            return []
        return self._files(self._met(asked) if len(asked) <= MAX_TOPS else self.manifest())

    def _named(self, rows: DataFrame) -> DataFrame:
        """Each row once for itself and for each directory above it, as text in ``_name``; so what lies below a top is found by an equi-join."""
        path = F.col(self.column)
        return rows.withColumn("_name", F.explode(F.concat(paths.ancestors(path), F.array(paths.as_text(path)))))

    def subtrees(self, tops: DataFrame) -> DataFrame:
        """Rows at or below any number of tops (root_id, path), each with its top in ``_top``."""
        asked = tops.select("root_id", "path").distinct()
        known = asked.select("root_id", paths.as_text(F.col("path")).alias("_name"), F.col("path").alias("_top"))
        rows = self._rows(self._near(asked))
        return self._named(rows).join(known, ["root_id", "_name"]).select(*rows.columns, "_top")

    def purge(self, tops: DataFrame, keep_anchor: bool | None = False) -> dict[str, int]:
        """Without what lies below any number of tops (root_id, path) and, unless ``keep_anchor``, the tops themselves; with None their column of that name decides.

        Returns how many files there were, were read and were written. A file that a top's range meets without holding any
        row of its subtree stays as it is.
        """
        keep = F.col("keep_anchor") if keep_anchor is None else F.lit(keep_anchor)
        asked = tops.select("root_id", "path", keep.alias("keep_anchor")).groupBy("root_id", "path").agg(F.bool_and("keep_anchor").alias("_keep"))
        if asked.isEmpty():
            raise ValueError("a top is needed")
        if not asked.where(F.col("path") == F.lit(b".")).isEmpty():
            raise ValueError("a root is not purged as a subtree")
        total, met = self.manifest().count(), self._near(asked)
        known = asked.select("root_id", paths.as_text(F.col("path")).alias("_name"), "_keep")
        below = (F.col("_name") != paths.as_text(F.col(self.column))) | ~F.col("_keep")
        keys = self._named(self._rows(met).select("root_id", self.column, F.input_file_name().alias("_file")))
        doomed = written(keys.join(known, ["root_id", "_name"]).where(below).select("root_id", self.column, "_file").distinct(), "doomed")
        hit = [r[0] for r in doomed.select("_file").distinct().collect()]  # of the files read
        if hit:
            kept = self._rows(hit).join(doomed.select("root_id", self.column), ["root_id", self.column], "left_anti")
            renewed = self._write_rows(kept, len(hit))
            stays = self.manifest().where(~F.col("file").isin(hit)) if len(hit) <= 100 else self.manifest().join(self.spark.createDataFrame([(h,) for h in hit], "file string"), "file", "left_anti")
            self._publish(stays.select("file", "rows", "first_root", "first_path", "last_root", "last_path").unionByName(renewed))
        return {"files": total, "read": len(met), "rewritten": len(hit)}


def purge_relations(tables: dict[str, ClusteredTable], tops: DataFrame) -> dict[str, dict[str, int]]:
    """Subtrees (root_id, path, keep_anchor) taken out of every relation; an anchor that is kept stays among the entries only.

    The other relations say what was found below a directory, so there the directory itself goes too. Entries go
    last: a purge that broke off is found again by the anchors that still stand.
    """
    return {n: tables[n].purge(tops, None if n == "entries" else False) for n in sorted(tables, key=lambda n: n == "entries")}
