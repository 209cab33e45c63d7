"""Scope sums kept up to date by signed changes to an identity ledger.

The ledger counts, for every scope and object, how many paths show it with which figures. A change is
a row that left (-1) or came (+1); exploded to the scopes above it, it is added to the counts. What a
scope's sums gain or lose follows from the objects touched, before and after, so neither the other
objects nor the entries are read. Both tables lie in parts by hash, and an update reads and rewrites
the parts that its keys fall into.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.functions.evidence import differ
from cairn.sources.written import written

#: What a scope is told of; all are sums over rows or over objects.
SUMS = ("file_paths", "logical_bytes", "loose", "unknown_inodes", "objects", "linked", "repeated", "conflicting")
OBJECT = ["root_id", "scope", "device", "inode"]
FIGURES = ["allocated", "size"]


def live_files(entries: DataFrame, directories: DataFrame) -> DataFrame:
    """The files that their own directory's completed listing does not say are gone."""
    gone = directories.where("complete and last_error = ''").select("root_id", F.col("path").alias("parent"), F.col("generation").alias("_g"))
    rows = entries.where("kind = 'file'").join(gone, ["root_id", "parent"], "left")
    return rows.where("_g is null or _g = generation").select("root_id", "path", "parent", "size", "allocated", "device", "inode")


def signed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one table has and the other has not, repeats included, as changes of -1 and +1."""
    columns = before.columns
    both = before.withColumn("sign", F.lit(-1)).unionByName(after.select(*columns).withColumn("sign", F.lit(1)))
    return both.groupBy(*columns).agg(F.sum("sign").cast("long").alias("sign")).where("sign <> 0")


def _above(changes: DataFrame) -> DataFrame:
    """Changes summed by directory before they are exploded to its scopes."""
    kept = ["root_id", "parent", "device", "inode", *FIGURES]
    by_parent = changes.groupBy(*kept).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    scope = F.explode(F.concat(paths.ancestors(F.col("parent")), F.array(paths.as_text(F.col("parent"))))).alias("scope")
    return by_parent.select("root_id", scope, "device", "inode", *FIGURES, "sign")


def _figures(ledger: DataFrame) -> DataFrame:
    """What each object counts for in its scope."""
    held = ledger.where("n > 0").groupBy(*OBJECT).agg(F.max("allocated").alias("_a"), F.sum("n").alias("_n"), differ(*FIGURES).alias("_differ"))
    return held.select(*OBJECT, F.lit(1).cast("long").alias("objects"), F.col("_a").alias("linked"), (F.col("_n") - 1).alias("repeated"), F.col("_differ").cast("long").alias("conflicting"))


def update(ledger: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The touched rows of a ledger (root_id, scope, device, inode, allocated, size, n) after changes, and what the scopes' sums change by.

    Counts of no path are told as 0, so that the store can drop them. A count below 0 means that a change
    does not belong to this ledger, and raises.
    """
    rows = _above(changes)
    named = (F.col("device") != "") & (F.col("inode") != "")
    by_row = rows.groupBy("root_id", "scope").agg(
        F.sum("sign").alias("file_paths"), F.sum(F.col("sign") * F.col("size")).alias("logical_bytes"),
        F.sum(F.when(~named, F.col("sign") * F.col("allocated")).otherwise(0)).alias("loose"), F.sum(F.when(~named, F.col("sign")).otherwise(0)).alias("unknown_inodes"),
    )
    delta = written(rows.where(named).groupBy(*OBJECT, *FIGURES).agg(F.sum("sign").alias("n")).where("n <> 0"), "ledger-delta")
    before = written(ledger.join(delta.select(*OBJECT).distinct(), OBJECT, "left_semi").select(*OBJECT, *FIGURES, "n"), "ledger-touched")
    after = before.unionByName(delta).groupBy(*OBJECT, *FIGURES).agg(F.sum("n").alias("n"))
    after = after.withColumn("n", F.when(F.col("n") < 0, F.raise_error(F.lit("a change does not belong to this ledger"))).otherwise(F.col("n")).cast("long"))
    after = written(after, "ledger-after")
    figures = ["objects", "linked", "repeated", "conflicting"]
    minus = _figures(before).select("root_id", "scope", *[(-F.col(c)).alias(c) for c in figures])
    by_object = minus.unionByName(_figures(after).select("root_id", "scope", *figures)).groupBy("root_id", "scope").agg(*[F.sum(c).alias(c) for c in figures])
    both = by_row.join(by_object, ["root_id", "scope"], "full")
    return after, both.select("root_id", "scope", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SUMS])


class ScopeLedger:
    """A ledger and the scopes' sums below a folder, changed by numbered batches.

    Each table is dealt to parts by hash: the ledger by object, so that an object's scopes lie together, the
    sums by scope. A batch writes new folders for the parts that its keys fall into, named by part and
    batch; a part's current folder is that of the highest batch whose end is marked, so a batch that
    broke off is as if it had not been, and one run again writes the same.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    def _store(self):
        root = self.hadoop.Path(self.path)
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _ended(self, before: int | None) -> set[int]:
        root, store = self._store()
        names = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
        ended = {int(m[1]) for n in names if (m := re.fullmatch(r"end-(\d+)", n))}
        return {b for b in ended if before is None or b < before}

    def _folders(self, table: str, before: int | None = None) -> dict[int, str]:
        ended, found = self._ended(before), {}
        _, store = self._store()
        for batch in sorted(ended):
            folder = self.hadoop.Path(f"{self.path}/{table}-{batch:010d}")
            for status in store.listStatus(folder) if store.exists(folder) else []:
                if match := re.fullmatch(r"_part=(\d+)", status.getPath().getName()):
                    found[int(match[1])] = f"{folder.toString()}/{match[0]}"
        return found

    def _read(self, table: str, ddl: str, parts: set[int] | None = None, before: int | None = None) -> DataFrame:
        folders = [f for p, f in sorted(self._folders(table, before).items()) if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*folders).where("root_id is not null")  # parts without rows hold a row of nulls

    LEDGER = "root_id long, scope string, device string, inode string, allocated long, size long, n long"
    TOTALS = "root_id long, scope string, " + ", ".join(f"{c} long" for c in SUMS)

    def ledger(self, parts: set[int] | None = None, before: int | None = None) -> DataFrame:
        return self._read("ledger", self.LEDGER, parts, before)

    def sums(self, parts: set[int] | None = None, before: int | None = None) -> DataFrame:
        return self._read("sums", self.TOTALS, parts, before)

    def sizes(self) -> DataFrame:
        """The scopes' figures as the reports tell them; a scope without rows is gone."""
        allocated = F.col("loose") + F.col("linked")
        return self.sums().where("file_paths > 0").select("root_id", "scope", "file_paths", "logical_bytes", allocated.alias("allocated_bytes"), "unknown_inodes", "objects", "repeated", "conflicting")

    def _part(self, columns: list[str]):
        return F.pmod(F.xxhash64(*columns), F.lit(self.parts)).cast("int")

    def _touched(self, keys: DataFrame, columns: list[str]) -> set[int]:
        return {r[0] for r in keys.select(self._part(columns)).distinct().collect()}  # ``parts`` numbers at most

    def apply(self, changes: DataFrame, batch: int) -> dict[str, int]:
        """Changes (root_id, parent, size, allocated, device, inode, sign) as batch ``batch``; returns how many parts of each table were read and written."""
        changes = written(changes.select("root_id", "parent", "size", "allocated", "device", "inode", "sign"), "changes")
        objects, above = ["device", "inode"], _above(changes)
        parts = self._touched(changes.where("device <> '' and inode <> ''"), objects)
        held = self.ledger(parts, batch)
        after, delta = update(held, changes)
        delta = written(delta, "sums-delta")
        kept = held.join(after.select(*OBJECT, *FIGURES), [*OBJECT, *FIGURES], "left_anti")
        rows = kept.unionByName(after.where("n > 0")).withColumn("_part", self._part(objects))
        scopes = self._touched(above, ["root_id", "scope"])
        totals = self.sums(scopes, batch).unionByName(delta).groupBy("root_id", "scope").agg(*[F.sum(c).cast("long").alias(c) for c in SUMS]).withColumn("_part", self._part(["root_id", "scope"]))
        # parts that are left without rows must exist, or their last folders would stand
        empty = lambda ddl, own: self.spark.createDataFrame([(p,) for p in sorted(own)], "_part int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], ddl).schema], "_part")
        for table, found, ddl, own in (("ledger", rows, self.LEDGER, parts), ("sums", totals, self.TOTALS, scopes)):
            marked = found.unionByName(empty(ddl, own)) if own else found
            marked.repartition(max(1, min(len(own), self.parts)), "_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/{table}-{batch:010d}")
        _, store = self._store()
        store.create(self.hadoop.Path(f"{self.path}/end-{batch:010d}"), True).close()
        return {"ledger": len(parts), "sums": len(scopes)}
