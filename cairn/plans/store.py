"""Append-only, content-addressed records and their exports."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.reconcile import same_contents

MAX_RECORDS = 128
#: Age from which the claim of a version that never came is given up.
CLAIM_SECONDS = 600


class Conflict(Exception):
    """Another writer took the next version first."""


@dataclass
class RecordStore:
    """Records (id, payload) of one kind. An id is the digest of its payload; nothing is updated or deleted.

    Versions are folders that each hold all records, ``MAX_RECORDS`` at most. A writer prepares the
    next version aside and takes its name by a rename that fails if the name is there, so of two
    writers one starts again from the other's version and the bound and the ids hold.
    """

    spark: SparkSession
    path: str
    prefix: str

    def _store(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        return hadoop, root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last version; 0 without any."""
        _, root, store = self._store()
        names = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
        return max((int(n[8:]) for n in names if n.startswith("version-")), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], "id string, payload string")
        return self.spark.read.schema("id string, payload string").parquet(f"{self.path}/version-{version:010d}")

    def append(self, payloads: DataFrame, attempts: int = 5) -> DataFrame:
        """New records for payloads not yet saved; refused if the store would hold more than it may."""
        records = payloads.select(F.concat(F.lit(self.prefix), F.sha2("payload", 256)).alias("id"), "payload").dropDuplicates(["id"])
        for _ in range(attempts):
            try:
                self._publish(records)
                return records
            except Conflict:
                continue
        raise Conflict(f"{attempts} attempts met other writers")

    def _publish(self, records: DataFrame) -> None:
        version = self.version()
        saved = self.read(version)
        rows = saved.unionByName(records.join(saved.select("id"), "id", "left_anti")).limit(MAX_RECORDS + 1).collect()
        if len(rows) > MAX_RECORDS:
            raise ValueError(f"a store holds {MAX_RECORDS} records")
        hadoop, root, store = self._store()
        aside = f"{self.path}/.writing-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, "id string, payload string").coalesce(1).write.parquet(aside)
        claim = hadoop.Path(root, f".claim-{version + 1:010d}")
        if not store.createNewFile(claim):  # one writer gets it
            store.delete(hadoop.Path(aside), True)
            abandoned = store.exists(claim) and time.time() - store.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS
            if abandoned and self.version() == version:  # its writer ended before it published
                store.delete(claim, False)
            raise Conflict
        if not store.rename(hadoop.Path(aside), hadoop.Path(root, f"version-{version + 1:010d}")):
            store.delete(claim, False)
            raise Conflict

    def is_valid(self) -> bool:
        """Every id is the digest of its payload, and none is there twice."""
        rows = self.read()
        wrong = rows.where(F.col("id") != F.concat(F.lit(self.prefix), F.sha2("payload", 256)))
        return wrong.isEmpty() and rows.groupBy("id").count().where("count > 1").isEmpty()


def manifest(rows: DataFrame) -> DataFrame:
    """One row for an export: how many rows, and a digest that does not depend on their order."""
    each = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    low = F.conv(F.substring(each, 1, 15), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(each, 16, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.coalesce(F.sum(low), F.lit(0)).cast("string"), F.coalesce(F.sum(high), F.lit(0)).cast("string")), 256).alias("digest"))


def export(rows: DataFrame, path: str) -> None:
    """A copy of a table and its manifest."""
    rows.write.parquet(f"{path}/rows")
    manifest(rows.sparkSession.read.parquet(f"{path}/rows")).write.parquet(f"{path}/manifest")


def verify_export(spark: SparkSession, path: str, source: DataFrame | None = None) -> bool:
    """Whether an export still matches its manifest, and its source if one is given."""
    rows = spark.read.parquet(f"{path}/rows")
    intact = manifest(rows).first() == spark.read.parquet(f"{path}/manifest").first()
    return intact and (source is None or same_contents(rows, source))
