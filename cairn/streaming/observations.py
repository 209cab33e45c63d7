"""Observations as streams: upserts by micro-batch, daily totals with late rows counted, and revisit state by key."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.reconcile import upsert
from cairn.operators.sessions import QUALIFICATIONS, next_phase


class LatestTable:
    """A table of the last row of each key, kept by micro-batch.

    Keys are dealt to ``parts`` by their hash. A batch rewrites the parts that it touches, all in one write
    of Spark's committer, into a folder named by the batch. The current folder of a part is that of the
    highest batch that was written whole and holds it, found in the store itself, so a table opened again
    after a restart goes on from there. A batch run again after a failure starts from the folders of
    earlier batches and writes its own again. ``clean`` deletes what later batches have replaced.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], parts: int = 16):
        self.spark, self.path, self.key, self.order, self.parts = spark, path.rstrip("/"), key, order, parts

    def _store(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        return hadoop, root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self, before: int | None = None) -> dict[int, dict[int, str]]:
        """Folders by part of the batches that were written whole, of those before one."""
        hadoop, root, store = self._store()
        found: dict[int, dict[int, str]] = {}
        for status in store.listStatus(root) if store.exists(root) else []:
            match = re.fullmatch(r"batch-(\d+)", status.getPath().getName())
            if match and (before is None or int(match[1]) < before) and store.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
                names = [s.getPath().getName() for s in store.listStatus(status.getPath())]
                found[int(match[1])] = {int(n[6:]): f"{self.path}/batch-{match[1]}/{n}" for n in names if n.startswith("_part=")}
        return found

    def _folders(self, before: int | None = None) -> dict[int, str]:
        """Each part's last folder."""
        found: dict[int, str] = {}
        for _, own in sorted(self._batches(before).items()):
            found |= own
        return found

    def read(self, before: int | None = None) -> DataFrame | None:
        folders = [f for _, f in sorted(self._folders(before).items())]
        return self.spark.read.parquet(*folders) if folders else None

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        part = F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(part).distinct().collect()]  # ``parts`` numbers at most
            if not touched:
                return
            folders = [f for p, f in sorted(self._folders(batch_id).items()) if p in touched]
            saved = self.spark.read.schema(batch.schema).parquet(*folders) if folders else batch.limit(0)
            merged = upsert(saved, batch, self.key, self.order).withColumn("_part", part)
            merged.repartition(len(touched), "_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/batch-{batch_id:010d}")
        finally:
            batch.unpersist()

    def clean(self) -> int:
        """Delete the folders that no part's current folder is; returns how many. Readers of an earlier state must be done."""
        hadoop, _, store = self._store()
        current = set(self._folders().values())
        old = [f for own in self._batches().values() for f in own.values() if f not in current]
        for folder in old:
            store.delete(hadoop.Path(folder), True)
        return len(old)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_observations(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Observations as they arrive in a folder; the saved time has no zone and is read as the session's."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Allowances of each UTC day; rows later than the watermark are dropped by Spark and show in the query's progress."""
    allowance = F.col("event_id") % 64 + 1
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum(allowance).alias("reserved"), F.count("*").alias("attempts")).select(
        F.col("w.start").cast("date").alias("day"), "reserved", "attempts"
    )


REVISIT = "user_id long, day date, streak int, interval_hours int, rollback boolean"


def revisit_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Streak after each pass of one key. A pass before the last one saved is reported as a rollback and changes nothing."""
    streak, last = state.get if state.exists else (-1, "")
    rows = []
    for day, changed, unknown in sorted(row for b in batches for row in zip(b["day"], b["changed"], b["unknown"])):
        text = str(day)
        if text <= last:
            rows.append((key[0], day, max(streak, 0), 168 if streak == 2 else 24, True))
            continue
        first = streak < 0
        streak, last = (0 if first or changed or unknown else min(2, streak + 1)), text
        rows.append((key[0], day, streak, 168 if streak == 2 else 24, False))
    state.update((streak, last))
    yield pd.DataFrame(rows, columns=["user_id", "day", "streak", "interval_hours", "rollback"])


def revisit_stream(passes: DataFrame) -> DataFrame:
    """Revisit state of each user from a stream of passes (user_id, day, changed, unknown)."""
    return passes.groupBy("user_id").applyInPandasWithState(revisit_step, REVISIT, "streak int, last string", "append", GroupStateTimeout.NoTimeout)


REFRESH = "root_id long, at long, phase string, qualification string"


def refresh_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Phase after each event (at, kind, generation, ok) of one root; only phase and witness are kept."""
    phase, witness = state.get if state.exists else ("none", 0)
    rows = []
    for at, kind, generation, ok in sorted(row for b in batches for row in zip(b["at"], b["kind"], b["generation"], b["ok"])):
        phase, witness = next_phase(phase, int(witness), kind, None if pd.isna(generation) else int(generation), bool(ok))
        rows.append((key[0], at, phase, QUALIFICATIONS.get(phase, "")))
    state.update((phase, witness))
    yield pd.DataFrame(rows, columns=["root_id", "at", "phase", "qualification"])


def refresh_stream(events: DataFrame) -> DataFrame:
    """Phases of requested refreshes from a stream of events (root_id, at, kind, generation, ok)."""
    return events.groupBy("root_id").applyInPandasWithState(refresh_step, REFRESH, "phase string, witness long", "append", GroupStateTimeout.NoTimeout)
