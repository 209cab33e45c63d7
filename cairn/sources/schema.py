"""Relations of the inventory, declared once; readers fail on anything else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 1

RELATIONS: dict[str, str] = {
    "roots": "id long, path binary, enabled boolean, volume_id string, last_scan_ns long, last_error string",
    "entries": "id long, root_id long, path binary, parent binary, kind string, size long, allocated long, mtime_ns long, ctime_ns long, device string, inode string, generation long, observed_at_ns long, skip_reason string",
    "directories": "root_id long, path binary, generation long, complete boolean, checked_at_ns long, last_error string",
    "compact_dirs": "root_id long, path binary, generation long, logical long, files long, unknown_inodes long, skipped_files long",
    "compact_inodes": "root_id long, path binary, generation long, device string, inode string, allocated long, logical long, paths long, conflicting boolean",
    "revisions": "root_id long, revision long, scan_revision long",
    "jobs": "id long, root_id long, kind string, path binary, status string, due_at_ns long, cursor binary, attempts int, lease_token string, lease_until_ns long",
    "hash_work": "work_id string, file_id long, root_id long, path binary, size long, sha256 string, status string, device string, inode string, ctime_ns long, mtime_ns long, allocated long",
    "reservations": "token string, scope string, day string, allowance long, status string, observed long",
    "cpu_windows": "ts_ns long, cpu_ns long, elapsed_ns long, reason string",
    "passes": "root_id long, epoch long, changed boolean, unknown boolean, finished_ns long",
    "dismissals": "id string, request_id string, payload string",
    "dismissal_undos": "dismissal_id string",
    "journal_events": "intent_id string, sequence int, id string, predecessor_id string, kind string, outcome string",
}


def relation(name: str) -> StructType:
    return StructType.fromDDL(RELATIONS[name])


def read_relation(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A saved relation; its stored columns and types must be those declared."""
    found = spark.read.parquet(f"{store}/{name}.parquet")
    want = [(f.name, f.dataType) for f in relation(name)]
    if [(f.name, f.dataType) for f in found.schema] != want:
        raise ValueError(f"{name} has another schema than version {SCHEMA_VERSION}: {found.schema.simpleString()}")
    return found


def write_relation(df: DataFrame, store: str, name: str, mode: str = "errorifexists") -> None:
    df.select(*relation(name).names).write.mode(mode).parquet(f"{store}/{name}.parquet")


MAX_REPORT_BYTES, MAX_REPORT_FILES = 1 << 20, 20


def read_report(spark: SparkSession, path: str, schema: StructType, files: str = "files") -> DataFrame:
    """Files that a JSON report (one document a line) names in its array ``files``, for a selection: refused unless the report has exactly the fields declared, in place, is small and names 1 to 20 files."""
    lines = spark.read.text(path)
    size, count = lines.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)), F.count("*")).first()
    if count != 1 or size > MAX_REPORT_BYTES:
        raise ValueError("a report is one document of at most 1 MiB")
    told = lines.select("value", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    # written again from the declared fields it must be what was read: nothing more, less, twice or in another place
    same = told.select(F.to_json("r", {"ignoreNullFields": "false"}) == F.col("value"), F.size(F.col(f"r.{files}"))).first()
    if not same[0] or not 1 <= (same[1] or 0) <= MAX_REPORT_FILES:
        raise ValueError("a report has other fields than declared, or names no or too many files")
    return told.select(F.inline(F.col(f"r.{files}")))


def dataset_checks(spark: SparkSession, store: str, key: dict[str, list[str]]) -> DataFrame:
    """Health of a saved store's relations: there, written whole, readable, of the declared schema, with rows, keys set and unique; a check after one that failed is not made."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = []
    for name, columns in sorted(key.items()):
        folder = hadoop.Path(f"{store}/{name}.parquet")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

        def schema_fits(name=name) -> bool:
            return [(f.name, f.dataType) for f in spark.read.parquet(f"{store}/{name}.parquet").schema] == [(f.name, f.dataType) for f in relation(name)]

        def counted(condition, name=name):
            return spark.read.schema(relation(name)).parquet(f"{store}/{name}.parquet").agg(condition).first()[0]

        unset = F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) > 0)
        checks = [
            ("exists", lambda: files.exists(folder)),
            ("written_whole", lambda: files.exists(hadoop.Path(folder, "_SUCCESS"))),
            ("readable", lambda: spark.read.parquet(folder.toString()).schema is not None),
            ("schema", schema_fits),
            ("has_rows", lambda: counted(F.count("*")) > 0),
            ("keys_set", lambda: counted(unset) == 0),
            ("keys_unique", lambda: counted(F.count("*") - F.count_distinct(F.struct(*columns))) == 0),
        ]
        failed = False
        for check, test in checks:
            status = "not_checked"
            if not failed:
                try:
                    status = "ok" if test() else "failed"
                except Exception:  # whatever keeps a relation from being read
                    status = "failed"
                failed = status == "failed"
            out.append((name, check, status))
    return spark.createDataFrame(out, "relation string, check string, status string")
