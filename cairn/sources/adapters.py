"""Inventory relations derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: First modification time and one day, in nanoseconds.
EPOCH_NS, DAY_NS = 1_600_000_000_000_000_000, 86_400_000_000_000


#: Schemas of tables by session and path: a report reads a table in several places, and each would look into its files for the schema.
_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root for each language, numbered in its order; documents without one have the empty name."""
    langs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("lang")).distinct()
    numbered = langs.withColumn("root_id", F.dense_rank().over(Window.orderBy("lang")).cast("long"))  # a row for each language
    return numbered.select(F.col("root_id").alias("id"), "lang", F.concat(F.lit("/"), "lang").cast("binary").alias("path"), F.lit(True).alias("enabled"))


#: Columns of ``entries`` that need the first equal document, and those that need the text's digest.
OF_EQUALS, OF_DIGEST = {"mtime_ns", "ctime_ns", "inode"}, {"digest"}


def entries(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Documents as files, a null text being an empty one. Equal texts share an inode.

    Only what ``columns`` need is read, hashed and joined.
    """
    wanted = set(columns or ["id", "root_id", "digest", *OF_EQUALS])
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "source", F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("digest"), F.substring("source", 4, 10).cast("int").alias("n")
    )
    if wanted & OF_EQUALS:
        copies = d.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_copies")).where("_copies > 1").drop("_copies")
        d = d.join(copies, "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    if "root_id" in wanted:
        d = d.join(roots(spark, sf_dir).select(F.col("id").alias("root_id"), "lang"), "lang")
    parent = F.concat(F.col("source"), F.lit("/b"), F.col("doc_id") % 4, F.lit("/c"), F.col("doc_id") % 3)
    found = {
        "id": F.col("doc_id") + 1,
        "root_id": F.col("root_id"),
        "path": F.concat(parent, F.lit("/f"), F.col("doc_id")).cast("binary"),
        "parent": parent.cast("binary"),
        "kind": F.lit("file"),
        "size": F.col("size"),
        "allocated": F.expr("(size + 4095) div 4096 * 4096"),
        "mtime_ns": _days_after(F.when(F.col("doc_id") % 5 == 0, F.col("doc_id")).otherwise(F.col("rep"))),
        "ctime_ns": _days_after(F.col("rep")),
        "device": F.lit("1"),
        "inode": F.when(F.col("doc_id") % 19 == 0, "").otherwise((F.col("rep") + 1).cast("string")),
        "generation": (1 + F.col("n") % 3 + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)).cast("long"),
        "observed_at_ns": F.lit(EPOCH_NS) + F.col("doc_id"),
        "skip_reason": F.when(F.col("doc_id") % 17 == 0, "excluded or protected").otherwise(""),
        "digest": F.col("digest"),
        "n": F.col("n"),
    }
    return d.select(*[found[c].alias(c) for c in columns or found])


def _days_after(days: Column) -> Column:
    """The time so many days after the first, in nanoseconds; from the 88,233rd day on it is beyond 64 bits."""
    return (F.lit(EPOCH_NS).cast("decimal(20,0)") + days.cast("decimal(20,0)") * F.lit(DAY_NS).cast("decimal(14,0)")).cast("decimal(38,0)")


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing passes of the files' directories; every tenth source has none."""
    found = entries(spark, sf_dir, ["root_id", "parent", "n"]).where("n % 10 <> 9").groupBy("root_id", F.col("parent").alias("path")).agg(F.min("n").alias("n"))
    return found.select(
        "root_id",
        "path",
        (1 + F.col("n") % 3).cast("long").alias("generation"),
        (F.col("n") % 7 != 0).alias("complete"),
        F.lit(EPOCH_NS).alias("checked_at_ns"),
        F.when(F.col("n") % 11 == 3, "listing failed").otherwise("").alias("last_error"),
    )


def in_compacted():
    """Whether a file's directory was compacted to totals: one in four below every fifth source."""
    return (F.col("n") % 5 == 1) & F.endswith(F.col("parent").cast("string"), F.lit("c2"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass for each user and day: changed by a purchase, unknown by an error."""
    e = observations(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "day").agg(F.bool_or(F.col("event_type") == "purchase").alias("changed"), F.bool_or(F.col("event_type") == "error").alias("unknown"))


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir)
    status = F.when(F.col("event_type").isin("view", "click", "purchase"), "settled").when(F.col("event_type") == "error", "unknown").otherwise("reserved")
    return e.select("event_id", "ts", "user_id", F.to_date("ts").alias("day"), (F.col("event_id") % 64 + 1).alias("allowance"), status.alias("status"))


def cpu_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir)
    return e.select(
        "event_id",
        "ts",
        "user_id",
        (F.col("event_id") * 1_000_003 % 400_000_000).alias("cpu_ns"),
        (1_000_000_000 + F.col("event_id") % 1000).alias("elapsed_ns"),
        F.when(F.col("event_type") == "error", True).otherwise(False).alias("unknown"),
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as linked objects: a part of a supplier is one object seen on many paths."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("device"),
        F.col("l_partkey").alias("inode"),
        (F.col("l_quantity") * 100).cast("long").alias("logical"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("allocated"),
        F.substring("l_returnflag", 1, 1).alias("scope"),
    )
