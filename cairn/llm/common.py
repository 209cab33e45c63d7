"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import inspect
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch in the jobs that write tables.
BATCH_ROWS = 500

#: ASCII white space as the operators define it: space, tab, line feed, vertical tab, form feed, carriage return.
WORDS = r"[^\x20\x09-\x0D]+"


def workspace(spark: SparkSession) -> str:
    """The shared folder for checkpoints and tables written between steps.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a session on one machine, as
    in tests, makes and sets a temporary folder; a cluster is refused.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = context._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="cairn-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    return base


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows that go to a Python worker at once while something runs: texts and sets of thousands of rows would be tens of MB in several copies."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, partition_by: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it: its rows are then fixed and its lineage is short."""
    spark = df.sparkSession
    path = f"{workspace(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**(options or {}))
    with batches_of(spark, BATCH_ROWS):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        base = workspace(spark).rstrip("/").split(":")[-1]
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if base in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return memory that this process no longer uses to the system; Python workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def frugal(work):
    """A function for ``mapInArrow`` (a generator) or for groups that gives its memory back when it ends."""
    if inspect.isgeneratorfunction(work):

        def batches_out(batches):
            try:
                yield from work(batches)
            finally:
                give_back()

        return batches_out
    if len(inspect.signature(work).parameters) == 1:

        def of_group(rows):
            try:
                return work(rows)
            finally:
                give_back()

        return of_group

    def of_two(first, second):
        try:
            return work(first, second)
        finally:
            give_back()

    return of_two


def planes(values: np.ndarray) -> bytes:
    """An array as compressed bytes, first bytes of all items first."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes(), 1)


def from_planes(data: bytes, dtype) -> np.ndarray:
    found = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(found.T).view(dtype).ravel()


def packed(values: np.ndarray) -> bytes:
    """Ascending integers as compressed bytes of their differences, plane by plane."""
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def unpacked(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(from_planes(data, dtype), dtype=dtype)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 8) -> DataFrame:
    """Left join on a key that many rows of ``left`` may share: they are split by another column and ``right``, narrow and with each key once, is repeated."""
    salt = "_salt_of_join"
    split = left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return split.join(repeated, [key, salt], "left").drop(salt)


def counted_join(left: DataFrame, right: DataFrame, key: str, spread: str, most: int) -> DataFrame:
    """Inner join on a key of ``right``, wide and with each key once; keys with more than ``most`` rows of ``left`` are split by another column and only theirs repeated."""
    salt = "_salt_of_join"
    often = left.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_salts")).where("_salts > 1")
    salts = F.coalesce("_salts", F.lit(1))
    split = salted_join(left, often, key, spread).withColumn(salt, F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    repeated = right.join(often, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return split.join(repeated, [key, salt]).drop(salt)


def input_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def word_count(column: str):
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORDS)), F.lit(0)).cast("long")


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string, for batches built inside tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
