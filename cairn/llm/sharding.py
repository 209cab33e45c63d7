"""Sharding along a Hilbert curve over quantised metadata.

Each dimension is cut into ``2**bits`` cells at approximate quantiles over all rows, the cells are
mapped to one index on a Hilbert curve, rows are range-partitioned and sorted by that index, and
the order is cut into runs. Neighbouring runs hold neighbouring cells in every dimension, so a
reader that filters on any of them skips most files by their min/max statistics.

Nulls in a dimension share the lowest cell. Ties on the curve are ordered by the tie columns;
rows equal in all of them are interchangeable. Null and empty texts have size 1. An empty table gives
an empty result. ``hilbert_shards`` refuses columns of its own names; ``document_shards`` reads no
extra columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import materialise


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of points given as an (n, dims) array of cell numbers below ``2**bits``.

    The axes are undone to the transposed Gray-code form level by level, then the bits of all
    dimensions are interleaved, highest first.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(dims):
            inverted = (x[i] & level) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flips ^= np.where((x[dims - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flips
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def ordered_prefix(column: Column) -> Column:
    """A number in the order of the string's first six bytes, so that strings can be cut at quantiles."""
    head = F.hex(F.substring(column.cast("binary"), 1, 6))
    return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")


def hilbert_shards(df: DataFrame, dims: dict[str, Column], ties: list[str], shards: int, bits: int = 6) -> DataFrame:
    """``df`` with ``curve``, ``shard`` and ``slot``: shards are runs of the curve order whose row counts differ by one at most.

    All columns of ``df`` travel through one range shuffle; pass only those that are needed.
    """
    clash = {"curve", "shard", "slot", "_part"} & set(df.columns)
    if clash:
        raise ValueError(f"columns already in use: {sorted(clash)}")
    keys = [f"_dim{i}" for i in range(len(dims))]
    df = materialise(df.withColumns({k: c.cast("double") for k, c in zip(keys, dims.values())}), "hilbert-rows")
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(k, at, 10_000).alias(k) for k in keys]).first()
    cuts = [np.asarray(found[k] or [], dtype=float) for k in keys]

    @F.pandas_udf("long")
    def curve(*values: pd.Series) -> pd.Series:
        cells = [np.where(v.isna(), 0, np.searchsorted(c, v.to_numpy(dtype=float, na_value=-np.inf), side="left")) for v, c in zip(values, cuts)]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    rows = df.withColumn("curve", curve(*keys)).drop(*keys)
    rows = rows.repartitionByRange("curve", *ties).sortWithinPartitions("curve", *ties)
    rows = materialise(rows.withColumn("_part", F.spark_partition_id()), "hilbert-order")
    counts = rows.groupBy("_part").count().orderBy("_part").collect()  # a row for each partition
    total, before = 0, []
    for part, n in counts:
        before.append((part, total))
        total += n
    starts = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    in_part = F.row_number().over(Window.partitionBy("_part").orderBy("curve", *ties)) - 1
    rank = F.col("_before") + in_part
    return (
        rows.join(F.broadcast(starts), "_part")
        .withColumn("_rank", rank)
        .withColumn("shard", F.expr(f"cast(_rank * {shards} div {max(total, 1)} as int)"))
        .withColumn("slot", F.expr(f"_rank - ((cast(shard as bigint) * {total} + {shards - 1}) div {shards})"))
        .drop("_part", "_before", "_rank")
    )


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard of each document by ingestion order, size, language and source.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1. The law is ``rows``. Equal texts
    may fall in neighbouring shards: keeping a group that holds a third of all rows in one shard
    would break the law.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
    )
    dims = {"source": ordered_prefix(F.col("_source")), "lang": ordered_prefix(F.col("_lang")), "size": F.col("size"), "doc_id": F.col("doc_id")}
    out = hilbert_shards(rows, dims, ["doc_id", "text_crc32"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write a sharded frame as one folder for each shard, rows in slot order."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
