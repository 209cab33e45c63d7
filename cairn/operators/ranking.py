"""Positions in a total order without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.sources.written import written


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """Rows with their position, from 1, among those of equal ``by`` in ascending order; the order must tell all rows apart.

    Rows are dealt by range and counted in each part; a row's position is that in its part and the
    counts of the parts before. A key with most of the rows is spread over many parts. The parts' counts are
    as many as parts and keys, so a key's own parts are few.
    """
    parts = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    parts = written(parts, "ranked")
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)))
    counts = parts.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # keys may be null
    same: Column = F.col("l._part") == F.col("o._part")
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}"))
    joined = local.alias("l").join(offsets.alias("o"), same)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._local") + F.col("o._before")).cast("long").alias(name))


def fair_turns(work: DataFrame, roots: DataFrame, cursor: int, now: int, allow_source: bool = True, limit: int = 128) -> DataFrame:
    """Turns in which roots are served: the first of every root, then the second of every root, and so on.

    ``work`` has (root_id, id, kind, due_at), kind being ``source`` or ``maintenance``. A root's source
    work that is due comes first, by time and id, unless ``allow_source`` is off; maintenance follows if
    the root has nothing running (``busy``). Roots take turns from the one after ``cursor`` on;
    disabled ones have none. There are ``limit`` roots at most, checked, so their queues' lengths go to
    every row and a turn's number is arithmetic, not a sort of all turns.
    """
    if roots.limit(limit + 1).count() > limit:
        raise ValueError(f"{limit} roots at most")
    live = roots.where("enabled").select("root_id", "busy")
    ready = (F.col("kind") == "source") & (F.col("due_at") <= now) & F.lit(allow_source)
    rows = work.join(F.broadcast(live), "root_id").where(ready | ((F.col("kind") == "maintenance") & ~F.col("busy")))
    rows = rows.withColumn("_late", (F.col("kind") == "maintenance").cast("int"))
    queued = ranked(rows.select("root_id", "_late", "due_at", "id", "kind"), ["root_id"], ["_late", "due_at", "id"], "nth")
    queued = written(queued, "turns")
    lengths = queued.groupBy("root_id").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy((F.col("root_id") <= cursor).cast("int"), "root_id")))
    listed = lengths.agg(F.collect_list(F.struct("place", "n")).alias("_queues"))  # a row for each root
    placed = queued.join(F.broadcast(lengths.select("root_id", "place")), "root_id").crossJoin(F.broadcast(listed))  # one row
    earlier = F.aggregate("_queues", F.lit(0).cast("long"), lambda a, q: a + F.least(q["n"], F.col("nth") - 1) + F.when((q["place"] < F.col("place")) & (q["n"] >= F.col("nth")), 1).otherwise(0))
    return placed.select((earlier + 1).alias("turn"), "root_id", F.col("nth").alias("round"), "kind", "id")
