"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow routes
each pattern's tokens to the quotas of its sources; the k-th pass over a pattern costs more than
the pass before, so repetition is spread before it is deepened. Documents are then selected inside
each pattern in a seeded order. Only the patterns and quotas reach the driver.

Null sources form a source of their own, last in order. Documents without words are never taken.
Rows with equal ids and sizes are told apart by a row number that is fixed when the sizes are
written. An empty table gives an empty result. Extra columns are carried through by
``mixed_documents`` and not read, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import materialise, word_count

#: Buckets of the seeded order for each pattern; only the bucket where the quota ends is sorted.
BUCKETS = 1024
#: Patterns that may be routed on the driver, some hundred bytes each; more are refused, none is dropped.
MAX_PATTERNS = 1_000_000


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess is shared again by weight."""
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in sorted(full):
            out[i] = float(cap * sizes[i])
            open_.discard(i)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def route(supply: list[int], member_of: list[list[int]], quota: list[int], passes: int) -> list[int]:
    """Tokens taken of each pattern: a min-cost flow from patterns to quotas.

    Pass k of a pattern has the pattern's size as capacity and costs k squared for each token. Costs
    lie on the patterns alone and rise with the pass, so the cheapest flow of every amount is found
    pass by pass: each adds its capacities and raises the flow as far as it goes, by rounds of
    shortest augmenting paths, which may move tokens of a pattern from one of its sources to
    another. A round takes time in proportion to the memberships. Returns tokens by pattern.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(sources, 0) for sources in member_of]
    users: list[list[int]] = [[] for _ in quota]
    for p, sources in enumerate(member_of):
        for s in sources:
            users[s].append(p)
    used, need = [0] * len(supply), list(quota)
    for _ in range(passes):
        room = list(supply)
        while _augment(flow, member_of, users, used, room, need):
            pass
    return used


def _augment(flow, member_of, users, used, room, need) -> bool:
    """One round: levels from patterns with room to sources in need, then disjoint paths along them until none is left."""
    level_p = {p: 0 for p, r in enumerate(room) if r > 0}
    level_s: dict[int, int] = {}
    front, depth, found = list(level_p), 0, False
    while front and not found:
        sources = []
        for p in front:
            for s in member_of[p]:
                if s not in level_s:
                    level_s[s] = depth
                    sources.append(s)
                    found = found or need[s] > 0
        depth, front = depth + 1, []
        for s in sources if not found else ():
            for q in users[s]:
                if q not in level_p and flow[q][s] > 0:
                    level_p[q] = depth
                    front.append(q)
    if not found:
        return False
    next_s, next_p = [0] * len(member_of), [0] * len(need)  # what each node tries next
    for start in [p for p, d in level_p.items() if d == 0]:
        while room[start] > 0:
            path = [start]  # patterns and sources in turn
            while path:
                here = path[-1]
                if len(path) % 2:  # a pattern: on to one of its sources
                    tries, at, ahead = member_of[here], next_s, lambda s: level_s.get(s) == level_p[here]  # noqa: B023
                elif need[here] > 0:
                    break
                else:  # a source: on to a pattern that can leave it
                    tries, at, ahead = users[here], next_p, lambda q: level_p.get(q) == level_s[here] + 1 and flow[q][here] > 0  # noqa: B023
                while at[here] < len(tries) and not ahead(tries[at[here]]):
                    at[here] += 1
                if at[here] < len(tries):
                    path.append(tries[at[here]])
                else:  # a dead end for this round
                    path.pop()
                    if path:
                        (next_p if len(path) % 2 == 0 else next_s)[path[-1]] += 1
            if not path:
                break
            moved = [(path[i + 1], path[i]) for i in range(1, len(path) - 1, 2)]  # pattern, source it leaves
            amount = min([room[start], need[path[-1]], *(flow[p][s] for p, s in moved)])
            for p, s in zip(path[::2], path[1::2]):
                flow[p][s] += amount
            for p, s in moved:
                flow[p][s] -= amount
            used[start] += amount
            room[start] -= amount
            need[path[-1]] -= amount
    return True


def mix(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Copies of each row, and the sources with their sizes and targets.

    ``rows`` has ``doc_id``, ``size`` (tokens) and ``sources`` (array of source names; null is a
    name); other columns stay. Returns ``rows`` with ``copies`` and a table (source, source_size, target). A document
    of two sources counts in the size of both.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("_pattern", F.array_sort(F.array_distinct(F.transform("sources", lambda s: F.concat(F.when(s.isNull(), "1").otherwise("0"), F.coalesce(s, F.lit("")))))))
    rows = materialise(rows.withColumns({"_uid": F.monotonically_increasing_id(), "_order": F.xxhash64(F.lit(seed), "doc_id", "size")}), "mix-rows")
    patterns = rows.groupBy("_pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; merge small sources first")
    patterns.sort(key=lambda r: [s.encode() for s in r._pattern])
    names = sorted({s for r in patterns for s in r._pattern}, key=str.encode)
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in patterns:
        for s in r._pattern:
            sizes[at[s]] += r.size
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(r.size for r in patterns), passes)
    supply = [r.size for r in patterns]
    taken = route(supply, [[at[s] for s in r._pattern] for r in patterns], [round(t) for t in targets], passes)
    plan = spark.createDataFrame(
        [(r._pattern, t // max(n, 1), t % max(n, 1)) for r, n, t in zip(patterns, supply, taken)],
        "_pattern array<string>, _whole long, _rest long",
    )
    sources = spark.createDataFrame(
        [(s[1:] if s[0] == "0" else None, n, t) for s, n, t in zip(names, sizes, targets)],
        "source string, source_size long, target double",
    )
    return _select(rows, plan).drop("_pattern", "_uid", "_order"), sources


def _select(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Whole passes for all rows of a pattern, and once more those that come first in the seeded order, up to the rest of the quota."""
    rows = rows.withColumn("_bucket", F.shiftright(F.col("_order"), 54) + BUCKETS // 2)
    by_order = Window.partitionBy("_pattern").orderBy("_bucket")
    buckets = (
        rows.groupBy("_pattern", "_bucket")
        .agg(F.sum("size").alias("_n"))
        .withColumn("_after", F.sum("_n").over(by_order))
        .join(F.broadcast(plan), "_pattern")
        .where(F.col("_after") <= F.col("_rest"))
        .groupBy("_pattern")
        .agg(F.max("_bucket").alias("_last"), F.max("_after").alias("_full"))
    )
    plan = plan.join(buckets, "_pattern", "left").select("_pattern", "_whole", "_rest", F.coalesce("_last", F.lit(-1)).alias("_last"), F.coalesce("_full", F.lit(0)).alias("_full"))
    plan = plan.sparkSession.createDataFrame(plan.collect(), plan.schema)  # a row for each pattern
    rows = rows.join(F.broadcast(plan), "_pattern")
    # the bucket in which the quota ends, in order
    edge = rows.where(F.col("_bucket") > F.col("_last")).groupBy("_pattern").agg(F.min("_bucket").alias("_edge"))
    within = Window.partitionBy("_pattern").orderBy("_order", "doc_id", "_uid")
    begun = (
        rows.join(F.broadcast(edge), "_pattern")
        .where(F.col("_bucket") == F.col("_edge"))
        .withColumn("_sum", F.col("_full") + F.sum("size").over(within))
        .where((F.col("_sum") <= F.col("_rest")) & (F.col("size") > 0))
        .select("_pattern", "_uid", "_sum")
    )
    begun = materialise(begun, "mix-edge")
    gap = begun.groupBy("_pattern").agg(F.max("_sum").alias("_sum"))
    # one more document, the one whose size comes nearest to what is left
    rest = F.col("_rest") - F.coalesce(F.col("_sum"), F.col("_full"))
    near = (
        rows.where((F.col("_bucket") > F.col("_last")) & (F.col("size") > 0))
        .join(begun.select("_uid"), "_uid", "left_anti")
        .join(F.broadcast(gap), "_pattern", "left")
        .withColumn("_gap", rest)
        .where(F.abs(F.col("size") - F.col("_gap")) < F.col("_gap"))
        .groupBy("_pattern")
        .agg(F.min_by("_uid", F.struct(F.abs(F.col("size") - F.col("_gap")), "_order", "doc_id", "_uid")).alias("_uid"))
    )
    more = begun.select("_uid").union(near.select("_uid")).withColumn("_more", F.lit(1))
    once_more = F.when((F.col("_bucket") <= F.col("_last")) | F.col("_more").isNotNull(), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("_whole") + once_more).otherwise(0)
    return rows.join(more, "_uid", "left").withColumn("copies", copies.cast("int")).drop("_bucket", "_whole", "_rest", "_last", "_full", "_more")


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents of the mix, each as often as it is taken; all columns in their order, whatever their names."""
    name = f"mix_{uuid.uuid4().hex}"  # no column of the documents has it
    kept = materialise(docs.withColumn(f"{name}_row", F.monotonically_increasing_id()), "mix-documents")
    rows = kept.select(F.col(f"{name}_row").alias("_mix_row"), F.col("doc_id").cast("long").alias("doc_id"), word_count("text").alias("size"), F.array(F.col("source").cast("string")).alias("sources"))
    copies = mix(rows, seed=seed)[0].where("copies > 0").select(F.col("_mix_row").alias(f"{name}_row"), F.col("copies").alias(f"{name}_copies"))
    times = F.explode(F.sequence(F.lit(1), F.col(f"{name}_copies")))
    return kept.join(copies.hint("merge"), f"{name}_row").withColumn(f"{name}_nth", times).select(*docs.columns)


def document_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Words taken of each document when its source is its only membership."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count("text").alias("size"), F.array("source").alias("sources"))
    mixed, sources = mix(rows, seed=seed)
    mixed = mixed.withColumn("_source", F.element_at("sources", 1))
    sources = sources.withColumnRenamed("source", "_name")
    return mixed.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("_name"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
