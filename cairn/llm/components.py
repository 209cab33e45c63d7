"""Connected components of an edge table.

Each task first contracts the edges it holds to stars. While more are left than one task may hold,
rounds of hooking every node to its smallest neighbour, following parents, and contracting the edges
go on; a round at least halves the nodes that still have edges. One task then joins the rest, which
``TASK_EDGES`` bounds. Each round's tables are written to the shared folder. Nothing is collected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import arrow_schema, materialise

#: Nodes that a task contracts at once; it starts afresh beyond them.
TASK_NODES = 1_000_000
#: Edges, after contraction, that one task joins.
TASK_EDGES = 250_000


class Forest:
    """Union by smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


def _contract(edges: DataFrame) -> DataFrame:
    schema = arrow_schema("src long, dst long")

    def run(batches):
        forest = Forest()

        def out():
            stars = forest.stars()
            columns = zip(*stars) if stars else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
            if len(forest.parent) > TASK_NODES:
                yield out()
                forest = Forest()
        yield out()

    return edges.select("src", "dst").mapInArrow(run, "src long, dst long")


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge. ``edges`` has src and dst, both long."""
    edges = materialise(_contract(edges), "components-edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    while edges.count() > task_edges:
        both = edges.union(edges.select("dst", "src"))
        parents = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent")).select("node", F.least("node", "parent").alias("parent"))
        parents = materialise(parents, "components-parents")
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        parents = parents.join(up, "parent").select("node", F.col("_up").alias("parent"))
        parents = materialise(parents.join(up, "parent").select("node", F.col("_up").alias("parent")), "components-parents")
        labels = labels.join(parents.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = materialise(labels, "components-labels")
        of = lambda c: parents.select(F.col("node").alias(c), F.col("parent").alias(f"_{c}"))
        edges = edges.join(of("src"), "src").join(of("dst"), "dst").where("_src != _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
        edges = materialise(_contract(edges.distinct()), "components-edges")
    stars = materialise(_contract(edges.coalesce(1)), "components-stars").select(F.col("src").alias("component"), F.col("dst").alias("_top"))
    return labels.join(stars, "component", "left").select("node", F.coalesce("_top", "component").alias("component"))
