"""Near-duplicate vectors by product quantisation.

Coarse centroids and residual codebooks are fitted on a bounded sample; every vector is indexed.
A vector is stored in the inverted list of its nearest centroid with one code for each subspace of
its residual and the distance between it and what the codes say. It probes its own list and all
lists whose border, the plane half-way between the two centroids, lies within half the link radius
sqrt(2 - 2 * threshold). Two linked vectors of different lists lie on different sides of the border
between these and at most the radius apart, so at least one of them probes the other's list; where
both do, the pair is counted in the list of the higher number only. In a list, table look-ups give the asymmetric distance of a query to every code; by the triangle
inequality a linked vector is never farther than the link radius plus its own coding error, so no
pair of a probed list is lost by the codes. What passes is compared by exact cosine in double
precision.

Equal vectors are compared once and counted with their number. Lists are dealt in blocks of bounded
numbers of stored vectors and queries, so a dense list is many tasks. A block returns link counts
and the stars of its own links, not its pairs.

Vectors that are null, zero or hold null or non-finite components link with nothing. Vectors of
different lengths never link. Rows without an id are returned unlinked. Rows with equal ids and
equal vectors count each other as links; with equal ids and other vectors the id stands for all of
them in links and components. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from cairn.llm.common import arrow_schema, frugal, materialise, salted_join
from cairn.llm.components import connected_components

#: Vectors that centroids and codebooks are fitted on, those first in a hashed order.
SAMPLE = 20_000
LIST_SIZE, MAX_LISTS = 512, 4096
SUBSPACES, CODES = 16, 256
#: Added to the distance from a border within which a list is probed, for rounding.
PROBE_SLACK = 1e-6
BLOCK_STORED, BLOCK_QUERIES = 2048, 4096


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, up to each row's own square."""
    return (centres * centres).sum(1) - 2 * (x @ centres.T)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; an empty centre keeps its place."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, centres).argmin(1)
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def link_radius(threshold: float) -> float:
    """Largest distance between unit vectors whose cosine is the threshold or more."""
    return math.sqrt(max(0.0, 2 - 2 * threshold))


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = k_means(sample, min(lists, len(sample)))
        residual = sample - self.coarse[nearest(sample, self.coarse).argmin(1)]
        self.bounds = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [k_means(residual[:, a:b], min(CODES, len(sample))) for a, b in zip(self.bounds, self.bounds[1:])]

    def encode(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """List, codes, coding error and probed lists beyond the own one of each unit vector, for links of a radius."""
        squares = nearest(x, self.coarse)
        own = squares.argmin(1)
        residual = x - self.coarse[own]
        codes = np.stack([nearest(residual[:, a:b], book).argmin(1) for a, b, book in zip(self.bounds, self.bounds[1:], self.books)], axis=1).astype(np.uint8)
        said = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        error = np.sqrt(((residual - said) ** 2).sum(1))
        centres = self.coarse[own]
        apart = np.sqrt(np.maximum((self.coarse**2).sum(1) - 2 * centres @ self.coarse.T + (centres**2).sum(1)[:, None], 1e-12))
        border = (squares - squares[np.arange(len(x)), own][:, None]) / (2 * apart)
        probed = (border <= radius / 2 + PROBE_SLACK) & (np.arange(len(self.coarse))[None] != own[:, None])
        return own, codes, error, [np.flatnonzero(p) for p in probed]

    def tables(self, queries: np.ndarray, list_id: int) -> np.ndarray:
        """Squared distance of each query's residual to every code, by subspace."""
        residual = queries - self.coarse[list_id]
        out = np.zeros((len(queries), len(self.books), CODES), np.float32)
        for s, (a, b, book) in enumerate(zip(self.bounds, self.bounds[1:], self.books)):
            part = residual[:, a:b]
            out[:, s, : len(book)] = (part * part).sum(1)[:, None] + nearest(part, book)
        return out


def linked(quantiser: Quantiser, list_id: int, queries: np.ndarray, stored: np.ndarray, codes: np.ndarray, error: np.ndarray, threshold: float):
    """Pairs (query, stored) of one block with a cosine of the threshold or more; all rows are unit vectors in double precision."""
    most = (link_radius(threshold) + error + 1e-3) ** 2
    found_q, found_s = [], []
    for i in range(0, len(queries), 256):
        tables = quantiser.tables(queries[i : i + 256], list_id)
        distance = np.zeros((len(tables), len(stored)), np.float32)
        for s in range(codes.shape[1]):
            distance += tables[:, s, :][:, codes[:, s]]
        q, s = np.nonzero(distance <= most[None])
        for j in range(0, len(q), 1 << 17):
            a, b = q[j : j + (1 << 17)] + i, s[j : j + (1 << 17)]
            hit = np.einsum("ij,ij->i", queries[a], stored[b]) >= threshold
            found_q.append(a[hit])
            found_s.append(b[hit])
    empty = np.empty(0, np.int64)
    return np.concatenate([*found_q, empty]), np.concatenate([*found_s, empty])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one. Each is first brought near one by a power of two, which changes no digit, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(x).max(1, initial=0))
    x = np.ldexp(x, -exponent[:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _unit(raw, kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float))


def _prepared(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with the id of their first equal vector (null: never linked), and these firsts with their numbers."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("_v", lambda x: x != 0)
    key = F.sha2(F.concat_ws(",", F.transform("_v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string"))), 256)
    rows = rows.withColumn("_key", F.when(usable, key))
    firsts = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("_v").alias("v"))
    firsts = materialise(firsts, "vector-firsts")
    copied = firsts.where("n > 1").select("_key", "rep", F.col("n").alias("_equal"))
    all_rows = salted_join(rows.select("vec_id", "_key"), copied, "_key", "vec_id")
    return all_rows.select("vec_id", F.when(F.col("_key").isNotNull(), F.coalesce("rep", "vec_id")).alias("rep"), "_equal"), firsts.select("rep", "n", F.col("v").cast("array<float>") if single else "v")


ENTRY = "list int, stored boolean, own int, probed binary, rep long, n long, codes binary, error double, v binary"


def _entries(firsts: DataFrame, quantiser, radius: float, kind: str) -> DataFrame:
    """A stored row for each vector in its list, with the lists it probes, and a query row in each of these."""
    schema = arrow_schema(ENTRY)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), float)
            if not len(x):
                continue
            own, codes, error, probed = quantiser.value.encode(unit(x), radius)
            reps, counts, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [r.astype(kind).tobytes() for r in x]
            rows = [(int(own[i]), True, int(own[i]), probed[i].astype("<i2").tobytes(), reps[i], counts[i], codes[i].tobytes(), float(error[i]), raw[i]) for i in range(len(x))]
            rows += [(int(p), False, int(own[i]), b"", reps[i], counts[i], b"", 0.0, raw[i]) for i in range(len(x)) for p in probed[i]]
            for j in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[j : j + 20_000]), schema)], schema=schema)

    return firsts.mapInArrow(frugal(run), ENTRY)


def _probes(raw) -> np.ndarray:
    """Whether each row probes each list."""
    out = np.zeros((len(raw), MAX_LISTS), bool)
    for i, r in enumerate(raw):
        out[i, np.frombuffer(r, "<i2")] = True
    return out


def _search(fitted, threshold: float, kind: str):
    """The work of one block: link counts of its queries and stored vectors, and the stars of its links."""

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept, asked = rows[~rows["_query"]], rows[rows["_query"]]
        if not len(kept) or not len(asked):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype({"a": "int64", "b": "Int64", "links": "int64"})
        codes = np.frombuffer(b"".join(kept["codes"]), np.uint8).reshape(len(kept), -1)
        q, s = linked(fitted.value, key[0], _unit(asked["v"], kind), _unit(kept["v"], kind), codes, kept["error"].to_numpy(), threshold)
        qr, sr = asked["rep"].to_numpy(), kept["rep"].to_numpy()
        home = asked["own"].to_numpy()[q]
        again = home > key[0]  # guests of later lists: met there already if the stored vector probes that list
        again[again] = _probes(kept["probed"])[s[again], home[again]]
        other = (qr[q] != sr[s]) & ~again
        q, s = q[other], s[other]
        to_q = np.bincount(q, weights=kept["n"].to_numpy()[s], minlength=len(qr)).astype(np.int64)
        guest = ~asked["stored"].to_numpy()[q]  # a stored vector is a query of its own list too, so its links count once from each side
        to_s = np.bincount(s[guest], weights=asked["n"].to_numpy()[q[guest]], minlength=len(sr)).astype(np.int64)
        stars = _stars(qr[q], sr[s])
        return pd.DataFrame(
            {
                "a": np.concatenate([qr[to_q > 0], sr[to_s > 0], stars[0]]).astype("int64"),
                "b": pd.array([*[None] * int((to_q > 0).sum() + (to_s > 0).sum()), *stars[1].tolist()], dtype="Int64"),
                "links": np.concatenate([to_q[to_q > 0], to_s[to_s > 0], np.zeros(len(stars[0]), np.int64)]),
            }
        )

    return search


def _sample(vectors: DataFrame, total: int) -> np.ndarray:
    """The vectors to fit on; a threshold on the hash keeps all but about twice as many from the driver."""
    order = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    few = vectors.where(order < int(min(1.0, 2 * SAMPLE / max(total, 1)) * (1 << 30)) + 1)
    return np.array([r.v for r in few.orderBy(order, "rep").limit(SAMPLE).select("v").toLocalIterator()], float)


def vector_links(firsts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): for b null, the vectors linked to a in one block; otherwise an edge between a and b."""
    spark = firsts.sparkSession
    found = None
    kind = "<f4" if isinstance(firsts.schema["v"].dataType.elementType, FloatType) else "<f8"
    for (dims,) in firsts.select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        own = firsts.where(F.size("v") == dims)
        total = own.count()
        sample = _sample(own, total)
        sample = unit(sample)
        fitted = spark.sparkContext.broadcast(Quantiser(sample, min(MAX_LISTS, -(-total // LIST_SIZE))))
        entries = materialise(_entries(own, fitted, link_radius(threshold), kind), "vector-entries")
        blocks = entries.groupBy("list").agg(
            F.greatest(F.ceil(F.count_if("stored") / BLOCK_STORED), F.lit(1)).cast("int").alias("_sb"),
            F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("_qb"),
        )  # MAX_LISTS rows at most
        entries = entries.join(F.broadcast(blocks), "list")
        # stored rows go to one stored block and all query blocks; every row is a query of one query block and all stored blocks
        mine = F.pmod(F.xxhash64("rep"), F.col("_sb")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("_qb")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        kept = entries.where("stored").withColumn("_s", mine[0]).withColumn("_q", every("_qb")).withColumn("_query", F.lit(False))
        asked = entries.withColumn("probed", F.lit(b"")).withColumn("_s", every("_sb")).withColumn("_q", mine[1]).withColumn("_query", F.lit(True))
        columns = ["list", "_s", "_q", "_query", "stored", "own", "probed", "rep", "n", "codes", "error", "v"]

        part = kept.select(*columns).union(asked.select(*columns)).groupBy("list", "_s", "_q").applyInPandas(_search(fitted, threshold, kind), "a long, b long, links long")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "a long, b long, links long")
    return materialise(found, "vector-links")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest of its component among these pairs."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def vector_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Links and component of each vector."""
    rows, firsts = _prepared(vectors)
    found = vector_links(firsts, threshold)
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("_links"))
    labels = connected_components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    component = F.coalesce("component", "rep", "vec_id")
    found = links.join(labels.withColumnRenamed("node", "rep"), "rep", "full")
    return salted_join(rows, found, "rep", "vec_id").select(
        "vec_id",
        (F.coalesce("_links", F.lit(0)) + F.coalesce("_equal", F.lit(1)) - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
