"""Vector codes: product codebooks trained by Elkan's form of Lloyd's algorithm, in whole numbers.

Each component x is floor(1024 * x); a vector's four parts have a codebook each. For every part of every
vector an upper bound of the distance to its entry and a lower bound of the distance to every entry
are kept from round to round, in a table of blocks. A round moves the bounds by what the entries
moved. A part whose upper bound is less than half the distance of its entry to the next one stays;
for the others only entries are looked at whose lower bound and whose half distance do not exceed the
upper bound, first as it was, then as measured. All comparisons that leave something out are strict
and all bounds rounded outwards, so an entry at the same distance is always looked at; what is looked
at is decided by whole squared distances, and ties by the entry's number. Lower bounds take one byte.

A round sends the codebooks (256 entries of a vector's size) to the tasks and gets the sums of every
entry back, added up in the shuffle.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors shorter than
the longest, or than the next multiple of four, are filled up with zeros; an empty one is all zeros.
Components beyond the size at which errors would no longer fit a long are cut to it. Fewer than 256
vectors make as many entries. Ties of vec_id go to the smaller vector and null ids come last. Repeated
rows are vectors of their own. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import arrow_schema, discard, frugal, materialise, salted_join

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK_ROWS = 4096
#: Numbers that a task holds at once while it measures distances.
CHUNK = 1 << 21
#: Bounds are moved outwards by this part of themselves, more than rounding can take.
SLACK = 1e-9


def largest(dim: int) -> int:
    """The largest component with which the squared distances of vectors fit a long."""
    return math.isqrt((1 << 63) // max(dim, 1)) // 2 - 1


def whole(vectors: list, dim: int) -> np.ndarray:
    """Vectors as whole numbers, filled up with zeros."""
    out = np.zeros((len(vectors), dim), np.float64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    top = largest(dim)
    return np.clip(np.floor(np.clip(out, -top, top) * SCALE), -top, top).astype(np.int64)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances as whole numbers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:  # exact in floating point
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    step = max(1, CHUNK // max(entries.size, 1))
    for i in range(0, len(x), step):
        out[i : i + step] = ((x[i : i + step, None, :] - entries) ** 2).sum(2)
    return out


def over(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK) + SLACK


def under(d2: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(d2.astype(np.float64)) * (1 - SLACK) - SLACK, 0)


class Bounds:
    """Entry, upper bound and lower bounds of one part of a block of vectors."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.entry, self.upper, self.lower = entry, upper, lower

    @classmethod
    def measured(cls, x: np.ndarray, entries: np.ndarray) -> tuple[Bounds, np.ndarray]:
        """From all distances, with those to the nearest entries."""
        d2 = squared(x, entries)
        entry = d2.argmin(1)  # the first of the smallest
        nearest = d2[np.arange(len(x)), entry]
        return cls(entry, over(nearest), under(d2)), nearest

    def moved(self, before: np.ndarray, after: np.ndarray) -> None:
        """Follow the entries."""
        by = over(((before - after) ** 2).sum(1))
        by[(before == after).all(1)] = 0
        self.upper = self.upper + by[self.entry]
        self.lower = np.maximum(self.lower - by, 0)

    def assign(self, x: np.ndarray, entries: np.ndarray) -> int:
        """Find the nearest entries; returns how many distances were measured."""
        between = under(squared(entries, entries)) / 2
        alone = between + np.where(np.eye(len(entries), dtype=bool), np.inf, 0)
        left = np.flatnonzero(self.upper >= alone.min(1, initial=np.inf)[self.entry])
        looked = 0
        step = max(1, CHUNK // len(entries))
        for i in range(0, len(left), step):
            rows = left[i : i + step]
            of, up = self.entry[rows], self.upper[rows]
            open_ = (self.lower[rows] <= up[:, None]) & (alone[of] <= up[:, None])
            some = open_.any(1)
            rows, of, open_ = rows[some], of[some], open_[some]
            own = ((x[rows] - entries[of]) ** 2).sum(1)  # measured, the upper bound is tight
            up = over(own)
            self.upper[rows] = up
            self.lower[rows, of] = under(own)
            open_ &= (self.lower[rows] <= up[:, None]) & (alone[of] <= up[:, None])
            row, entry = np.nonzero(open_)
            looked += len(rows) + len(row)
            d2 = np.empty(len(row), np.int64)
            for k in range(0, len(row), max(1, CHUNK // max(x.shape[1], 1))):
                part = slice(k, k + max(1, CHUNK // max(x.shape[1], 1)))
                d2[part] = ((x[rows[row[part]]] - entries[entry[part]]) ** 2).sum(1)
            self.lower[rows[row], entry] = under(d2)
            # the nearest of its own entry and those measured, the first where several are
            best, at = own.copy(), of.copy()
            np.minimum.at(best, row, d2)
            at[own > best] = len(entries)
            same = d2 == best[row]
            np.minimum.at(at, row[same], entry[same])
            self.entry[rows] = at
            self.upper[rows] = over(best)
        return looked

    def packed(self) -> bytes:
        """Lower bounds in steps of a 255th of the largest, rounded down."""
        step = float(self.lower.max(initial=0)) / 255
        coarse = np.floor(self.lower / step).clip(0, 255).astype(np.uint8) if step else np.zeros(self.lower.shape, np.uint8)
        while step and (coarse * step > self.lower).any():  # rounding
            coarse = np.where(coarse * step > self.lower, coarse - 1, coarse).astype(np.uint8)
        return b"".join([np.float64(step).tobytes(), self.entry.astype(np.uint8).tobytes(), self.upper.tobytes(), coarse.tobytes()])

    @classmethod
    def unpacked(cls, data: bytes, rows: int, entries: int) -> Bounds:
        step = np.frombuffer(data, np.float64, 1)[0]
        entry = np.frombuffer(data, np.uint8, rows, 8).astype(np.int64)
        upper = np.frombuffer(data, np.float64, rows, 8 + rows).copy()
        lower = np.frombuffer(data, np.uint8, rows * entries, 8 + 9 * rows).reshape(rows, entries)
        return cls(entry, upper, lower * step)

    def size(self) -> int:
        return 8 + 9 * len(self.entry) + self.lower.size


def parts_of(x: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(x, PARTS, axis=1)]


STATE = "vec_ids array<long>, labels array<string>, vectors binary, bounds binary, part int, entry int, n long, sums array<long>"


def _vectors(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.int64).reshape(-1, dim)


def _bounds(data: bytes, rows: int, entries: int) -> list[Bounds]:
    data, out = zstandard.decompress(data), []
    for _ in range(PARTS):
        out.append(Bounds.unpacked(data, rows, entries))
        data = data[out[-1].size() :]
    return out


class Sums:
    """Sums and numbers of the parts at each entry."""

    def __init__(self, entries: int, dim: int):
        self.n = np.zeros((PARTS, entries), np.int64)
        self.sums = np.zeros((PARTS, entries, dim // PARTS), np.int64)

    def add(self, part: int, entry: np.ndarray, x: np.ndarray) -> None:
        self.n[part] += np.bincount(entry, minlength=self.n.shape[1])
        np.add.at(self.sums[part], entry, x)

    def rows(self):
        for part, entry in zip(*np.nonzero(self.n)):
            yield (None, None, None, None, int(part), int(entry), int(self.n[part, entry]), self.sums[part, entry].tolist())


def _batch(rows, schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _first(vectors: DataFrame, codebooks: np.ndarray, dim: int) -> DataFrame:
    """Blocks of vectors with bounds from all distances to the first codebooks."""
    schema = arrow_schema(STATE)

    def run(batches):
        sums, held = Sums(codebooks.shape[1], dim), []

        def close():
            x = whole([r[1] for r in held], dim)
            bounds = []
            for k, own in enumerate(parts_of(x)):
                found, _ = Bounds.measured(own, codebooks[k])
                sums.add(k, found.entry, own)
                bounds.append(found.packed())
            row = ([r[0] for r in held], [r[2] for r in held], zstandard.compress(x.tobytes(), 1), zstandard.compress(b"".join(bounds), 1), None, None, None, None)
            held.clear()
            return _batch([row], schema)

        for batch in batches:
            held.extend(zip(*(batch.column(i).to_pylist() for i in range(3))))
            while len(held) >= BLOCK_ROWS:
                rest = held[BLOCK_ROWS:]
                del held[BLOCK_ROWS:]
                yield close()
                held.extend(rest)
        if held:
            yield close()
        yield _batch(list(sums.rows()), schema)

    return materialise(vectors.mapInArrow(frugal(run), STATE), "codes-state")


def _round(state: DataFrame, before: np.ndarray, after: np.ndarray, dim: int) -> DataFrame:
    """Blocks with their parts assigned anew after the entries have moved."""
    schema = arrow_schema(STATE)
    entries = after.shape[1]

    def run(batches):
        sums = Sums(entries, dim)
        for batch in batches:
            for ids, labels, vectors, data in zip(*(batch.column(i) for i in range(4))):
                x = _vectors(vectors.as_py(), dim)
                bounds = _bounds(data.as_py(), len(x), entries)
                for k, own in enumerate(parts_of(x)):
                    bounds[k].moved(before[k], after[k])
                    bounds[k].assign(own, after[k])
                    sums.add(k, bounds[k].entry, own)
                packed = zstandard.compress(b"".join(b.packed() for b in bounds), 1)
                row = (ids.as_py(), labels.as_py(), vectors.as_py(), packed, None, None, None, None)
                yield _batch([row], schema)
        yield _batch(list(sums.rows()), schema)

    blocks = state.where("vectors is not null").select("vec_ids", "labels", "vectors", "bounds")
    return materialise(blocks.mapInArrow(frugal(run), STATE), "codes-state")


def _moved(state: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The means of the parts at each entry; a row for each number of the codebooks comes back."""
    rows = state.where("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
    out = codebooks.copy()
    for part, entry, at, n, total in rows.groupBy("part", "entry", "at").agg(F.sum("n"), F.sum(F.col("sum").cast("decimal(38,0)"))).collect():
        out[part, entry, at] = int(total) // n
    return out


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, column: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and the codebooks' digest of every vector."""
    v = F.col(column)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.col("label").cast("string").alias("label")).where(v.isNotNull() & finite)
    longest = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    dim = max(PARTS, -(-longest // PARTS) * PARTS)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()  # 256 vectors
    result = "vec_id long, code string, error long, label string"
    if not first:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codebooks = np.stack(parts_of(whole([r[0] for r in first], dim)))
    state = _first(vectors, codebooks, dim)
    for _ in range(rounds):
        moved = _moved(state, codebooks)
        after = _round(state, codebooks, moved, dim)
        discard(state)
        state, codebooks = after, moved
    schema = arrow_schema(result)

    def run(batches):
        for batch in batches:
            for ids, labels, vectors, data in zip(*(batch.column(i) for i in range(4))):
                x = _vectors(vectors.as_py(), dim)
                bounds = _bounds(data.as_py(), len(x), codebooks.shape[1])
                code = np.stack([b.entry for b in bounds], 1).astype(np.uint8)
                error = sum(((own - codebooks[k][b.entry]) ** 2).sum(1) for k, (own, b) in enumerate(zip(parts_of(x), bounds)))
                yield _batch(list(zip(ids.as_py(), [c.tobytes().hex() for c in code], error.tolist(), labels.as_py())), schema)

    coded = materialise(state.where("vectors is not null").select("vec_ids", "labels", "vectors", "bounds").mapInArrow(frugal(run), result), "codes")
    discard(state)
    # a label of its own stands for null
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    coded = coded.select("vec_id", "code", "error", key.alias("_label"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    labels = coded.groupBy("_label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), most).cast("long").alias("label_error"))
    return salted_join(coded, labels, "_label", "code").select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
