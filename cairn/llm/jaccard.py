"""Near-duplicate documents: Jaccard join over word shingles as a blocked sparse matrix product.

The matrix has a row for each distinct word sequence and a column for each shingle. A pair with
enough overlap for its sizes must meet in a prefix of both rows when all rows order their shingles
alike, rare ones first; only these columns are multiplied. The order comes from a count of all
shingles: those of many documents go last, by magnitude.

The product is taken in blocks of columns. In a column's block the documents are compared with the
one of their size class with the fewest rarer shingles first; exact verification of these pairs joins most copies. Pairs
that still lie in different components are then all taken from the parts of the prefixes that
their two sizes demand, those discarded whose overlap cannot reach the bound set by sizes and
positions, or whose bit sketches differ in more places than similar sets can, and the rest verified. So no link between components is lost, and a group of copies is never
multiplied out. Columns of many documents are split by document, and the parts' smallest
documents are compared with each other.

Equal word sequences are one node. Null, empty and wordless texts have no shingles and stay alone;
a text of fewer than ``WIDTH`` words is one shingle. Repeated rows are equal sequences. Rows
without an id are returned alone. A very long text is hashed in pieces that end between words; its
hashes, some ten bytes for each word, are held at once. An empty table gives an empty result. Extra
columns are not read by ``near_duplicates`` and carried through by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import WORDS, arrow_schema, counted_join, discard, from_planes, frugal, input_bytes, materialise, packed, planes, salted_join, unpacked
from cairn.llm.components import connected_components

WIDTH = 5
PERCENT = 80
#: Magnitude (binary logarithm) of a shingle's count from which the order has it in a list, and from which its column is split.
LISTED, SPLIT = 2, 6
#: Shingles in the list; with more, those of the least magnitude are left out and their columns, then below that magnitude's
#: count, are not split. Results never change.
MAX_LISTED = 4_000_000
#: Bits of the map, at most, of all shingles of two or more documents; others that fall on their bits are ordered with them.
MAX_BITS = 1 << 28
#: A first comparison is made when this many times the columns led by one of the two reach what a similar pair meets in.
FIRST = 4
#: Parts of a split column.
PARTS = 64
#: Pairs of one node that meet its set in one place; further ones meet another copy of it.
PAIRS_OF_KEY = 1000
#: Columns of a set's sketch: the parity of its shingles in each of 64 cells a column.
SKETCH = ["s0", "s1", "s2", "s3"]
RANGE_BYTES = 12 << 20
BLOCK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARKS = bytes(_SPACE.astype(np.uint8))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _RANDOM.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, folded unless told otherwise, and the number of words of each."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = _FOLD[data] if fold else data
    space = _SPACE[data]
    # a word's hash: its bytes' values times powers of an odd number, from differences of running sums
    powers = np.full(len(data), _STEP[0], np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(len(data), np.uint64(pow(int(_STEP[0]), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * powers, dtype=np.uint64)])
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP[1])
    borders = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, borders), prepend=0)


def texts_of(column: pa.Array):
    """The texts of a column, one at a time."""
    return (t.as_py() for t in column)


def _pieces(text: bytes) -> list[bytes]:
    """A text in pieces of about ``BLOCK_BYTES`` that end between words."""
    marks, out, begin = text.translate(_MARKS), [], 0
    while len(text) - begin > BLOCK_BYTES:
        end = marks.rfind(b"\x01", begin, begin + BLOCK_BYTES) + 1 or marks.find(b"\x01", begin) + 1 or len(text)
        out.append(text[begin:end])
        begin = end
    return [*out, text[begin:]]


def shingle_sets(texts: Iterable[str | None], width: int = WIDTH):
    """Yields (node, sorted distinct shingle hashes) of each text; the node is a hash of the word sequence, 0 without words."""

    def sets(encoded: list[bytes]):
        if len(encoded) == 1 and len(encoded[0]) > BLOCK_BYTES:
            words = np.concatenate([word_hashes([p])[0] for p in _pieces(encoded[0])])
            counts = [len(words)]
        else:
            words, counts = word_hashes(encoded)
            counts = counts.tolist()
        rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for k in range(width):
            rolled += words[k : k + len(rolled)] * _STEP[2 + k]
        rolled = mixed(rolled)
        at = 0
        for n in counts:
            own = words[at : at + n]
            if n == 0:
                yield 0, own
            else:
                weight = np.full(n, _STEP[7], np.uint64)
                weight[0] = n
                node = int(mixed(np.array([(own * np.multiply.accumulate(weight)).sum(dtype=np.uint64) + np.uint64(n)]))[0])
                yield node - (1 << 64) if node >= 1 << 63 else node, np.unique(rolled[at : at + n - width + 1]) if n >= width else np.array([node], np.uint64)
            at += n

    held, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > BLOCK_BYTES:
            yield from sets(held)
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield from sets(held)


def sketch(shingles: np.ndarray) -> list[int]:
    """Parities of the shingles by cell; two sketches differ in no more bits than the sets differ in shingles."""
    cells = (shingles >> np.uint64(32)) % np.uint64(64 * len(SKETCH))
    odd = np.bincount(cells.astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


class Frequency:
    """Magnitudes of shingles' document counts: a list of the frequent ones and a bit map of those of two or more documents."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        self.keys, self.sizes, self.bits = keys, sizes, bits
        self.shift = np.uint64(64 - max(len(bits) * 8, 1).bit_length() + 1)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        at = (shingles >> self.shift).astype(np.int64)
        found = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        if len(self.keys):
            upper = (shingles >> np.uint64(32)).astype(np.uint32)
            place = np.minimum(np.searchsorted(self.keys, upper), len(self.keys) - 1)
            found = np.where(self.keys[place] == upper, self.sizes[place], found)
        return found


def _frequency(docs: DataFrame, ranges: int) -> Frequency:
    """Counts of the upper halves of all shingle hashes."""
    schema = arrow_schema("range int, keys binary")

    def count(batches):
        seen: set[int] = set()

        def out(sets):
            keys = np.sort(np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
            cut = np.searchsorted(keys, (np.arange(1, ranges) * (1 << 32)) // ranges)
            parts = [(r, packed(p)) for r, p in enumerate(np.split(keys, cut)) if len(p)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts), schema)], schema=schema)

        sets, size = [], 0
        for batch in batches:
            for node, shingles in shingle_sets(texts_of(batch.column(0))):
                if node == 0 or node in seen:  # copies met in one task count once
                    continue
                seen.add(node)
                sets.append(shingles)
                size += len(shingles)
                if size >= 1 << 21:
                    yield out(sets)
                    sets, size = [], 0
        if sets:
            yield out(sets)

    def often(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.unique(np.concatenate([unpacked(k, np.uint32) for k in rows["keys"]]), return_counts=True)
        keys, sizes = keys[counts > 1], np.log2(counts[counts > 1]).astype(np.uint8)
        numbers = np.bincount(sizes, minlength=64)
        return pd.DataFrame({"n": [numbers.tolist()], "keys": [packed(keys)], "sizes": [planes(sizes)]})

    found = docs.select("text").mapInArrow(frugal(count), "range int, keys binary").groupBy("range").applyInPandas(frugal(often), "n array<long>, keys binary, sizes binary")
    found = materialise(found, "shingle-counts")
    sizes = list(found.agg(*[F.coalesce(F.sum(F.element_at("n", m + 1)), F.lit(0)) for m in range(64)]).first())
    least, kept = 64, 0
    while least > LISTED and sizes[least - 1] + kept <= MAX_LISTED:
        least -= 1
        kept += sizes[least]
    width = min(1 << max(10, (8 * sum(sizes)).bit_length()), MAX_BITS)
    shift = np.uint32(32 - width.bit_length() + 1)
    parts = arrow_schema("at long, bits binary, keys binary, sizes binary")

    def mark(batches):
        """A range's part of the bit map, and those of its keys that are listed."""
        for batch in batches:
            for keys, magnitudes in zip(batch.column(0), batch.column(1)):
                keys, magnitudes = unpacked(keys.as_py(), np.uint32), from_planes(magnitudes.as_py(), np.uint8)
                if len(keys):
                    at = (keys >> shift).astype(np.int64)
                    first = int(at[0]) // 8
                    bits = np.zeros(int(at[-1]) // 8 - first + 1, np.uint8)
                    np.bitwise_or.at(bits, (at >> 3) - first, np.left_shift(1, at & 7).astype(np.uint8))
                    top = magnitudes >= least
                    row = [first, zstandard.compress(bits.tobytes(), 1), keys[top].tobytes(), magnitudes[top].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, parts)], schema=parts)

    bits = np.zeros(width // 8, np.uint8)  # MAX_BITS / 8 bytes at most; the list has MAX_LISTED keys at most
    listed = [(np.empty(0, np.uint32), np.empty(0, np.uint8))]
    for at, data, keys, magnitudes in found.select("keys", "sizes").mapInArrow(frugal(mark), "at long, bits binary, keys binary, sizes binary").toLocalIterator():
        part = np.frombuffer(zstandard.decompress(data), np.uint8)
        bits[at : at + len(part)] |= part
        listed.append((np.frombuffer(keys, np.uint32), np.frombuffer(magnitudes, np.uint8)))
    discard(found)
    keys, magnitudes = (np.concatenate(c) for c in zip(*listed))
    order = np.argsort(keys)
    return Frequency(keys[order], magnitudes[order], bits)


ROW = np.dtype([("h", "<u8"), ("node", "<i8"), ("n", "<u4"), ("pos", "<u4")])
MEMBER = "h long, node long, n long, pos long, lead long, lead_n long"


def _members(docs: DataFrame, frequent, ranges: int) -> DataFrame:
    """Columns of the prefix matrix with more than one node: their nodes, sizes, positions and the node each is first compared with."""
    schema = arrow_schema("range int, rows binary")

    def emit(batches):
        seen: set[int] = set()

        def out(rows):
            rows = np.concatenate(rows)
            # a split column's nodes go to the ranges of several hashes
            often = frequent.value.of(rows["h"]) >= SPLIT
            part = np.where(often, mixed(rows["node"].astype(np.uint64)) >> np.uint64(40), np.uint64(0)) % np.uint64(PARTS)
            place = ((rows["h"] >> np.uint64(32)).astype(np.int64) * ranges >> 32) + part.astype(np.int64)
            place %= ranges
            order = np.lexsort((rows["h"], rows["node"], place))
            rows, place = rows[order], place[order]
            cut = np.flatnonzero(np.diff(place)) + 1
            parts = [(int(p[0]), planes(r)) for p, r in zip(np.split(place, cut), np.split(rows, cut)) if len(r)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts), schema)], schema=schema)

        held, size = [], 0
        for batch in batches:
            for node, shingles in shingle_sets(texts_of(batch.column(0))):
                if node == 0 or node in seen:
                    continue
                seen.add(node)
                level = frequent.value.of(shingles)
                if level.any():
                    shingles = shingles[np.argsort(level, kind="stable")]
                own = np.empty(prefix_length(len(shingles)), ROW)
                own["h"], own["node"], own["n"], own["pos"] = shingles[: len(own)], node, len(shingles), np.arange(len(own))
                held.append(own)
                size += len(own)
                if size >= 1 << 20:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    def columns(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([from_planes(r, ROW) for r in rows["rows"]])
        x = x[np.argsort(x["h"], kind="stable")]
        same = x["h"][1:] == x["h"][:-1]
        split = frequent.value.of(x["h"]) >= SPLIT  # the column goes on in other ranges
        x = x[(np.concatenate([same, [False]]) | np.concatenate([[False], same]))[: len(x)] | split]
        x = x[np.lexsort((x["node"], x["n"], x["h"]))]
        x = x[np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["node"][1:] != x["node"][:-1])])] if len(x) else x
        band = np.log(np.maximum(x["n"], 1)) // np.log(1.12)
        # the node with the fewest rarer shingles of its own leads: it is the likeliest to be what the others are copies of
        order = np.lexsort((x["node"], x["pos"], band, x["h"]))
        x, band = x[order], band[order]
        begins = np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (band[1:] != band[:-1])])[: len(x)]
        lead = x[np.flatnonzero(begins)[np.cumsum(begins) - 1]] if len(x) else x
        return pd.DataFrame(
            {"h": x["h"].astype(np.int64), "node": x["node"], "n": x["n"].astype(np.int64), "pos": x["pos"].astype(np.int64), "lead": lead["node"], "lead_n": lead["n"].astype(np.int64)}
        )

    out = docs.select("text").mapInArrow(frugal(emit), "range int, rows binary").groupBy("range").applyInPandas(frugal(columns), MEMBER)
    return materialise(out, "shingle-members")


def _sets(docs: DataFrame, meta: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, set) of the nodes asked for, from one document each."""
    wanted = meta.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    schema = arrow_schema("node long, n long, set binary")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                found = [(n, len(s), s.tobytes()) for n, s in shingle_sets(texts_of(batch.column(0).slice(i, 500)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    sets = texts.select("text").mapInArrow(frugal(run), "node long, n long, set binary")
    return materialise(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")


def overlap_needed(n1, n2):
    """Overlap that two sizes need to be similar."""
    return F.ceil((n1 + n2) * F.lit(PERCENT) / (100 + PERCENT) - 1e-9)


def met_needed(n1, n2):
    """Shingles that a similar pair must share inside both prefixes.

    Of the prefix that ends first in the common order, all shingles that the other row has lie in
    the other's prefix too; at most its size less the overlap are not shared.
    """
    return F.greatest(overlap_needed(n1, n2) - F.ceil(F.greatest(n1, n2) * PERCENT / 100 - 1e-9) + 1, F.lit(1))


def _verified(pairs: DataFrame, docs: DataFrame, meta: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(docs, meta, nodes)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}"))
    joined = counted_join(counted_join(pairs, side("b"), "b", "a", PAIRS_OF_KEY), side("a"), "a", "b", PAIRS_OF_KEY).select("a", "b", "sa", "sb")
    schema = arrow_schema("src long, dst long")

    def run(batches):
        for batch in batches:
            kept = []
            for a, b, x, y in zip(*batch.columns):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    kept.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*kept) if kept else ([], []))], schema=schema)

    return joined.mapInArrow(frugal(run), "src long, dst long")


def _left(members: DataFrame, edges: DataFrame, done: DataFrame, meta: DataFrame) -> DataFrame:
    """Pairs of a column that lie in different components and could still link.

    A pair that needs an overlap of o meets before either row has o or more shingles left behind
    the meeting, so two sizes take no more than this part of their prefixes.
    """
    labels = connected_components(edges)
    # a long text is a node of many members, so they are split by column
    members = salted_join(members, labels, "node", "h").select("h", "node", "n", "pos", F.coalesce("component", "node").alias("label"))
    split = members.groupBy("h").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("h")
    open_ = materialise(members.join(split, "h", "left_semi"), "shingle-open")
    sketches = meta.select("node", *SKETCH).join(open_.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    open_ = salted_join(open_, sketches, "node", "h")
    # sizes of a pair differ by a fifth at most, so they lie in one band or in neighbouring ones
    band = F.floor(F.log("n") / float(np.log(100 / PERCENT)))
    side = lambda s, b: open_.select("h", b.alias("_size"), *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "label", *SKETCH)])
    n1, n2, p1, p2 = F.col("n_1"), F.col("n_2"), F.col("pos_1"), F.col("pos_2")
    needed = overlap_needed(n1, n2)
    differ = sum((F.bit_count(F.col(f"{c}_1").bitwiseXOR(F.col(f"{c}_2"))) for c in SKETCH), F.lit(0))
    pairs = (
        side("1", band).join(side("2", F.explode(F.array(band - 1, band, band + 1))), ["h", "_size"]).where("node_1 < node_2 and label_1 <> label_2")
        .where(f"n_1 * 100 >= n_2 * {PERCENT} and n_2 * 100 >= n_1 * {PERCENT}")
        .where((n1 - p1 >= needed) & (n2 - p2 >= needed))
        .where(F.least(p1, p2) + F.least(n1 - p1, n2 - p2) >= needed)
        .where(differ <= n1 + n2 - 2 * needed)
        .groupBy("node_1", "node_2", "n_1", "n_2")
        .agg(F.count("*").alias("met"), F.max("pos_1").alias("pos_1"), F.max("pos_2").alias("pos_2"))
    )
    reach = F.col("met") + F.least(n1 - p1, n2 - p2) - 1
    return pairs.where(reach >= needed).select(F.col("node_1").alias("a"), F.col("node_2").alias("b")).join(done, ["a", "b"], "left_anti")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, number of shingles, group and smallest document of the group, for every row; the group is null without words or id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    total = input_bytes(docs, "text")
    ranges = max(16, -(-total // RANGE_BYTES))
    measured = "doc_id long, digest long, node long, n_shingles long, " + ", ".join(f"{c} long" for c in SKETCH)
    schema = arrow_schema(measured)

    def measure(batches):
        for batch in batches:
            found = [(n, len(s), *sketch(s)) for n, s in shingle_sets(texts_of(batch.column(1)))]
            columns = zip(*found) if found else [[] for _ in schema.names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in columns)], schema=schema)

    meta = materialise(docs.mapInArrow(frugal(measure), measured), "shingle-nodes")
    frequent = spark.sparkContext.broadcast(_frequency(docs, ranges))
    members = _members(docs, frequent, ranges)
    frequent.destroy()  # the members are written
    known = meta.where("node <> 0 and doc_id is not null")
    # first comparisons: each node with the smallest of its size class, and the parts of a column with one another
    leads = members.select("h", F.floor(F.log(F.greatest("lead_n", F.lit(1))) / np.log(1.12)).alias("_band"), "lead", "lead_n").distinct()
    lowest = leads.groupBy("h", "_band").agg(F.min(F.struct("lead_n", "lead")).alias("_low"), F.count("*").alias("_n")).where("_n > 1")
    across = leads.join(lowest, ["h", "_band"]).select(F.col("_low.lead").alias("lead"), F.col("_low.lead_n").alias("lead_n"), F.col("lead").alias("node"), F.col("lead_n").alias("n"))
    first = members.select("lead", "lead_n", "node", "n").union(across).where("lead <> node")
    first = first.groupBy(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).agg(F.count("*").alias("_met"), F.max("n").alias("_n1"), F.max("lead_n").alias("_n2"))
    # a first choice only: what is left out here and lies in different components is met again below
    first = materialise(first.where(F.col("_met") * FIRST >= met_needed(F.col("_n1"), F.col("_n2"))).select("a", "b"), "shingle-pairs")
    edges = materialise(_verified(first, docs, known), "shingle-links")
    left = materialise(_left(members, edges, first, known), "shingle-pairs")
    edges = edges.union(materialise(_verified(left, docs, known), "shingle-links"))
    # documents are reduced to nodes, nodes to groups; what a group says goes back the same way, past copies by the thousand
    labels = connected_components(edges).withColumnRenamed("component", "_group")
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_copies"))
    grouped = nodes.join(labels, "node", "left")
    lowest = grouped.where("_group is not null").groupBy("_group").agg(F.min("_least").alias("_low"))
    answers = salted_join(grouped, lowest, "_group", "node").where("_copies > 1 or _low is not null").select("node", "_group", F.coalesce("_low", "_least").alias("_low"))
    rows = salted_join(meta, answers, "node", "doc_id")
    named = F.col("doc_id").isNotNull()
    group = F.when(named & (F.col("node") != 0), F.coalesce("_group", "node"))
    return rows.select("doc_id", "digest", "n_shingles", group.alias("group"), F.when(named, F.coalesce("_low", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, number of shingles and smallest document reachable by links, for every row."""
    return _grouped(docs).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, then hash of its text. Equal rows of id and text are one.

    Rows that share an id are judged by their own texts. Rows without an id or without words all stay.
    """
    firsts = _grouped(docs).where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "digest")).alias("_first"))
    first = firsts.select(F.col("_first.doc_id").alias("_first_id"), F.col("_first.digest").alias("_first_digest"))
    named = (F.col("doc_id").cast("long") == F.col("_first_id")) & (F.xxhash64("text") == F.col("_first_digest"))
    own = ["doc_id", "_first_digest"]
    found = docs.join(first, named).drop("_first_id").dropDuplicates(own).select(*docs.columns)
    worded = F.coalesce(F.col("text").rlike(WORDS), F.lit(False))
    return found.union(docs.where(F.col("doc_id").isNull() | ~worded))
