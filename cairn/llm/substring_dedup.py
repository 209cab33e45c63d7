"""Removal of word windows that occur more than once, by difference-cover anchors.

Positions of a text's words are taken modulo ``PERIOD``; a window of ``ANCHOR`` words is hashed only
where the remainder lies in ``COVER``, a difference cover: for any two positions some shift below
``PERIOD`` moves both into it. So two equal windows of ``WIDTH`` words, wherever they start, hold an
anchor at the same place, and windows around anchors that occur once need no look. The match is then
extended on both sides of each anchor that occurs again: the windows of ``WIDTH`` words around it are
compared by hashes of 96 bits, and the words of those that occur again are covered.

Texts are packed into blocks, equal word sequences of a block once with their number. A block sends
each distinct hash once to the range of the hash, where the blocks' hashes meet, and gets back one bit
for each; so a passage in a third of all texts is one hash of each block, never a pair of its places.
Texts move to their bits twice. All windows are judged on the input.

Null, empty and wordless texts have no words; texts of fewer than ``WIDTH`` words lose none. Repeated
rows and equal ids are documents of their own, each of which removes the others' windows. Rows
without an id count too. A very long text is a block of its own and takes some forty times its bytes
in a worker. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import arrow_schema, frugal, from_planes, input_bytes, materialise, packed, planes, unpacked
from cairn.llm.jaccard import BLOCK_BYTES as PIECE_BYTES
from cairn.llm.jaccard import mixed, word_hashes
from cairn.llm.jaccard import _pieces as pieces

WIDTH = 35
#: Every difference modulo 13 is one of two members of the cover.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WIDTH - PERIOD + 1
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 12 << 20

_RANDOM = np.random.Generator(np.random.PCG64(35))
_STEP = _RANDOM.integers(1, 1 << 63, (3, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)

BLOCK = "block string, doc_ids array<long>, owners array<int>, texts binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """One row for each block: its documents, which distinct word sequence each has, and these, a line each."""
    schema = arrow_schema(BLOCK)

    def pack(batches):
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        ids, owners, texts = [], [], {}

        def close():
            nonlocal seq, size
            row = [f"{part}-{seq}", list(ids), list(owners), zstandard.compress(b"\n".join(texts), 3)]
            seq, size = seq + 1, 0
            ids.clear(), owners.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = b" ".join((text.as_py() or "").encode("utf-8", "surrogatepass").split())
                if words not in texts:
                    texts[words] = len(texts)
                    size += len(words)
                ids.append(doc)
                owners.append(texts[words])
                size += 16
                if size >= BLOCK_BYTES:
                    yield close()
        if ids:
            yield close()

    return materialise(docs.mapInArrow(frugal(pack), BLOCK), "substring-blocks")


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and the number of words of each; texts are hashed together up to a bound and longer ones in pieces, as hashing takes many times their bytes."""
    hashes, counts, held, size = [], [], [], 0

    def flush():
        nonlocal size
        if held:
            found, numbers = word_hashes(held, fold=False)
            hashes.append(found)
            counts.append(numbers)
            held.clear()
            size = 0

    for text in texts:
        if size + len(text) > PIECE_BYTES:
            flush()
        if len(text) > PIECE_BYTES:
            parts = [word_hashes([p], fold=False)[0] for p in pieces(text)]
            hashes += parts
            counts.append(np.array([sum(map(len, parts))]))
        else:
            held.append(text)
            size += len(text)
    flush()
    return np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([np.empty(0, np.int64), *counts]).astype(np.int64)


class Block:
    """The words of a block's distinct texts, one after the other."""

    def __init__(self, owners, texts: bytes):
        self.texts = zstandard.decompress(texts).split(b"\n")
        self.hashes, self.sizes = _hashed(self.texts)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # words left in the text from each word on, and whether the text occurs again in the block
        self.left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(len(self.hashes))
        self.again = np.repeat(np.bincount(np.asarray(owners), minlength=len(self.texts)) > 1, self.sizes)

    def windows(self, width: int, salt: int) -> np.ndarray:
        """Hash of the window at each word; those that run past the last word count as 0."""
        out = np.zeros(len(self.hashes), np.uint64)
        n = max(len(out) - width + 1, 0)
        for k in range(width):
            out[:n] += self.hashes[k : k + n] * _STEP[salt, k]
        return mixed(out)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors."""
        nth = np.arange(len(self.hashes)) - np.repeat(self.starts, self.sizes)
        long = np.repeat(self.sizes >= WIDTH, self.sizes)
        at = np.flatnonzero(_IN_COVER[nth % PERIOD] & (self.left >= ANCHOR) & long)
        return at, self.windows(ANCHOR, 0)[at]

    def candidates(self, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of the windows that hold an anchor that was found again."""
        seen = np.zeros(len(self.hashes) + PERIOD, np.int64)
        seen[at[found]] = 1
        sums = np.concatenate([[0], np.cumsum(seen)])
        near = sums[PERIOD : PERIOD + len(self.hashes)] > sums[: len(self.hashes)]
        at = np.flatnonzero(near & (self.left >= WIDTH))
        return at, self.windows(WIDTH, 1)[at], (self.windows(WIDTH, 2)[at] >> np.uint64(32)).astype(np.uint32)


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts pairs, and the number of each one's distinct value."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])[: len(high)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


SHARE = "block string, range int, high binary, low binary, again binary"


def _shares(block: str, high: np.ndarray, low: np.ndarray, again: np.ndarray, ranges: int):
    """A block's distinct hashes for each range, with whether they occur more than once in it."""
    first, number = _distinct(high, low)
    many = (np.bincount(number, minlength=len(first)) > 1) | (np.bincount(number, weights=again, minlength=len(first)) > 0)
    high, low = high[first], low[first]
    cut = np.searchsorted(high, np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64))
    parts = zip(np.split(high, cut), np.split(low, cut), np.split(many, cut))
    return [(block, r, packed(h), planes(w), np.packbits(m).tobytes()) for r, (h, w, m) in enumerate(parts) if len(h)]


def _met(rows: pd.DataFrame) -> pd.DataFrame:
    """Which hashes of each block occur again, in it or in another."""
    high = [unpacked(h, np.uint64) for h in rows["high"]]
    sizes = [len(h) for h in high]
    _, number = _distinct(np.concatenate(high), np.concatenate([from_planes(w, np.uint32) for w in rows["low"]]))
    again = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=n) for a, n in zip(rows["again"], sizes)])
    found = (np.bincount(number) > 1) | (np.bincount(number, weights=again) > 0)
    bits = [np.packbits(b).tobytes() for b in np.split(found[number], np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"block": rows["block"], "range": rows["range"], "n": sizes, "bits": bits})


def _answers(shares: DataFrame, name: str) -> DataFrame:
    """(block, its bits by range) where the blocks' hashes have met."""
    bits = shares.groupBy("range").applyInPandas(frugal(_met), "block string, range int, n int, bits binary")
    return materialise(bits, name).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "n", "bits"))).alias("found"))


def _bits(found) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=f["n"]) for f in found or []]]).astype(bool)


def _of_hashes(high: np.ndarray, low: np.ndarray, found) -> np.ndarray:
    """For each hash of a block whether it was met again; the answers are in the order of the distinct hashes."""
    bits = _bits(found)
    return bits[_distinct(high, low)[1]] if len(high) else np.zeros(0, bool)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = max(16, -(-input_bytes(docs, "text") // RANGE_BYTES))
    share = arrow_schema(SHARE)
    blocks = _blocks(docs)

    def anchor(batches):
        for batch in batches:
            for block, owners, texts in zip(*(batch.column(i) for i in range(3))):
                own = Block(owners.as_py(), texts.as_py())
                at, hashes = own.anchors()
                yield _rows(_shares(block.as_py(), hashes, np.zeros(len(at), np.uint32), own.again[at], ranges), share)

    anchors = _answers(blocks.select("block", "owners", "texts").mapInArrow(frugal(anchor), SHARE), "substring-anchors")

    def extended(owners, texts, found):
        own = Block(owners, texts)
        at, hashes = own.anchors()
        return own, *own.candidates(at, _of_hashes(hashes, np.zeros(len(at), np.uint32), found))

    def extend(batches):
        for batch in batches:
            for block, owners, texts, found in zip(*(batch.column(i) for i in range(4))):
                own, at, high, low = extended(owners.as_py(), texts.as_py(), found.as_py())
                yield _rows(_shares(block.as_py(), high, low, own.again[at], ranges), share)

    met = blocks.join(anchors.withColumnRenamed("found", "anchors"), "block", "left")
    windows = _answers(met.select("block", "owners", "texts", "anchors").mapInArrow(frugal(extend), SHARE), "substring-windows")
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    schema = arrow_schema(result)

    def cut(batches):
        for batch in batches:
            for ids, owners, texts, anchors, found in zip(*(batch.column(i) for i in range(5))):
                own, at, high, low = extended(owners.as_py(), texts.as_py(), anchors.as_py())
                at = at[_of_hashes(high, low, found.as_py())]
                edges = np.zeros(len(own.hashes) + 1, np.int64)
                edges[at] += 1
                edges[at + WIDTH] -= 1
                keep = np.cumsum(edges)[:-1] == 0
                answers = []
                for text, start, n in zip(own.texts, own.starts.tolist(), own.sizes.tolist()):
                    kept = keep[start : start + n]
                    removed = n - int(kept.sum())
                    left = b" ".join(compress(text.split(), kept)) if removed else text
                    answers.append((n, removed, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
                rows = [(doc, *answers[o]) for doc, o in zip(ids.as_py(), owners.as_py())]
                for i in range(0, len(rows), 200):
                    yield _rows(rows[i : i + 200], schema)

    both = met.join(windows, "block", "left")
    return both.select("doc_ids", "owners", "texts", "anchors", "found").mapInArrow(frugal(cut), result)
