"""Language-model scores from a log-frequency Bloom filter.

Documents are packed into blocks of token numbers, each with its own sorted vocabulary of word
hashes, and written once. Unigram counts are exact: the blocks' vocabularies are summed by ranges
of the hash and the sums go back to the blocks. Each block's distinct bigrams and trigrams go to
the range of their hash with their training counts. There the counts of all blocks meet, are
quantised to powers of two and entered into the range's segment of the Bloom filter, one entry for
each level reached; the blocks' n-grams then probe the segment, one level after the other until one
is missing, and their levels go back to the blocks. So the filter may outgrow any worker, n-grams
move once, and no pass over the documents is repeated: segments go to the work of their range
instead of all going to every worker.

With q a level's lower bound and D the order's absolute discount from the exact numbers of n-grams
seen once and twice, the probability of a word after a context is

    max(q - D, 0) / c + D * c ** (growth - 1) * (probability by the shorter context),

c being the context's count (exact for one word, its level's lower bound for two) and c ** growth
the number of different words expected after it; ``growth`` is set so that these numbers add up to
the distinct n-grams, and with it the shares left to the shorter contexts to all discounts. One
discount for all counts: those set for each count take an n-gram seen twice for one seen once where
documents are copied, and copies would no longer score apart. Words alone have the base model's probability. A text begins after an end
and ends with one; its first word has a context of one.

Words are told apart by 64-bit hashes, n-grams by 48 bits. Null texts are empty: their only token is
the end. Without training documents every count is 0. Repeated rows count each. Rows without an id
train. A very long text is a block of its own and takes some thirty times its bytes in a worker. An
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import arrow_schema, frugal, input_bytes, materialise, packed, unpacked
from cairn.llm.jaccard import mixed

BLOCK_BYTES = 8 << 20
RANGE_BYTES, GRAM_RANGE_BYTES = 32 << 20, 16 << 20
#: Bits for each entry and probes of a level.
BITS, PROBES = 8, 3
#: Bits of an n-gram's hash.
GRAM_BITS = 48
END = np.uint64(0)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * _A ^ (word + _B))


class Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _zip(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1) if len(a) else b""


def _unzip(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.empty(0, dtype)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


BLOCK = "block string, doc_ids array<long>, held binary, sizes binary, tokens binary, words binary, counts binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """One row for each block: documents, token numbers in the order of the word hashes, and the vocabulary with its training counts."""
    schema = arrow_schema(BLOCK)

    def pack(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, held, sizes, numbers, size = [], [], [], [], 0
        words = Vocabulary({b"": 0})

        def close():
            nonlocal seq, size, words
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) or 1 for w in words), np.uint64, len(words))
            hashes[0] = END
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            tokens = rank[np.concatenate(numbers)]
            train = np.repeat(~np.array(held), sizes)
            counts = np.bincount(tokens[train], minlength=len(order)).astype(np.uint32)
            row = [f"{part}-{seq}", list(ids), np.array(held, np.uint8).tobytes(), np.array(sizes, np.uint32).tobytes(), _zip(tokens), packed(hashes[order]), _zip(counts)]
            seq, size, words = seq + 1, 0, Vocabulary({b"": 0})
            for x in (ids, held, sizes, numbers):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                own = [words[w] for w in data.lower().split()]
                own.append(0)
                ids.append(doc)
                held.append(bool(out))
                sizes.append(len(own))
                numbers.append(np.array(own, np.uint32))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield close()
        if ids:
            yield close()

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return materialise(docs.select("doc_id", held.alias("held"), "text").mapInArrow(frugal(pack), BLOCK), "lm-blocks")


def _by_range(values: np.ndarray, ranges: int, bits: int = 64) -> np.ndarray:
    """Where ascending hashes pass from one range to the next."""
    bounds = np.array([((i << bits) // ranges) for i in range(1, ranges)], np.uint64)
    return np.searchsorted(values, bounds)


WORD_SHARE, GRAM_SHARE = "block string, range int, words binary, counts binary", "block string, order int, range int, keys binary, counts binary"


def _word_shares(blocks: DataFrame, ranges: int) -> DataFrame:
    """Each block's vocabulary by ranges of the hash."""
    schema = arrow_schema(WORD_SHARE)

    def split(batches):
        for batch in batches:
            for block, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, counts = unpacked(words, np.uint64), _unzip(counts, np.uint32)
                cut = _by_range(words, ranges)
                rows = [(block, r, packed(w), _zip(c)) for r, (w, c) in enumerate(zip(np.split(words, cut), np.split(counts, cut))) if len(w)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return blocks.select("block", "words", "counts").mapInArrow(frugal(split), WORD_SHARE)


def _counted(blocks: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts over all blocks for each block's vocabulary, by range; sums for each range; and the ranges' own words with their counts."""

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        own = [unpacked(w, np.uint64) for w in rows["words"]]
        every, at = np.unique(np.concatenate(own), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([_unzip(c, np.uint32) for c in rows["counts"]])).astype(np.uint64)
        known = sums[sums > 0].astype(float)
        growth = [float((known**g).sum()) for g in GROWTHS]
        back = [_zip(sums[np.searchsorted(every, w)]) for w in own]
        first = np.arange(len(rows)) == 0
        return pd.DataFrame(
            {
                "block": rows["block"], "range": rows["range"], "counts": back,
                "tokens": np.where(first, int(sums.sum()), 0), "types": np.where(first, len(known), 0),
                "growth": [growth if f else [0.0] * len(GROWTHS) for f in first],
                "every": [packed(every[sums > 0]) if f and known.size else None for f in first], "sums": [_zip(sums[sums > 0]) if f else None for f in first],
            }
        )

    out = "block string, range int, counts binary, tokens long, types long, growth array<double>, every binary, sums binary"
    counted = _word_shares(blocks, ranges).groupBy("range").applyInPandas(frugal(total), out)
    counted = materialise(counted, "lm-counts")
    sums = counted.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), *[F.sum(F.element_at("growth", i + 1)).alias(f"g{i}") for i in range(len(GROWTHS))])
    return _by_block(counted, ["range", "counts"], "shares"), sums, counted.where("every is not null").select("range", "every", "sums")


def _by_block(told: DataFrame, columns: list[str], name: str) -> DataFrame:
    """What the ranges tell a block, in the order of the hashes."""
    return told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


GROWTHS = [0.4 + 0.05 * i for i in range(13)]


def _grams(sizes: np.ndarray, tokens: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the bigrams and the trigrams that end at each token, and where there is one: a text's first token ends no trigram."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    word = words[tokens]
    before = np.concatenate([[END], word[:-1]])
    before[starts] = END
    two = pair_hash(before, word)
    three = pair_hash(np.concatenate([[END], two[:-1]]), word)
    inner = np.ones(len(word), bool)
    inner[starts] = False
    return [(two >> np.uint64(64 - GRAM_BITS), np.ones(len(word), bool)), (three >> np.uint64(64 - GRAM_BITS), inner)]


def _gram_shares(blocks: DataFrame, ranges: int) -> DataFrame:
    """Each block's distinct n-grams by order and ranges of the hash, with their training counts."""
    schema = arrow_schema(GRAM_SHARE)

    def split(batches):
        for batch in batches:
            for block, held, sizes, tokens, words in zip(*(batch.column(i) for i in range(5))):
                sizes = np.frombuffer(sizes.as_py(), np.uint32)
                train = np.repeat(np.frombuffer(held.as_py(), np.uint8) == 0, sizes)
                found = _grams(sizes, _unzip(tokens.as_py(), np.uint32), unpacked(words.as_py(), np.uint64))
                rows = []
                for order, (keys, there) in enumerate(found, 2):
                    own, at = np.unique(keys[there], return_inverse=True)
                    counts = np.bincount(at[train[there]], minlength=len(own)).astype(np.uint32)
                    cut = _by_range(own, ranges, GRAM_BITS)
                    rows += [(block.as_py(), order, r, packed(k), _zip(c)) for r, (k, c) in enumerate(zip(np.split(own, cut), np.split(counts, cut))) if len(k)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return blocks.select("block", "held", "sizes", "tokens", "words").mapInArrow(frugal(split), GRAM_SHARE)


def _levels(blocks: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(block, order, levels by range) of each block's distinct n-grams in ascending order; figures of each order; and the filter's segments."""

    def quantise(rows: pd.DataFrame) -> pd.DataFrame:
        own = [unpacked(k, np.uint64) for k in rows["keys"]]
        every, at = np.unique(np.concatenate(own), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([_unzip(c, np.uint32) for c in rows["counts"]])).astype(np.int64)
        known, counts = every[sums > 0], sums[sums > 0]
        levels = np.log2(counts).astype(np.int64) + 1
        bits = np.zeros(-(-int(levels.sum()) * BITS // 64) * 64, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for probe in range(PROBES):
                bits[places(known[levels >= level], level, probe, len(bits))] = True
        found = level_of(every, np.packbits(bits), len(bits)).astype(np.uint8) if len(bits) else np.zeros(len(every), np.uint8)
        figures = [float((counts == 1).sum()), float((counts == 2).sum()), float(len(counts))]
        figures += [float((counts.astype(float) ** g).sum()) for g in GROWTHS]
        ends = np.cumsum([len(k) for k in own])
        back = [_zip(found[at[e - len(k) : e]]) for e, k in zip(ends, own)]
        first = np.arange(len(rows)) == 0
        return pd.DataFrame(
            {
                "block": rows["block"], "order": rows["order"], "range": rows["range"], "levels": back, "figures": [figures if f else [0.0] * len(figures) for f in first],
                "bits": [np.packbits(bits).tobytes() if f and len(bits) else None for f in first], "width": [len(bits) if f else 0 for f in first],
            }
        )

    out = "block string, order int, range int, levels binary, figures array<double>, bits binary, width long"
    found = materialise(_gram_shares(blocks, ranges).groupBy("order", "range").applyInPandas(frugal(quantise), out), "lm-levels")
    figures = found.groupBy("order").agg(F.array(*[F.sum(F.element_at("figures", i + 1)) for i in range(3 + len(GROWTHS))]).alias("figures"))
    return _by_block(found, ["order", "range", "levels"], "grams"), figures, found.where("bits is not null").select("order", "range", "bits", "width")


def places(hashes: np.ndarray, level: int, probe: int, size: int) -> np.ndarray:
    """Bit of an entry for one probe."""
    x = mixed(hashes + np.uint64((level * int(_A) + probe * int(_B)) % (1 << 64)))
    return ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def level_of(hashes: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Highest level of each hash up to which all levels are in the filter."""
    levels = np.zeros(len(hashes), np.int64)
    left, level = np.arange(len(hashes)), 1
    while len(left):
        for probe in range(PROBES):
            at = places(hashes[left], level, probe, size)
            left = left[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
        levels[left] = level
        level += 1
    return levels


class Smoothing(NamedTuple):
    """Discount and the growth of different words with a context's count, of one order."""

    discount: float
    growth: float

    @classmethod
    def of(cls, figures: list[float], contexts: list[float]) -> Smoothing:
        """From an order's figures and its contexts' sums of powers."""
        once, twice, types = figures[:3]
        discount = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5
        return cls(discount, float(np.interp(types, contexts, GROWTHS)) if types else 1.0)

    def probability(self, level: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """By n-gram level and context count; by the shorter context alone where this one is unknown."""
        known = np.maximum(context, 1.0)
        count = np.minimum(np.where(level > 0, np.exp2(level - 1.0), 0.0), known)
        own = np.maximum(count - self.discount, 0.0) / known
        return np.where(context > 0, own + self.discount * known ** (self.growth - 1) * lower, lower)


@dataclass
class Model:
    """What scoring needs of a training corpus: totals, the exact counts of its words, and the filter's segments, both by ranges of the hash."""

    tokens: int
    types: int
    bigrams: Smoothing
    trigrams: Smoothing
    words: DataFrame
    segments: DataFrame
    word_ranges: int
    gram_ranges: int
    bytes: int


def _fitted(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame, DataFrame]:
    """A model, and its own documents' blocks with what the ranges told them while it was made."""
    total = input_bytes(docs, "text")
    blocks = _blocks(docs)
    word_ranges, gram_ranges = max(8, -(-total // RANGE_BYTES)), max(8, -(-total // GRAM_RANGE_BYTES))
    shares, sums, words = _counted(blocks, word_ranges)
    sums = sums.first()
    grams, figures, segments = _levels(blocks, gram_ranges)
    figures = {r.order: list(r.figures) for r in figures.collect()}  # a row for each order
    none = [0.0] * (3 + len(GROWTHS))
    bigrams = Smoothing.of(figures.get(2, none), [sums[f"g{i}"] or 0 for i in range(len(GROWTHS))])
    trigrams = Smoothing.of(figures.get(3, none), figures.get(2, none)[3:])
    return Model(sums.tokens or 0, sums.types or 0, bigrams, trigrams, words, segments, word_ranges, gram_ranges, total), blocks, shares, grams


def fit(docs: DataFrame) -> Model:
    """The model of a corpus: of the documents whose id's checksum is not divisible by ten."""
    return _fitted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))[0]


def score_with(model: Model, docs: DataFrame) -> DataFrame:
    """Scores of any documents by a model made before: words are looked up in its counts, n-grams probe its filter.

    A range's segment meets the blocks' n-grams of that range; where there are more documents than the
    model was made of, it meets them in several groups.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _blocks(docs)
    groups = max(1, -(-input_bytes(docs, "text") // max(model.bytes, 1)))

    def met(shares: DataFrame, saved: DataFrame, keys: list[str], answer, out: str) -> DataFrame:
        group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
        asked = shares.withColumn("_group", group).groupBy(*keys, "_group")
        held = saved.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy(*keys, "_group")
        return asked.cogroup(held).applyInPandas(frugal(answer), out)

    def count(rows: pd.DataFrame, saved: pd.DataFrame) -> pd.DataFrame:
        every = unpacked(saved["every"].iloc[0], np.uint64) if len(saved) else np.empty(0, np.uint64)
        sums = _unzip(saved["sums"].iloc[0], np.uint64) if len(saved) else np.empty(0, np.uint64)
        back = []
        for words in rows["words"]:
            words = unpacked(words, np.uint64)
            at = np.minimum(np.searchsorted(every, words), max(len(every) - 1, 0))
            back.append(_zip(np.where(every[at] == words, sums[at], 0).astype(np.uint64) if len(every) else np.zeros(len(words), np.uint64)))
        return pd.DataFrame({"block": rows["block"], "range": rows["range"], "counts": back})

    def probe(rows: pd.DataFrame, saved: pd.DataFrame) -> pd.DataFrame:
        back = []
        for keys in rows["keys"]:
            keys = unpacked(keys, np.uint64)
            levels = level_of(keys, np.frombuffer(saved["bits"].iloc[0], np.uint8), int(saved["width"].iloc[0])) if len(saved) else np.zeros(len(keys), np.int64)
            back.append(_zip(levels.astype(np.uint8)))
        return pd.DataFrame({"block": rows["block"], "order": rows["order"], "range": rows["range"], "levels": back})

    shares = met(_word_shares(blocks, model.word_ranges), model.words, ["range"], count, "block string, range int, counts binary")
    grams = met(_gram_shares(blocks, model.gram_ranges), model.segments, ["order", "range"], probe, "block string, order int, range int, levels binary")
    return _scored(model, blocks, _by_block(shares, ["range", "counts"], "shares"), _by_block(grams, ["order", "range", "levels"], "grams"))


def scores(docs: DataFrame) -> DataFrame:
    """Base and model log-probabilities of every document by the model of them all.

    The same figures as ``score_with(fit(docs), docs)`` gives; here a segment is probed where it is made, so
    that the n-grams travel once.
    """
    return _scored(*_fitted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))


def _scored(model: Model, blocks: DataFrame, shares: DataFrame, grams: DataFrame) -> DataFrame:
    """Scores of blocks whose words have their counts and n-grams their levels."""
    tokens, bigrams, trigrams = model.tokens, model.bigrams, model.trigrams
    norm = tokens + 0.1 * (model.types + 1)
    joined = blocks.drop("counts").join(shares, "block").join(grams, "block").select("doc_ids", "held", "sizes", "tokens", "words", F.col("shares.counts").alias("counts"), "grams")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    schema = arrow_schema(out)

    def score(batches):
        for batch in batches:
            for ids, held, size, numbers, words, counts, grams in zip(*batch.columns):
                each = np.frombuffer(size.as_py(), np.uint32).astype(np.int64)
                numbers, words = _unzip(numbers.as_py(), np.uint32), unpacked(words.as_py(), np.uint64)
                count = np.concatenate([_unzip(c, np.uint64) for c in counts.as_py()]).astype(float)
                unigram = ((count + 0.1) / norm)[numbers]
                starts = np.concatenate([[0], np.cumsum(each)[:-1]]).astype(np.int64)
                shares, levels = grams.as_py(), []
                for order, (keys, there) in enumerate(_grams(each, numbers, words), 2):
                    found = np.zeros(len(keys), np.int64)
                    if there.any():
                        known = np.concatenate([_unzip(s["levels"], np.uint8) for s in shares if s["order"] == order])
                        found[there] = known[np.unique(keys[there], return_inverse=True)[1]]
                    levels.append(found)
                before = np.concatenate([[0], numbers[:-1]])
                before[starts] = 0  # the end has the smallest hash
                one = bigrams.probability(levels[0], count[before], unigram)
                context = np.concatenate([[0], levels[0][:-1]])
                context[starts] = 0
                value = np.log10(trigrams.probability(levels[1], np.where(context > 0, np.exp2(context - 1.0), 0.0), one))
                sums_ = [np.add.reduceat(x, starts) for x in (value, np.log10(unigram), (count[numbers] > 0).astype(np.int64))]
                columns = [ids.as_py(), np.frombuffer(held.as_py(), np.uint8) > 0, each, sums_[2], sums_[1], sums_[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    found = joined.mapInArrow(frugal(score), out)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
