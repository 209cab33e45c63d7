"""Quality classifier: interpolated modified Kneser-Ney model of trusted text.

Texts are read as UTF-8 bytes, so an n-gram of order five is a number below 2**40 and nothing is
blurred or hashed. Count and context tables are built by Spark from trusted documents; lower orders
are continuation counts of the order above. Tables and n-grams are dealt to shards by the two bytes
before the last, which an n-gram shares with its context and with all its suffixes of three bytes or
more; the tables of orders one and two, 65,536 rows at most, go to every shard. Documents are packed
into blocks of some megabytes; each block's distinct n-grams go to their shards, meet counts and
contexts there, are interpolated, and come back to the block, where they add up to each document's
perplexity. Blocks are dealt over salts and a shard's tables are repeated for each; a larger model has
more shards and as many salts fewer, so neither a task's share nor what is repeated for each block
grows with the input, as far as 65,536 pairs of bytes can be dealt evenly.

Blocks are packed twice, before and after their n-grams went out, so that texts are moved once; a
block is named by its n-grams, and should the second reading cut other blocks, the documents are
written down first and read again.

Per document this gives a perplexity for each byte, drawn towards the language's mean where the
text is short, and a document is rejected beyond a limit set by the quantiles of all trusted
documents of its language that the model was not trained on. A fifth of the trusted documents, told
by a hash of their ids, is held for this; all others train.

Bytes do not tell a fluent toxic text, so its words are read too: words are hashed into
``WORD_BUCKETS`` buckets, and those that documents labelled toxic hold significantly more often than
trusted ones are markers, weighted by the logarithm of the ratio. A document is also rejected where
the sum over its distinct markers exceeds ``TOXIC_QUANTILE`` of all trusted documents not trained
on and ``TOXIC_LEAST``. Without rows labelled toxic there are no markers.

Null and empty texts have no bytes and are accepted: nothing speaks against them. A language
without trusted documents, or null, takes the limit of all languages; one with fewer than
``LEAST_HELD`` takes this or its own, whichever accepts more. Without trusted documents
at all everything is accepted. Repeated rows are each judged, rows with equal ids by their own
texts. A very long text is a block of its own and read in pieces of ``PIECE_BYTES``. An empty table
gives an empty result. Extra columns are carried through and never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import arrow_schema, discard, from_planes, frugal, input_bytes, materialise, packed, planes, unpacked

ORDER, CLASSES = 5, 256
#: Ids that are sent to every task, so that no text moves to meet its label; more of them meet the documents by a shuffled join.
SENT_IDS = 4_000_000
#: Held documents that a language's own limit needs.
LEAST_HELD = 100
#: Bytes that a short text is mixed with at its language's mean.
PRIOR_BYTES = 200
#: The limit lies this many times as far from the median as the quantile does.
QUANTILE, MARGIN = 0.01, 2.0
BLOCK_BYTES, PIECE_BYTES = 1 << 21, 1 << 19
#: Shards of the n-grams at least, the rows of the model that one holds, and the input bytes whose blocks one of so many shards serves in one task.
SHARDS, SHARD_ROWS, SALT_BYTES = 61, 1_000_000, 2 << 30
WORD_BUCKETS = 1 << 20
#: The evidence (G squared) and weight that a marker needs; lighter words would add up in any long document.
MARKER_EVIDENCE, MARKER_WEIGHT = 25.0, 4.0
TOXIC_QUANTILE, TOXIC_LEAST = 0.999, 3.0
#: Documents read from a batch at once.
SLICE = 512


def text_bytes(text: str | None) -> bytes:
    """A text as the model reads it: 0 is left to mark its end."""
    return (text or "").encode("utf-8", "surrogatepass").replace(b"\x00", b" ")


def gram_pieces(texts: list[bytes], size: int = PIECE_BYTES):
    """Yields (n-grams, texts, starts) of pieces of the texts: an n-gram for each byte and for the end of each text, and where those of a text begin."""
    pad, own, begun = b"\x00" * (ORDER - 1), [], 0

    def codes(parts: list[tuple[int, bytes]]):
        joined = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
        n = len(joined) - ORDER + 1
        grams = joined[:n].astype(np.int64)
        for k in range(1, ORDER):
            grams <<= 8
            grams |= joined[k : n + k]
        lengths = np.array([len(p) for _, p in parts])
        keep = np.ones(n, bool)
        ends = np.cumsum(lengths)[:-1]
        for k in range(1, ORDER):  # what lies across two parts
            keep[ends - k] = False
        starts = np.cumsum(lengths - ORDER + 1) - (lengths - ORDER + 1)
        return grams[keep], np.array([i for i, _ in parts]), starts

    for i, text in enumerate(texts):
        whole = pad + text + b"\x00"
        for at in range(0, len(whole) - ORDER + 1, size):
            part = whole[at : at + size + ORDER - 1]
            if own and begun + len(part) > size:
                yield codes(own)
                own, begun = [], 0
            own.append((i, part))
            begun += len(part)
    if own:
        yield codes(own)


def _gram_counts(docs: DataFrame) -> DataFrame:
    """(g, c): n-grams with their counts by piece, as packed rows unfolded."""
    schema = arrow_schema("g long, c long")

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for grams, *_ in gram_pieces([text_bytes(t) for t in batch.column(0).slice(at, SLICE).to_pylist()]):
                    own, g = pd.factorize(grams)
                    c = np.bincount(own)
                    for i in range(0, len(g), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(g[i : i + (1 << 16)]), pa.array(c[i : i + (1 << 16)])], schema=schema)

    return docs.select("text").mapInArrow(frugal(count), "g long, c long")


def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes with small letters for capitals, and whether a byte is part of a word: letters, digits and bytes of other letters."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    part = np.zeros(256, bool)
    part[48:58] = part[97:123] = part[128:] = True
    return lower, part


def _bucket_pairs(texts: list[bytes], lower: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of its text and the bucket of each distinct word of a text."""
    prime = 0x100000001B3
    joined = lower[np.frombuffer(b" " + b"".join(t + b" " for t in texts), np.uint8)]
    power, inverse = (np.multiply.accumulate(np.full(len(joined), f, np.uint64)) for f in (prime, pow(prime, -1, 1 << 64)))
    inside = part[joined]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    words = (sums[ends] - sums[starts]) * inverse[starts]  # the same wherever a word stands
    words = (words ^ (words >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    pairs = np.unique((np.searchsorted(first, starts, "right") - 1) * WORD_BUCKETS + (words >> np.uint64(44)).astype(np.int64))
    return pairs // WORD_BUCKETS, pairs % WORD_BUCKETS


def word_blocks(texts: list[bytes], size: int = PIECE_BYTES):
    """Yields (texts, buckets) of blocks of texts: the number of its text and the bucket of each distinct word of a text."""
    lower, part = word_tables()
    space = bytes(0 if p else 1 for p in part[lower])
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= size):
            n += len(texts[j])
            j += 1
        if n <= size:
            at, buckets = _bucket_pairs(texts[i:j], lower, part)
            yield at + i, buckets
        else:  # one long text, in pieces that end between words
            found, begin = np.empty(0, np.int64), 0
            marks = texts[i].translate(space)
            while begin < n:
                end = n if n - begin <= size else marks.rfind(b"\x01", begin, begin + size) + 1 or n
                found = np.union1d(found, _bucket_pairs([texts[i][begin:end]], lower, part)[1])
                begin = end
            yield np.full(len(found), i), found
        i = j


def _word_counts(docs: DataFrame) -> DataFrame:
    """(b, c): in how many documents each bucket's words occur, by task; for b = -1 the number of documents."""
    schema = arrow_schema("b long, c long")

    def count(batches):
        total, n = np.zeros(WORD_BUCKETS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for at in range(0, batch.num_rows, SLICE):
                for _, buckets in word_blocks([text_bytes(t) for t in batch.column(0).slice(at, SLICE).to_pylist()]):
                    np.add.at(total, buckets, 1)
        b = np.flatnonzero(total)
        for i in range(0, len(b), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(b[i : i + (1 << 16)]), pa.array(total[b[i : i + (1 << 16)]])], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([n], pa.int64())], schema=schema)

    return docs.select("text").mapInArrow(frugal(count), "b long, c long")


def markers(toxic: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words that toxic documents hold significantly more often than trusted ones, and their weights; WORD_BUCKETS rows at most."""
    sides = [_word_counts(d).groupBy("b").agg(F.sum("c").alias(n)) for d, n in ((toxic, "x"), (trusted, "y"))]
    counts = materialise(sides[0].join(sides[1], "b", "left").fillna(0), "kn-words")
    n = counts.where("b = -1").first()
    if n is None or not n.x or not n.y:
        return np.empty(0, np.int64), np.empty(0)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    part = lambda c, of: F.when(c > 0, c * F.log(c / ((x + y) * (of / (n.x + n.y))))).otherwise(0.0)
    evidence = 2 * (part(x, n.x) + part(y, n.y))
    weight = F.log((x + 0.5) / (n.x + 1)) - F.log((y + 0.5) / (n.y + 1))
    found = counts.where("b >= 0").select("b", evidence.alias("g"), weight.alias("w")).where((F.col("g") >= MARKER_EVIDENCE) & (F.col("w") >= MARKER_WEIGHT)).toArrow()
    return found["b"].to_numpy(), found["w"].to_numpy()


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times; half a count less if one of these is missing."""
    if min(n) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    found = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]


Table = tuple[np.ndarray, np.ndarray, np.ndarray]


class Model(NamedTuple):
    """A Kneser-Ney model: ``rows`` (shard, order, context, key, x, y), those of orders one and two as ``common`` tables, and discounts by order."""

    rows: DataFrame
    common: dict[tuple[int, bool], Table]
    discounts: list[list[float]]


def shard_of(grams, shards: int = SHARDS):
    """Shard of n-grams by the two bytes before the last; a prime factor in the modulus reads both."""
    return grams // 256 % 65536 % shards


def train(trusted: DataFrame) -> Model:
    """Counts (key an n-gram, x its count) and contexts (key all but the last byte, x their total, y the share they leave to the order below)."""
    counts = materialise(_gram_counts(trusted).groupBy("g").agg(F.sum("c").alias("c")), "kn-counts")
    tables = [counts]
    for k in range(ORDER - 1, 0, -1):
        tables.insert(0, tables[0].groupBy((F.col("g") % CLASSES**k).alias("g")).agg(F.count("*").alias("c")))
    rows, found = None, []
    for k, t in enumerate(tables, 1):
        seen = t.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).first()
        d = discounts(list(seen))
        found.append(d)
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = t.groupBy(F.expr(f"g div {CLASSES}").alias("h")).agg(F.sum("c").alias("total"), (F.sum(discount) / F.sum("c")).alias("back"))
        part = t.select(F.expr(f"cast(g div 256 % 65536 % {SHARDS} as int)").alias("shard"), F.lit(k).alias("order"), F.lit(False).alias("context"), F.col("g").alias("key"), F.col("c").cast("double").alias("x"), F.lit(0.0).alias("y"))
        part = part.union(contexts.select(F.expr(f"cast(h % 65536 % {SHARDS} as int)"), F.lit(k), F.lit(True), "h", F.col("total").cast("double"), "back"))
        rows = part if rows is None else rows.union(part)
    rows = materialise(rows, "kn-model")
    discard(counts)
    common = _tables(rows.where("order <= 2").toPandas())  # CLASSES**2 n-grams, CLASSES bytes and contexts, and one, at most
    return Model(rows.where("order > 2"), common, found)


def _tables(rows: pd.DataFrame) -> dict[tuple[int, bool], Table]:
    """Ascending keys with their numbers, by order and kind."""
    out = {}
    for (order, context), own in rows.groupby(["order", "context"]):
        own = own.sort_values("key")
        out[int(order), bool(context)] = own["key"].to_numpy(np.int64), own["x"].to_numpy(float), own["y"].to_numpy(float)
    return out


def _found(table: Table | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the keys; zeros for those not in the table."""
    if table is None or not len(table[0]):
        return np.zeros(len(keys)), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    hit = table[0][at] == keys
    return np.where(hit, table[1][at], 0.0), np.where(hit, table[2][at], 0.0)


def interpolated(grams: np.ndarray, tables: dict[tuple[int, bool], Table], found_discounts: list[list[float]]) -> np.ndarray:
    """Natural logarithm of the probability of each n-gram's last byte after the others."""
    p = np.full(len(grams), 1.0 / CLASSES)
    for k, d in enumerate(found_discounts, 1):
        own = grams & (CLASSES**k - 1)
        count, _ = _found(tables.get((k, False)), own)
        total, back = _found(tables.get((k, True)), own >> 8)
        less = np.select([count == 0, count == 1, count == 2], [0.0, d[0], d[1]], d[2])
        p = np.where(total > 0, (count - less) / np.maximum(total, 1.0) + back * p, p)
    return np.log(p)


BLOCK = "block string, salt int, batch binary, grams binary"


def _distinct(texts: list[bytes]) -> np.ndarray:
    """Distinct n-grams of the texts, ascending."""
    return np.unique(np.concatenate([np.empty(0, np.int64), *(pd.unique(grams) for grams, *_ in gram_pieces(texts))]))


#: Compression of the texts on their way; a fifth less than at the least level for a hundredth of a second a MB.
LEVEL = 6


def _blocks(docs: DataFrame, at: int, salts: int) -> DataFrame:
    """One row for each block: a name made of its distinct n-grams, its rows as an Arrow message, and these n-grams, packed. The texts are column ``at``."""
    schema = arrow_schema(BLOCK)

    def pack(batches):
        held, texts, size = [], [], 0

        def close():
            nonlocal held, texts, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
                for h in held:
                    out.write_batch(h)
            grams = _distinct(texts)
            name = hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest()
            row = [name, int(name[:8], 16) % salts, sink.getvalue().to_pybytes(), packed(grams)]
            held, texts, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column(at)):
                data = text_bytes(text.as_py())
                if texts and size + len(data) > BLOCK_BYTES:
                    if i > first:
                        held.append(batch.slice(first, i - first))
                    yield close()
                    first = i
                texts.append(data)
                size += len(data)
            if batch.num_rows > first:
                held.append(batch.slice(first))
        if held:
            yield close()

    return docs.mapInArrow(frugal(pack), BLOCK)


def _shares(blocks: DataFrame, shards: int) -> DataFrame:
    """(block, salt, shard, grams): each block's distinct n-grams by shard."""
    out = "block string, salt int, shard int, grams binary"
    schema = arrow_schema(out)

    def split(batches):
        for batch in batches:
            for block, salt, grams in zip(*(batch.column(i) for i in range(3))):
                grams = unpacked(grams.as_py(), np.int64)
                own = shard_of(grams, shards)
                order = np.argsort(own, kind="stable")
                grams, cut = grams[order], np.searchsorted(own[order], np.arange(1, shards))
                rows = [(block.as_py(), salt.as_py(), s, packed(g)) for s, g in enumerate(np.split(grams, cut)) if len(g)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return blocks.select("block", "salt", "grams").mapInArrow(frugal(split), out)


def _returned(shares: DataFrame, model: Model, salts: int, shards: int) -> DataFrame:
    """(block, shares): the log-probabilities of each block's n-grams by shard, in their order."""
    common, found_discounts = model.common, model.discounts
    shard = F.expr(f"cast((case when context then key else key div {CLASSES} end) % 65536 % {shards} as int)")
    tables = model.rows.withColumn("shard", shard).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def look_up(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        tables = common | _tables(rows)
        own = [unpacked(g, np.int64) for g in asked["grams"]]
        every = np.unique(np.concatenate(own)) if own else np.empty(0, np.int64)
        logp = interpolated(every, tables, found_discounts).astype(np.float32)
        return pd.DataFrame({"block": asked["block"], "shard": asked["shard"], "logp": [planes(logp[np.searchsorted(every, g)]) for g in own]})

    both = shares.groupBy("salt", "shard").cogroup(tables.groupBy("salt", "shard"))
    found = both.applyInPandas(frugal(look_up), "block string, shard int, logp binary")
    return found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "logp"))).alias("shares"))


def _toxicity(texts: list[bytes], buckets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's distinct markers."""
    out = np.zeros(len(texts))
    if len(buckets):
        order = np.argsort(buckets)
        buckets, weights = buckets[order], weights[order]
        for at, found in word_blocks(texts):
            place = np.minimum(np.searchsorted(buckets, found), len(buckets) - 1)
            hit = buckets[place] == found
            out += np.bincount(at[hit], weights=weights[place[hit]], minlength=len(texts))
    return out


def log_sums(texts: list[bytes], grams: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log-probability of each text from those of ascending n-grams."""
    out = np.zeros(len(texts))
    for own, at, starts in gram_pieces(texts):
        place, distinct = pd.factorize(own)
        np.add.at(out, at, np.add.reduceat(logp[np.searchsorted(grams, distinct)][place], starts))
    return out


def _summed(docs: DataFrame, text: str, dropped: str, new: list[str], model: Model, buckets: np.ndarray, weights: np.ndarray) -> DataFrame:
    """The documents without column ``dropped``, with bytes, log-probability (null where their block was not met) and toxicity of their texts."""
    shards = SHARDS * max(1, -(-model.rows.count() // (SHARDS * SHARD_ROWS)))
    salts, at = max(1, -(-input_bytes(docs, text) * SHARDS // (SALT_BYTES * shards))), docs.columns.index(text)
    blocks = _blocks(docs, at, salts)
    met = blocks.select("block", "batch").join(_returned(_shares(blocks, shards), model, salts, shards), "block", "left").select("batch", "shares")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(dropped).schema) + f", `{new[0]}` long, `{new[1]}` double, `{new[2]}` double"
    arrow = arrow_schema(out)

    def score(batches):
        for batch in batches:
            for message, shares in zip(*batch.columns):
                held = [own.slice(begin, SLICE) for own in pa.ipc.open_stream(message.as_buffer()) for begin in range(0, own.num_rows, SLICE)]
                grams = _distinct([text_bytes(t) for rows in held for t in rows.column(at).to_pylist()])  # made again: the texts are here, so they need not travel
                logp = np.full(len(grams), np.nan)
                found = {s["shard"]: s["logp"] for s in shares.as_py() or []}  # equal blocks have one name and equal shares
                if found:
                    logp[np.argsort(shard_of(grams, shards), kind="stable")] = np.concatenate([from_planes(x, np.float32) for x in found.values()])
                for rows in held:
                    texts = [text_bytes(t) for t in rows.column(at).to_pylist()]
                    sums = log_sums(texts, grams, logp)
                    added = [pa.array([len(t) for t in texts], pa.int64()), pa.array(sums, mask=np.isnan(sums)), pa.array(_toxicity(texts, buckets, weights))]
                    yield pa.RecordBatch.from_arrays([*(rows.column(i).cast(arrow.field(i).type) for i in range(len(arrow) - 3)), *added], schema=arrow)

    return met.mapInArrow(frugal(score), out)


def scored(docs: DataFrame, labels: DataFrame, columns: list[str], trusted_documents: int | None = None, name: str = "") -> DataFrame:
    """``columns`` of each document with ``{name}_n_bytes``, ``_logp`` (mean for each byte, shrunk), ``_limit``, ``_toxic`` and ``_accepted``.

    ``labels`` has doc_id, quality and perhaps toxic; documents of quality 1 that are not toxic
    are trusted; four fifths of them train, or of ``trusted_documents`` of them if that is given.
    ``name`` keeps the new columns apart from others.
    """
    spark = docs.sparkSession
    good = F.col("quality") == 1
    if "toxic" in labels.columns:
        good &= F.coalesce("toxic", F.lit(0)) == 0
    ids = labels.where(good & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_trusted")).distinct()
    trained = _training_ids(docs, ids, trusted_documents)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = _of_ids(read, trained)
    model = train(training)
    bad = labels.where((F.col("toxic") == 1) if "toxic" in labels.columns else F.lit(False)).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_bad")).distinct()
    buckets, weights = markers(_of_ids(read, materialise(bad, "kn-toxic")), training)

    keys = [f"{name}_id", f"{name}_lang", f"{name}_text"]
    carried = docs.select(*columns, *[F.col(c).cast(t).alias(k) for c, t, k in zip(("doc_id", "lang", "text"), ("long", "string", "string"), keys)])
    if "text" in columns:  # once is enough
        carried = carried.drop(keys[2])
    text = "text" if "text" in columns else keys[2]
    summed = [f"{name}_n_bytes", f"{name}_sum", f"{name}_toxic"]
    found = materialise(_summed(carried, text, keys[2], summed, model, buckets, weights), "kn-scores")
    if not found.where(F.col(summed[1]).isNull()).isEmpty():  # the documents came in other blocks the second time
        discard(found)
        found = materialise(_summed(materialise(carried, "kn-documents"), text, keys[2], summed, model, buckets, weights), "kn-scores")

    lang = F.col(keys[1])
    narrow = found.select(F.col(keys[0]).alias("_id"), lang.alias("lang"), F.col(f"{name}_n_bytes").alias("_n_bytes"), F.col(f"{name}_sum").alias("_sum"), F.col(f"{name}_toxic").alias("_toxic"))
    held = narrow.join(ids, F.col("_id") == F.col("_trusted"), "left_semi").join(trained, F.col("_id") == F.col("_trusted"), "left_anti")
    held = materialise(held, "kn-held")
    limits, overall = _limits(held)
    most = max(TOXIC_LEAST, held.agg(F.percentile_approx("_toxic", TOXIC_QUANTILE, 100_000)).first()[0] or 0.0)
    by = [f"{name}_by_{c}" for c in ("lang", "mean", "limit")]
    by_lang = spark.createDataFrame(limits, f"`{by[0]}` string, `{by[1]}` double, `{by[2]}` double")  # a row for each language with trusted documents
    found = found.join(F.broadcast(by_lang), lang == F.col(by[0]), "left")
    mean, limit = F.coalesce(by[1], F.lit(overall[0])), F.coalesce(by[2], F.lit(overall[1]))
    logp = (F.col(f"{name}_sum") + PRIOR_BYTES * mean) / (F.col(f"{name}_n_bytes") + 1 + PRIOR_BYTES)
    return found.select(
        *columns, f"{name}_n_bytes", logp.alias(f"{name}_logp"), limit.alias(f"{name}_limit"), f"{name}_toxic", ((logp >= limit) & (F.col(f"{name}_toxic") <= most)).alias(f"{name}_accepted")
    )


def _of_ids(read: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents (doc_id, text) whose id is in the one column of ``ids``."""
    return read.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, F.col("doc_id") == F.col(ids.columns[0]), "left_semi")


def _training_ids(docs: DataFrame, ids: DataFrame, trusted_documents: int | None) -> DataFrame:
    """(_trusted): ids of the documents to train on: all that are not held, or a number that the languages share as evenly as they can."""
    trains = F.crc32(F.col("_trusted").cast("string").cast("binary")) % 5 != 0
    if trusted_documents is None:
        return materialise(ids.where(trains), "kn-trained")
    rows = docs.select(F.col("doc_id").cast("long").alias("_trusted"), F.col("lang").cast("string").alias("lang")).join(ids, "_trusted")
    rows = materialise(rows.where(trains), "kn-trusted")
    counts = sorted((r["count"], r.lang or "", r.lang) for r in rows.groupBy("lang").count().collect())
    left, rates = trusted_documents * 0.8, []
    for i, (n, _, lang) in enumerate(counts):
        share = min(n, left / (len(counts) - i))
        rates.append((lang, share / n))
        left -= share
    table = docs.sparkSession.createDataFrame(rates, "_lang string, _rate double")
    drawn = F.pmod(F.xxhash64("_trusted"), F.lit(1 << 30)) < F.col("_rate") * (1 << 30)
    rows = rows.join(F.broadcast(table), F.col("lang").eqNullSafe(F.col("_lang"))).where(drawn)
    return materialise(rows.select("_trusted").distinct(), "kn-trained")


def _limits(held: DataFrame) -> tuple[list[tuple[str, float, float]], tuple[float, float]]:
    """Mean and limit of the log-probability by language, and over all; languages are few and named by trusted documents only."""
    means = {r.lang: (r.s, r.n) for r in held.groupBy("lang").agg(F.sum("_sum").alias("s"), F.sum(F.col("_n_bytes") + 1).alias("n")).collect()}
    if not means:
        return [], (0.0, -math.inf)
    total = sum(s for s, _ in means.values()) / sum(n for _, n in means.values())
    table = held.sparkSession.createDataFrame([(k, s / n) for k, (s, n) in means.items()], "_lang string, _mean double")
    rows = held.join(F.broadcast(table), F.col("lang").eqNullSafe(F.col("_lang")))
    own = (F.col("_sum") + PRIOR_BYTES * F.col("_mean")) / (F.col("_n_bytes") + 1 + PRIOR_BYTES)
    at = F.percentile_approx(own, [QUANTILE, 0.5], 10_000)
    limit = lambda q: q[1] - MARGIN * max(q[1] - q[0], 0.02)
    found = rows.groupBy("lang").agg(at.alias("q"), F.count("*").alias("n")).collect()
    sure = [limit(r.q) for r in found if r.n >= LEAST_HELD]
    overall = min(sure) if sure else limit(rows.agg(at.alias("q")).first().q)
    by = [(r.lang, means[r.lang][0] / means[r.lang][1], limit(r.q) if r.n >= LEAST_HELD else min(overall, limit(r.q))) for r in found]
    return [b for b in by if b[0] is not None], (total, overall)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Perplexity for each byte, limit and verdict of every document."""
    found = scored(docs.select("doc_id", "lang", "text"), labels, ["doc_id", "lang"])
    return found.select(
        "doc_id",
        "lang",
        F.col("_n_bytes").alias("n_bytes"),
        F.exp(-F.col("_logp")).alias("perplexity"),
        F.exp(-F.col("_limit")).alias("max_perplexity"),
        F.col("_accepted").alias("accepted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, all columns in their order."""
    name = f"kn_{uuid.uuid4().hex}"  # no column of the documents has it
    return scored(docs, labels, docs.columns, name=name).where(f"`{name}_accepted`").select(*docs.columns)
