"""Token-id output: one zstandard frame for each document, all with one trained dictionary.

A store is two tables in the shared folder. ``dictionary`` holds the dictionary and its hash.
``containers`` holds blocks of documents in ascending id order: the id range, the hash of the
dictionary, an offset index (ids, token counts, frame offsets) and the frames back to back. A
short document is read by row groups whose id ranges hold it, a search in the index and one frame.

Null texts are empty: their only token is the end id. Rows with equal ids stay apart, in order of
their texts' hashes. An empty table gives a store without containers.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import arrow_schema, frugal, materialise

END_ID = 0
#: Stands for a null document id in the index; read back as null.
NO_ID = -(1 << 63)
#: Documents whose id arrays the dictionary is trained on, those first in a hashed order of the ids.
TRAINING_DOCUMENTS = 400
#: A point read compares the containers' id ranges with this many intervals at most, in which its ids lie.
INTERVALS = 64
#: Bytes of a row group of containers, the unit that a point read reads or skips.
ROW_GROUP = 8 << 20
DICTIONARY_BYTES = 64 << 10
CONTAINER_TOKENS = 1 << 20
#: Distinct runs of text whose ids a worker remembers.
CACHE_RUNS = 600_000
LEVEL = 3
#: Documents encoded at once.
SLICE = 256


#: The pre-tokeniser's pattern for texts of ASCII and Latin-1 letters; other texts are left to the library as a whole.
SPACE, MARKS = r" \t\n\r\x0b\x0c", r"!-/:-@\[-`{-~"
RUNS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[{MARKS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory(dict):
    """Results of a function by key; forgets what was not asked for during about ``most`` new keys."""

    def __init__(self, most: int, compute):
        super().__init__()
        self.most, self.compute, self.old = most // 2, compute, {}

    def __missing__(self, key):
        found = self.old.get(key)
        self[key] = found = self.compute(key) if found is None else found
        return found

    def make_room(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Encodes whole texts with a byte-level BPE, remembering the ids of runs.

    Merges never cross the runs that the pre-tokeniser makes. Texts of ASCII and Latin-1 letters
    are cut into these runs here and each new run is encoded once by the library's model; any
    other text, and one that holds an added token's content, is encoded whole by the library. Both
    ways give the ids of the library's plain call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Tokens that the library finds in raw text before it cuts runs.
        self.markers = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.runs = Memory(CACHE_RUNS, self._run)
        self.alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})

    def _bytes(self, ids: list[int]) -> bytes:
        found = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _run(self, run: str) -> bytes:
        mapped = run.encode("utf-8").decode("latin-1").translate(self.alphabet)
        return self._bytes([token.id for token in self.model.tokenize(mapped)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned ids of each text, ``width`` bytes each."""
        self.runs.make_room()
        known = self.runs.__getitem__
        out: list[bytes | None] = []
        for text in texts:
            runs = RUNS.findall(text) if not any(m in text for m in self.markers) else []
            out.append(b"".join(map(known, runs)) if len("".join(runs)) == len(text) else None)
        whole = iter(self._library([t for t, o in zip(texts, out) if o is None]))
        return [next(whole) if o is None else o for o in out]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process; its memory of pieces lasts over tasks."""
    return Encoder(path)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; the samples themselves, cut to its size, if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _compression_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


@dataclass
class Store:
    dictionary: DataFrame  # dict_hash, width, data
    containers: DataFrame  # part, seq, first_doc, last_doc, n_docs, n_ids, dict_hash, index, body


CONTAINER = "part int, seq int, first_doc long, last_doc long, n_docs int, n_ids long, dict_hash string, index binary, body binary"


def _sample(docs: DataFrame) -> list:
    """Rows of the training documents; a threshold on the hash keeps all but about twice as many from the driver."""
    named = docs.where("doc_id is not null")
    rate = 2 * TRAINING_DOCUMENTS / max(named.count(), 1)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = named.where(order < int(min(1.0, rate) * (1 << 30)) + 1).select(order.alias("_order"), "doc_id", "text")
    return few.orderBy("_order", "doc_id", F.xxhash64("text")).limit(TRAINING_DOCUMENTS).select("text").collect()


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> Store:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = _sample(docs)
    trained = Encoder(tokenizer_path)
    width = trained.width
    data = train_dictionary(trained.encode([r.text for r in sample]))
    dict_hash = hashlib.sha256(data).hexdigest()
    dictionary = materialise(spark.createDataFrame([(dict_hash, width, bytearray(data))], "dict_hash string, width int, data binary"), "token-dictionary")
    end = trained._bytes([end_id])
    schema = arrow_schema(CONTAINER)

    def containers(batches):
        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer_path).encode
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_compression_dictionary(data), write_content_size=True)
        ids, counts, frames = [], [], []
        size = 0

        def close():
            nonlocal seq, size
            index = np.empty(len(ids), [("doc", "<i8"), ("n", "<u4"), ("at", "<u4")])
            index["doc"], index["n"] = ids, counts
            index["at"] = np.cumsum([0, *map(len, frames[:-1])])
            row = [part, seq, ids[0], ids[-1], len(ids), sum(counts), dict_hash, index.tobytes(), b"".join(frames)]
            seq, size = seq + 1, 0
            for x in (ids, counts, frames):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                doc_ids, texts = (c.to_pylist() for c in batch.slice(at, SLICE).columns)
                for doc, tokens in zip(doc_ids, encode(texts)):
                    tokens += end
                    ids.append(NO_ID if doc is None else doc)
                    counts.append(len(tokens) // width)
                    frames.append(press.compress(tokens))
                    size += counts[-1]
                    if size >= CONTAINER_TOKENS:
                        yield close()
        if ids:
            yield close()

    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return Store(dictionary, materialise(ordered.mapInArrow(frugal(containers), CONTAINER), "token-containers", options={"parquet.block.size": str(ROW_GROUP)}))


def holds_any(ids: list[int], intervals: int = INTERVALS):
    """Condition that a container's id range meets the ids' intervals: plain comparisons, which the scan skips row groups by."""
    ids = sorted(ids)
    gaps = sorted(sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: intervals - 1])
    out = F.lit(False)
    for a, b in zip([0, *gaps], [*gaps, len(ids)]):
        if a < b:
            out = out | ((F.col("first_doc") <= ids[b - 1]) & (F.col("last_doc") >= ids[a]))
    return out


def read_documents(store: Store, doc_ids: DataFrame | None = None) -> DataFrame:
    """(part, seq, nth, doc_id, n_tokens, ids) of all documents, or of those asked for.

    ``doc_ids`` (column ``doc_id``) is matched with the containers' id ranges, then with their indexes.
    """
    info = store.dictionary.first()
    data, width, dict_hash = bytes(info.data), info.width, info.dict_hash
    out = "part int, seq int, nth int, doc_id long, n_tokens long, ids binary"
    schema = arrow_schema(out)
    wanted = None
    rows = store.containers
    if doc_ids is not None:
        wanted = {r.doc_id for r in doc_ids.select("doc_id").where("doc_id is not null").distinct().collect()}  # a point read names its documents
        rows = rows.where(holds_any(list(wanted)))

    def read(batches):
        expand = zstandard.ZstdDecompressor(dict_data=_compression_dictionary(data))
        for batch in batches:
            for part, seq, known, index, body in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "dict_hash", "index", "body"))):
                if known != dict_hash:
                    raise ValueError("the container was written with another dictionary")
                entries = np.frombuffer(index, [("doc", "<i8"), ("n", "<u4"), ("at", "<u4")])
                ends = [*entries["at"][1:].tolist(), len(body)]
                chosen = range(len(entries)) if wanted is None else [i for w in sorted(wanted) for i in range(*np.searchsorted(entries["doc"], [w, w + 1]))]
                columns = [[] for _ in schema]
                for i in chosen:
                    ids = expand.decompress(body[entries["at"][i] : ends[i]])
                    ids = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    for column, value in zip(columns, (part, seq, i, None if entries["doc"][i] == NO_ID else int(entries["doc"][i]), int(entries["n"][i]), ids)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(frugal(read), out)


def container_starts(store: Store) -> DataFrame:
    """(part, seq, start): ids before each container. Sums run within parts; of the parts only totals are ordered."""
    sizes = store.containers.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_in", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("_before") + F.col("_in")).alias("start"))


def document_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Start, token count and CRC of every document, as read back from a store."""
    store = write_store(docs, tokenizer_path)
    out = "part int, seq int, doc_id long, rel long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(out)

    def digest(batches):
        at = (None, None, 0)  # container and ids of it so far
        for batch in batches:
            columns = [[] for _ in schema]
            for part, seq, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_id", "n_tokens", "ids"))):
                before = at[2] if at[:2] == (part, seq) else 0
                at = (part, seq, before + n)
                for column, value in zip(columns, (part, seq, doc, before, n, zlib.crc32(ids))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = read_documents(store).mapInArrow(frugal(digest), out)
    return rows.join(container_starts(store), ["part", "seq"]).select("doc_id", (F.col("start") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")
