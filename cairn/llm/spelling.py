"""Spelling variants: words at distance one, found by Levenshtein automata in compact tries.

The vocabulary is sorted and cut into shards; a task builds each shard's trie, level by level: a
letter, where the node's children begin and the count of the word that ends there, some 13 bytes a node. Shards
are broadcast, as many at once as ``ROUND_BYTES`` allows. Every word's automaton is intersected with
every shard depth-first: the set of states (letters read without error; letters read with one inserted,
deleted or replaced) goes down with the letters, and a subtree is left when the set is empty. The
accepted words are reduced in place to their number and the best form, and the rounds' answers are
merged. Roots follow the forms by doubling; a form has at least ``FACTOR`` times its word's count,
so chains are short.

A shard holds at most ``SHARD_NODES`` nodes, or one word where that alone is longer. Null and empty
texts hold no words. Repeated rows count each. A row without an id is taken as one with the empty id.
A very long text is split into its runs at once. Ties of counts go to the smallest word in code-point
order. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import arrow_schema, discard, frugal, give_back, materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LETTERS, OCCURRENCES, FACTOR, MISSPELT = 6, 5, 5, 199
#: Distinct words, and their letters, that a task counts before it sends them on.
HELD_WORDS, HELD_LETTERS = 100_000, 8 << 20
SHARD_NODES = 400_000
ROUND_BYTES = 48 << 20


def deleted(doc_id, run: str) -> str:
    """A run of a document, one letter of which is lost where the checksum says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of enough letters and occurrences over all documents."""
    schema = arrow_schema("word string, n long")

    def count(batches):
        held, letters = Counter(), 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lowered = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
                for run, n in Counter(RUN.findall(lowered)).items():
                    if len(run) >= LETTERS:
                        word = deleted("" if doc is None else doc, run)
                        if len(word) >= LETTERS:
                            if word not in held:
                                letters += len(word)
                            held[word] += n
                if len(held) >= HELD_WORDS or letters >= HELD_LETTERS:
                    yield out()
                    held.clear()
                    letters = 0
        yield out()

    counts = docs.select("doc_id", "text").mapInArrow(frugal(count), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class Trie:
    """Words of Latin-1 letters level by level, so that a node's children stand together; node 0 is the root.

    ``letters`` has each node's letter, ``first`` where its children begin, which is where those of the
    node before it end, and ``counts`` that of the word that ends there.
    """

    def __init__(self, letters: bytes, first, counts):
        self.letters, self.first, self.counts = letters, first, counts

    @classmethod
    def of(cls, words: list[bytes], counts: list[int]) -> Trie:
        """From words in ascending order, each once."""
        letters, first, own, depth = bytearray(1), [], [0], 0
        level = [(0, len(words))]  # the words below each node of a level
        while level:
            below = []
            for low, high in level:
                first.append(len(letters))
                at = low
                while at < high and len(words[at]) == depth:
                    at += 1  # the word that ends at the node itself
                while at < high:
                    c, begin = words[at][depth], at
                    while at < high and words[at][depth] == c:
                        at += 1
                    letters.append(c)
                    own.append(counts[begin] if len(words[begin]) == depth + 1 else 0)
                    below.append((begin, at))
            level, depth = below, depth + 1
        return cls(bytes(letters), [*first, len(letters)], own)

    def near(self, word: bytes) -> list[int]:
        """Nodes of the words at a distance of exactly one."""
        letters, first, counts, size = self.letters, self.first, self.counts, len(word)
        find, found, stack = letters.find, [], []
        # the way of the word itself: below each of its nodes one error may happen
        node, depth = 0, 0
        while True:
            low, high = first[node], first[node + 1]
            here = word[depth] if depth < size else -1
            then = word[depth + 1] if depth + 1 < size else -1
            over, on = size - depth - 1, -1  # letters of the word beyond the trie's
            for child in range(low, high):
                c = letters[child]
                # states with one error as bits: 1 for one letter less of the word read than of the trie, 2 for as many, 4 for one more
                after = 1 if c == here else 3 if here >= 0 else 1
                if c == then:
                    after |= 4
                if c == here:
                    on = child
                if counts[child] and (over == -1 or over == 0 and after & 2 or over == 1 and (after & 4 or c == here)):
                    found.append(child)
                if over >= 0:
                    stack.append((child, depth + 1, after))
            if on < 0:
                break
            node, depth = on, depth + 1
        while stack:
            node, depth, states = stack.pop()
            low, high = first[node], first[node + 1]
            if low == high:
                continue
            over, after = size - depth - 1, {}
            if states & 1:
                after[word[depth - 1]] = 1
            if states & 2 and depth < size:
                after[word[depth]] = after.get(word[depth], 0) | 2
            if states & 4 and depth + 1 < size:
                after[word[depth + 1]] = after.get(word[depth + 1], 0) | 4
            for c, bits in after.items():
                child = find(c, low, high)
                if child >= 0:
                    if counts[child] and (over == -1 and bits & 1 or over == 0 and bits & 2 or over == 1 and bits & 4):
                        found.append(child)
                    if over >= 0:
                        stack.append((child, depth + 1, bits))
        return list(set(found))  # a word with doubled letters is met on more than one way

    def word(self, node: int) -> bytes:
        out = bytearray()
        while node:
            out.append(self.letters[node])
            node = bisect_right(self.first, node) - 1  # its parent: of the nodes that begin there, the last has the children
        return bytes(out[::-1])


SHARD = "shard string, bytes long, letters binary, first binary, counts binary"


def _shards(words: DataFrame, nodes: int) -> DataFrame:
    """Tries of runs of the sorted vocabulary."""
    schema = arrow_schema(SHARD)
    letters = words.agg(F.coalesce(F.sum(F.char_length("word")), F.lit(0))).first()[0]
    parts = max(1, letters // (4 * nodes))

    def build(batches):
        own, counts, size, made = [], [], 0, 0

        def close():
            nonlocal made
            made += 1
            trie = Trie.of(own, counts)
            n = len(trie.letters)
            parts = [trie.letters, array("I", trie.first).tobytes(), array("q", trie.counts).tobytes()]
            row = [f"{TaskContext.get().partitionId():09d}-{made:09d}", 13 * n, *parts]
            own.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own and size + len(word) > nodes:  # the letters are at least the nodes
                    yield close()
                    size = 0
                own.append(word.encode("latin-1"))
                counts.append(n)
                size += len(word)
        if own:
            yield close()

    ordered = words.repartitionByRange(parts, "word").sortWithinPartitions("word")
    return materialise(ordered.select("word", "n").mapInArrow(frugal(build), SHARD), "spelling-shards")


NEAR = "word string, n_near long, best struct<less: long, form: string>"


def _accepted(words: DataFrame, tries) -> DataFrame:
    """For every word with neighbours in the shards sent: their number, and the best of them."""
    schema = arrow_schema("word string, n_near long, less long, form string")

    def search(batches):
        own = [Trie(letters, memoryview(first).cast("I"), memoryview(counts).cast("q")) for letters, first, counts in tries.value]
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                plain, number, best = word.encode("latin-1"), 0, None
                for trie in own:
                    found = trie.near(plain)
                    number += len(found)
                    if found:
                        most = max(trie.counts[i] for i in found)
                        form = min((-most, trie.word(i)) for i in found if trie.counts[i] == most)
                        best = min(best, form) if best else form
                if number:
                    rows.append((word, number, best[0], best[1].decode("latin-1")))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    found = words.select("word").mapInArrow(frugal(search), "word string, n_near long, less long, form string")
    return found.select("word", "n_near", F.struct("less", "form").alias("best"))


def _neighbours(words: DataFrame, nodes: int, round_bytes: int) -> DataFrame:
    spark = words.sparkSession
    shards = _shards(words, nodes)
    sizes = sorted(tuple(r) for r in shards.select("shard", "bytes").collect())  # a row for each shard of the vocabulary
    filled = accumulate(sizes, lambda at, s: (at[0] + (at[1] + s[1] > round_bytes), s[1] if at[1] + s[1] > round_bytes else at[1] + s[1]), initial=(0, 0))
    rounds: dict[int, list[str]] = {}
    for (shard, _), (number, _) in zip(sizes, list(filled)[1:]):
        rounds.setdefault(number, []).append(shard)
    tables = []
    spread = words.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for names in rounds.values():
        payload = [tuple(bytes(x) for x in r) for r in shards.where(F.col("shard").between(names[0], names[-1])).select("letters", "first", "counts").collect()]
        tries = spark.sparkContext.broadcast(payload)
        tables.append(materialise(_accepted(spread, tries), "spelling-near"))
        tries.destroy()
        give_back()
    discard(shards)
    if not tables:
        return spark.createDataFrame([], NEAR)
    found = tables[0]
    for t in tables[1:]:
        found = found.union(t)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): the last form from each word that has one; ``most`` is the largest count."""
    chain, reach, steps = forms.select("word", F.col("form").alias("root")), 1, 1
    while OCCURRENCES * FACTOR**steps <= most:
        steps += 1
    while reach < steps:
        chain = materialise(chain, "spelling-roots")
        up = chain.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        chain = chain.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"))
        reach *= 2
    return chain


def spelling_variants(docs: DataFrame, nodes: int = SHARD_NODES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Every word of the vocabulary with its count, its number of near words, its form, that form's count and its root."""
    words = materialise(vocabulary(docs), "spelling-words")
    near = _neighbours(words, nodes, round_bytes)
    found = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= FACTOR * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    found = materialise(found, "spelling-forms")
    roots = _roots(found.where("form is not null"), words.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
