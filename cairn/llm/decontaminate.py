"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items form one suffix automaton. Each document's words are
streamed through it; the state and the length of the longest match say, at every word, whether a
window of an item ends there and which items hold that window. Words inside such a window are hit.

A window is ``WINDOW`` consecutive words of an item; a shorter item is one window. Items are
streamed and the automaton is built for blocks that end with the item that reaches ``block_words``
words, so what is broadcast has a bound, the longest item added. Where there are several blocks the
documents are numbered and written once, and what the blocks tell is merged by number.

Null, empty or wordless texts have no words and are clean. Null or wordless items are never found,
nor are any in an empty table of items. Repeated rows are each judged. Null item ids are skipped.
An empty table of documents gives an empty result. A very long text is read whole, word by word; it
takes its list of words. Extra columns are carried through and not read, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import arrow_schema, materialise

WINDOW = 10
#: Item words of one automaton; measured, 200,000 take 134 MB in the driver and in each worker.
BLOCK_WORDS = 200_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Lower-cases A-Z and turns everything that is no word byte into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of 0-9, a-z and characters beyond ASCII, after A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Suffix automaton over words of several items, with the items of every window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.reach = [self._reach(s) for s in range(len(self.next))]
        self.whole: dict[int, list[tuple[int, object]]] = {}  # state -> short items (length, id) whose last word is here
        self.owners: dict[int, set] = {}  # state -> items that hold its window
        for item, words in items:
            state = matched = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                matched += 1
                if matched >= window:
                    self.owners.setdefault(self.reach[state], set()).add(item)
            if 0 < len(words) < window:
                self.whole.setdefault(state, []).append((len(words), item))
        # nearest state on the way to the root that ends a short item, itself included
        self.short = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[s] = s if s in self.whole else self.short[self.link[s]]

    def _new(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for the shorter strings of q, those that end the strings of p plus the word."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:  # an earlier item has this string
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        end = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = end
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[end] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return end

    def _reach(self, s: int) -> int:
        """The state of the last ``window`` words of s's strings; -1 if these are shorter."""
        if self.length[s] < self.window:
            return -1
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def find(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Spans of hit words as [start, end), merged and ascending, and the items found."""
        edges, link, length, reach, short, window = self.next, self.link, self.length, self.reach, self.short, self.window
        spans: list[list[int]] = []
        states: set[int] = set()
        items: set = set()
        has_short = bool(self.whole)
        root = edges[0]
        state = matched = 0
        for i, word in enumerate(words):
            to = edges[state].get(word)
            if to is None:
                if word not in root:
                    state = matched = 0
                    continue
                while to is None:
                    state = link[state]
                    to = edges[state].get(word)
                matched = length[state]
            state = to
            matched += 1
            start = i + 1
            if matched >= window:
                states.add(reach[state])
                start = i + 1 - window
            if has_short:
                s = short[state]
                while s > 0:
                    for n, item in self.whole[s]:
                        if n <= matched:
                            items.add(item)
                            start = min(start, i + 1 - n)
                    s = short[link[s]]
            if start <= i:
                while spans and spans[-1][1] >= start and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        for s in states:
            items |= self.owners[s]
        return spans, items


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    block, size = [], 0
    for item, text in items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        words = words_of(text)
        block.append((item, words))
        size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    yield block


def contamination(docs: DataFrame, items: DataFrame, columns: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS, name: str = "") -> DataFrame:
    """``columns`` of each document with its word count, hit spans (word numbers, [start, end)) and the items found.

    The new columns are ``{name}_n_words``, ``{name}_spans`` and ``{name}_items``.
    """
    spark = docs.sparkSession
    out = f"`{name}_n_words` long, `{name}_spans` array<array<int>>, `{name}_items` array<string>"

    def scanned(rows: DataFrame, columns: list[str], block) -> DataFrame:
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", " + out
        arrow = arrow_schema(schema)

        def scan(batches):
            automaton = shared.value
            for batch in batches:
                counts, spans, names = [], [], []
                for text in batch.column(batch.num_columns - 1):
                    words = words_of(text.as_py())
                    at, who = automaton.find(words)
                    counts.append(len(words))
                    spans.append(at)
                    names.append(sorted(str(x) for x in who))
                kept = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*(a.cast(arrow.field(i).type) for i, a in enumerate(kept)), pa.array(counts, pa.int64()), pa.array(spans, arrow.field(len(arrow) - 2).type), pa.array(names, arrow.field(len(arrow) - 1).type)],
                    schema=arrow,
                )

        return rows.select(*columns, F.col("text").alias(f"{name}_text")).mapInArrow(scan, schema)

    blocks = _blocks(items, block_words)
    first, second = next(blocks), next(blocks, None)
    if not second:
        return scanned(docs, columns, first)
    # several blocks tell of the same documents, which are numbered for that, whatever their columns hold
    number = f"{name}_row"
    rows = materialise(docs.select(*dict.fromkeys([*columns, "text"])).withColumn(number, F.monotonically_increasing_id()), "contamination-rows")
    parts = None
    for block in chain([first, second], blocks):
        part = scanned(rows, [number], block)
        parts = part if parts is None else parts.union(part)
    return rows.select(number, *columns).join(_merge(parts, number, name), number).drop(number)


def _merge(parts: DataFrame, number: str, name: str) -> DataFrame:
    """One row for each document from its rows by block."""
    words, spans, items = f"{name}_n_words", f"{name}_spans", f"{name}_items"
    lists = F.array_sort(F.flatten(F.collect_list(spans)))
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(last(acc)[0], F.greatest(last(acc)[1], s[1]))))
    joined = F.aggregate(lists, F.array().cast("array<array<int>>"), lambda acc, s: F.when((F.size(acc) > 0) & (F.get(F.get(acc, F.size(acc) - 1), F.lit(1)) >= s[0]), longer(acc, s)).otherwise(F.concat(acc, F.array(s))))
    return parts.groupBy(number).agg(F.max(words).alias(words), joined.alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))


def hit_words(spans: str = "_spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def contaminated_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), items, ["doc_id"], window, block_words)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_items")), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
        F.col("_spans").alias("spans"),
    )


def without_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without its hit words and what lies between them."""
    if text is None:
        return None
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(bytes(b + 32 if 65 <= b <= 90 else b for b in data))]
    kept, last = [], 0
    for start, end in spans:
        kept.append(data[last : at[start][0]])
        last = at[end - 1][1]
    kept.append(data[last:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents with hit spans removed from their text; those with a larger share of hit words are dropped.

    All columns of ``docs`` come back in their order; clean rows are unchanged.
    """
    columns, name = docs.columns, f"hit_{uuid.uuid4().hex}"  # no column of the documents has it
    spans = f"{name}_spans"
    found = contamination(docs, items, columns, window, block_words, name)
    found = found.where((F.size(spans) == 0) | (hit_words(spans) <= F.col(f"{name}_n_words") * max_coverage))
    cut = F.udf(without_spans, "string")
    hit = F.when(F.size(spans) > 0, F.col("text"))  # null for clean rows, whose texts then stay in the JVM
    return found.withColumn("text", F.coalesce(cut(hit, spans), "text")).select(*columns)
