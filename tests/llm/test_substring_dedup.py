"""Removed windows against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import substring_dedup
from tests.llm.conftest import prose

WIDTH = substring_dedup.WIDTH


def brute(rows):
    words = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in rows]
    starts = Counter(tuple(w[i : i + WIDTH]) for _, w in words for i in range(len(w) - WIDTH + 1))
    out = []
    for doc, w in words:
        keep = [True] * len(w)
        for i in range(len(w) - WIDTH + 1):
            if starts[tuple(w[i : i + WIDTH])] > 1:
                keep[i : i + WIDTH] = [False] * WIDTH
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out.append((doc, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()], key=str)


def planted():
    passages = [prose(100 + i, n, 5000) for i, n in enumerate((34, 35, 36, 47, 48, 60, 400))]
    rows = [(d, f"{prose(d, 11 * d % 97, 5000)} {passages[d % 7]}\n{prose(d + 500, 7 * d % 61, 5000)}") for d in range(60)]
    rows += [(100, passages[3] + " " + passages[3]), (101, "same " * 200), (102, "same " * 34), (103, "a b " * 40), (104, None), (105, ""), (106, " \t\n"), (None, passages[6])]
    rows += [(107 + i, prose(9, 300)) for i in range(5)] + [(107, prose(9, 300)), (107, "another text"), (120, prose(10, 20_000, 3000) + " " + passages[5]), (121, prose(9, 300).upper())]
    shared = prose(11, 80, 5000).split()  # three texts that share 34, 35 and 36 words of one passage at other places
    return rows + [(130 + k, " ".join([f"x{k}"] * k + shared[20 - k : 55] + [f"y{k}"] * 9)) for k in range(3)]


def test_removed_words_equal_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(substring_dedup.remove_repeats(docs)) == brute(rows)


def test_blocks_meet(spark, monkeypatch):
    rows = planted()
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 4000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    assert found(substring_dedup.remove_repeats(docs)) == brute(rows)


def test_odd_and_missing_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert found(substring_dedup.remove_repeats(odd_documents)) == brute(rows)
    assert found(substring_dedup.remove_repeats(no_documents)) == []


def test_one_document_and_distinct_documents(spark):
    for rows in ([(1, "a b c")], [(i, prose(i, 100, 10**6)) for i in range(9)]):
        assert found(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 80), st.integers(0, 12)), min_size=1, max_size=6), st.integers(0, 99))
def test_every_window_that_occurs_again_is_a_candidate(parts, seed):
    shared = prose(seed, 100, 300).split()
    texts = [" ".join([f"p{i}.{j}" for j in range(skip)] + shared[begin : begin + 35 + more]) for i, (begin, skip, more) in enumerate(parts)]
    texts = list(dict.fromkeys(texts))
    block = substring_dedup.Block(list(range(len(texts))), substring_dedup.zstandard.compress("\n".join(texts).encode()))
    at, hashes = block.anchors()
    counts = Counter(hashes.tolist())
    near, _, _ = block.candidates(at, np.array([counts[h] > 1 for h in hashes.tolist()], bool))
    words = [w for t in texts for w in t.split()]
    windows = {i: tuple(words[i : i + WIDTH]) for i in np.flatnonzero(block.left >= WIDTH).tolist()}
    often = Counter(windows.values())
    assert {i for i, w in windows.items() if often[w] > 1} <= set(near.tolist())


def test_texts_are_hashed_alike_in_pieces_and_together(monkeypatch):
    texts = [t.encode() for t in ("", "a b c", prose(1, 400), "é x\u00a0y " * 50 + "end", "", prose(2, 3), "w" * 300 + " z")]
    whole, counts = substring_dedup.word_hashes(texts, fold=False)
    for piece in (1, 40, 333, 10**6):
        monkeypatch.setattr(substring_dedup, "PIECE_BYTES", piece)
        monkeypatch.setattr("cairn.llm.jaccard.BLOCK_BYTES", piece)
        got, sizes = substring_dedup._hashed(texts)
        assert (got == whole).all() and sizes.tolist() == counts.tolist()
