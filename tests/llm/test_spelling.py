"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter

import pytest

from cairn.llm import spelling
from tests.llm.conftest import row


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                word = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[word] += 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, forms = [], {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None
        out.append((w, n, len(found)))
    result = set()
    for w, n, number in out:
        root = w
        while forms[root]:
            root = forms[root]
        result.add((w, forms[w], root, n, number, words.get(forms[w])))
    return result


def found(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé÷") for _ in range(rng.randint(6, 8))) for _ in range(25)]
    variants = [w[:i] + rng.choice("abcÿ") + w[i + rng.randint(0, 1) :] for w in base for i in (0, 3, len(w) - 1, len(w))]
    many = [w for k, w in enumerate(base + variants) for _ in range(rng.choice([1, 4, 5, 6, 30, 200]) if k % 3 else 160)]
    rng.shuffle(many)
    return [(d, " ".join(w.upper() if rng.random() < 0.1 else w for w in many[d::40])) for d in range(40)] + [(None, "no id: " + " ".join(base[:5] * 3)), (7, None), (8, ""), (9, "1 2 3"), (3, many[0] + " abcabcabc" * 400)]


@pytest.mark.parametrize("nodes, round_bytes", [(spelling.SHARD_NODES, spelling.ROUND_BYTES), (60, 2000)])
def test_variants_equal_brute_force(spark, nodes, round_bytes):
    rows = texts(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = found(spelling.spelling_variants(docs, nodes, round_bytes))
    expected = brute(rows)
    assert len(got) == len(set(got)) and set(got) == expected
    assert any(form and root != form for _, form, root, *_ in expected), "no chain in the test data"


def test_near_words_of_random_tries():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))).encode() for _ in range(150)} | {b"a" * 300, b"a" * 301, b"a" * 150 + b"b" + b"a" * 149})
    trie = spelling.Trie.of(words, [1] * len(words))
    assert sorted(trie.word(i) for i, n in enumerate(trie.counts) if n) == words
    edits = lambda w: {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in (b"", b"a", b"b") for k in (0, 1)} - {w}
    for w in words + [b"", b"abababab"]:
        found = trie.near(w)
        assert len(found) == len(set(found)) and sorted(trie.word(i) for i in found) == sorted(edits(w) & set(words))


def test_odd_and_missing_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert set(found(spelling.spelling_variants(odd_documents))) == brute(rows)
    assert found(spelling.spelling_variants(no_documents)) == []


def test_one_document(spark):
    docs = spark.createDataFrame([row(1, "spelling " * 5)]).toDF(*[f"c{i}" for i in range(26)]).selectExpr("c0 AS doc_id", "c1 AS text", "1 AS word", "2 AS n")
    assert found(spelling.spelling_variants(docs)) == [("spelling", None, "spelling", 5, 0, None)]
