"""Tables without repeats, of one document, and with ids that several documents share."""

import random

import numpy as np
import pytest

import corpus_pipeline
from cairn.llm import jaccard, lm_score, vector_dedup
from cairn.llm.common import from_planes, packed, planes, unpacked
from tests.llm.conftest import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s0", None if t is None else len(t)) for d, t in rows], DOCS)


def test_arrays_of_no_items_come_back():
    for dtype in (np.uint8, np.uint32, np.uint64, jaccard.ROW):
        none = np.empty(0, dtype)
        assert len(from_planes(planes(none), dtype)) == 0
    assert len(unpacked(packed(np.empty(0, np.uint64)), np.uint64)) == 0


@pytest.mark.parametrize("rows", [[(1, "a b c d e f g")], [(i, prose(i, 60, 10**6)) for i in range(20)], [(1, None)], [(1, "")]])
def test_no_shingle_occurs_twice(spark, rows):
    docs = documents(spark, rows)
    got = {tuple(r) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {(d, len(set(zip(*[(t or "").split()[k:] for k in range(5)]))), d) for d, t in rows}
    assert sorted(r.doc_id for r in jaccard.keep_first(docs).collect()) == [d for d, _ in rows]


def test_one_row_of_other_operators(spark):
    assert lm_score.scores(documents(spark, [(1, "a b c")])).count() == 1
    one = spark.createDataFrame([(1, [0.5, 0.5], 0)], "vec_id long, embedding array<float>, label int")
    assert [r.n_links for r in vector_dedup.vector_duplicates(one).collect()] == [0]


def test_documents_that_share_an_id_are_judged_apart(spark):
    a, b, c, d = (prose(s, 80, 10**6) for s in range(4))
    near = a + " one more"
    rows = [(9001, a), (9001, b), (9001, b), (5, near), (9001, c), (9001, c + " and more"), (7, None), (7, None), (7, ""), (None, a), (8, d)]
    kept = [(r.doc_id, r.text) for r in jaccard.keep_first(documents(spark, rows)).collect()]
    of_c = [t for _, t in kept if t and t.startswith(c)]  # either text of the pair
    assert len(of_c) == 1
    assert sorted(kept, key=str) == sorted([(5, near), (9001, b), (9001, of_c[0]), (7, None), (7, None), (7, ""), (None, a), (8, d)], key=str)


def test_members_of_a_hot_lead_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_OF_KEY", 5)
    rng, base = random.Random(3), prose(4, 120, 10**6).split()
    rows = [(1, " ".join(base))]
    for i in range(40):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((10 + i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(documents(spark, rows)).collect()}
    assert got == {d: 1 for d, _ in rows}


@pytest.mark.parametrize("rows", [[(1, "a b c d e f g")], [(9001, prose(1, 60, 10**6)), (9001, prose(2, 60, 10**6))], []])
def test_stages_on_small_tables(spark, tmp_path, rows):
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i1", "q w e r t y u i o p a s d")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name not in ("mixing", "sharding"):
            assert sorted(tuple(r) for r in docs.select("doc_id", "text").collect()) == sorted(rows)
    assert {r.doc_id for r in docs.collect()} == {d for d, _ in rows}  # one may be taken twice
