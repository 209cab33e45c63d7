"""A model made once scores any documents by its filter alone."""

from cairn.llm import lm_score
from tests.llm.conftest import prose


def told(df):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in df.collect())


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_stored_segments_give_the_scores_of_the_corpus_itself(spark, monkeypatch, odd_documents):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 2000)
    docs = documents(spark, [(i, prose(i % 9, 120)) for i in range(40)] + [(None, "no id"), (77, None), (78, "")])
    assert told(lm_score.score_with(lm_score.fit(docs), docs)) == told(lm_score.scores(docs))
    assert told(lm_score.score_with(lm_score.fit(odd_documents), odd_documents)) == told(lm_score.scores(odd_documents))


def test_other_documents_are_scored_without_counts(spark):
    model = lm_score.fit(documents(spark, [(i, prose(i % 9, 150)) for i in range(60)]))
    other = [(1, prose(3, 150)), (2, " ".join(f"new{i}" for i in range(150))), (3, " ".join(reversed(prose(3, 150).split()))), (4, None)] + [(10 + i, prose(100 + i, 400)) for i in range(60)]
    got = {r.doc_id: r for r in lm_score.score_with(model, documents(spark, other)).collect()}
    assert set(got) == {d for d, _ in other} and got[2].n_known == 1 and got[4].n_tokens == 1  # the end is known
    each = lambda d: got[d].score / got[d].n_tokens
    assert each(1) > each(3) > each(2) and abs(got[1].base_score - got[3].base_score) < 1e-6


def test_a_model_of_nothing(spark):
    model = lm_score.fit(documents(spark, []))
    got = lm_score.score_with(model, documents(spark, [(1, "a b")])).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0)
