"""Toxic documents that are fluent."""

import random

from pyspark.sql import functions as F

from cairn.llm import quality
from tests.llm.conftest import prose


def test_fluent_toxic_documents_are_rejected(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    unseen = labels.withColumn("toxic", F.when((F.col("toxic") == 1) & (F.col("doc_id") % 3 == 0), None).otherwise(F.col("toxic")))  # a third is not shown as toxic
    unseen = unseen.where("toxic is not null")
    marked = docs.select("doc_id", F.lower("text").rlike("loser|idiot|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid").alias("marked"))  # others labelled toxic hold none of its words
    rows = quality.classify(docs, unseen).join(labels, "doc_id").join(marked, "doc_id").where("quality = 1").collect()
    clean = [r.accepted for r in rows if r.toxic == 0]
    toxic = [r.accepted for r in rows if r.toxic == 1 and r.marked and r.doc_id % 3 == 0]
    assert len(toxic) >= 5 and sum(toxic) <= 0.1 * len(toxic) and sum(clean) >= 0.99 * len(clean)


def test_words_have_one_bucket_wherever_they_stand():
    words = prose(1, 50).split()
    own = {w: next(quality.word_blocks([w.encode()]))[1].tolist() for w in words}
    assert len({b[0] for b in own.values()}) == len(set(words))
    random.Random(1).shuffle(words)
    texts = [b"", " ".join(words).upper().encode(), b"...", f"({words[0]}),{words[1]}".encode()]
    found = [(t, b) for ts, bs in quality.word_blocks(texts, 100) for t, b in zip(ts.tolist(), bs.tolist())]
    assert {b for t, b in found if t == 1} == {b[0] for b in own.values()}
    assert {b for t, b in found if t == 3} == {own[w][0] for w in words[:2]} and {t for t, _ in found} <= {1, 3}
