"""What the quality classifier is trained on."""

import zlib

import pytest
from pyspark.sql import functions as F

from cairn.llm import quality
from tests.llm.conftest import prose


def test_all_labelled_documents_train_or_are_held(spark, monkeypatch):
    n, seen = 30_000, {}
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("w"), F.col("id") % 50).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") >= n).cast("int").alias("toxic"))
    train, markers, limits = quality.train, quality.markers, quality._limits
    monkeypatch.setattr(quality, "train", lambda d: (seen.update(trained=d.count()), train(d))[1])
    monkeypatch.setattr(quality, "markers", lambda toxic, trusted: (seen.update(toxic=toxic.count(), clean=trusted.count()), markers(toxic, trusted))[1])
    monkeypatch.setattr(quality, "_limits", lambda held: (seen.update(held=held.count()), limits(held))[1])
    quality.scored(docs, labels, ["doc_id"])
    trained = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(n))
    assert seen == {"trained": trained, "clean": trained, "toxic": n, "held": n - trained}


def test_results_do_not_depend_on_how_ids_and_tables_are_dealt(spark, monkeypatch):
    rows = [(i, prose(i, 30, 60), "en") for i in range(60)] + [(100, "Ünheard", "en"), (101, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    found = lambda: {r.doc_id: r for r in quality.scored(docs, labels, ["doc_id"], name="q").collect()}
    want = found()
    monkeypatch.setattr(quality, "SENT_IDS", 0)
    monkeypatch.setattr(quality, "SHARD_ROWS", 10)
    monkeypatch.setattr(quality, "SALT_BYTES", 100)
    got = found()
    assert got.keys() == want.keys()
    assert all(got[i].q_accepted == r.q_accepted and got[i].q_logp == pytest.approx(r.q_logp, rel=1e-6) for i, r in want.items())
