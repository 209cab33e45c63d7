"""What the limits of the quality classifier are taken from."""

from pyspark.sql import functions as F

from cairn.llm import quality
from tests.llm.conftest import prose


def test_a_rare_language_is_not_stricter_than_all_languages(spark):
    rows = [("en", 1000, -2000.0 - i % 50) for i in range(300)] + [("xx", 1000, -1500.0)]
    limits, overall = quality._limits(spark.createDataFrame(rows, "lang string, _n_bytes long, _sum double"))
    by = {b[0]: b[2] for b in limits}
    assert by["en"] == overall[1] and by["xx"] <= overall[1]


def test_limits_cover_all_trusted_documents_not_trained_on(spark, monkeypatch):
    rows = [(i, "en" if i % 20 else "xx", prose(i, 20)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    seen, limits = {}, quality._limits
    monkeypatch.setattr(quality, "_limits", lambda held: (seen.update({r.lang: r["count"] for r in held.groupBy("lang").count().collect()}), limits(held))[1])
    quality.scored(docs, labels, ["doc_id", "lang"], 50).count()
    assert seen["en"] >= 570 - 40 and 1 <= seen["xx"] < 30  # equal shares: both languages train
