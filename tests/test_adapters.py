"""Inventory relations keep every file."""

from cairn.sources import adapters


def test_more_than_128_languages_keep_their_files(spark, tmp_path):
    rows = [(i, f"t{i}", f"l{i:03d}", f"src{i % 5}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert adapters.entries(spark, str(tmp_path)).select("root_id").distinct().count() == 200


def test_null_texts_and_languages_are_files(spark, tmp_path):
    rows = [(i, None if i % 10 == 0 else f"t{i % 7}", None if i % 9 == 0 else "en", "src1") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = adapters.entries(spark, str(tmp_path))
    assert found.count() == 100 and found.where("size = 0").count() == 10
    assert {r.path.decode() for r in adapters.roots(spark, str(tmp_path)).collect()} == {"/", "/en"}


def test_only_what_is_asked_for_is_read(spark):
    plan = adapters.entries(spark, "/root/testdata/sf0.001", ["size"])._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "Join" not in plan
