"""What only tables larger than the sample ones show: numbers beyond 64 bits, sizes beyond gibibytes, many objects and many subtrees."""

import pytest
from pyspark.sql import functions as F

from cairn import catalogue


@pytest.mark.parametrize("name", ["cache_identities", "entry_changes", "hash_group_members", "hash_groups", "metadata_screen", "same_size_bands", "same_size_page", "same_size_page_after", "selection_bindings"])
def test_times_beyond_64_bits_stay_exact(spark, tmp_path, name):
    rows = [(i, "t" * 1600 + str(i // 2), "en", "src1") for i in range(88_228, 88_240)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert found or name == "same_size_page_after"
    if name == "selection_bindings":
        assert {int(r.binding.split(":")[2]) for r in found} == {1_600_000_000_000_000_000 + i * 86_400_000_000_000 for i in range(88_228, 88_240, 2)}


def test_all_images_of_an_engine_are_told(spark, tmp_path):
    spark.createDataFrame([(i, 3 if i < 300 else 9) for i in range(310)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(3,), (4,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    found = catalogue.QUERIES["engine_images"](spark, str(tmp_path)).collect()
    assert sorted((r.context, r.created, r.truncated) for r in found) == [(3, i * 10, False) for i in range(300)]


def test_sizes_for_people_end_with_gibibytes(spark, tmp_path):
    spark.createDataFrame([(200_039,), (39,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = {r.id: r.size for r in catalogue.QUERIES["sizes_for_people"](spark, str(tmp_path)).collect()}
    assert found == {200_039: f"{200_039**2 * 39 / 2**30:.1f} GiB", 39: f"{39**3 / 1024:.1f} KiB"}


def test_any_number_of_subtrees_is_read_and_purged(spark, tmp_path):
    from cairn.plans.clustered import MAX_TOPS, ClusteredTable

    n = 2 * MAX_TOPS + 100
    rows = spark.range(n).selectExpr("1L AS root_id", "explode(array('p' || id, 'p' || id || '/a', 'p' || id || '/a/b', 'p' || id || '!')) AS path").withColumn("path", F.col("path").cast("binary"))
    table = ClusteredTable(spark, str(tmp_path / "t"))
    table.write(rows, 4)
    tops = spark.range(n - 1).selectExpr("1L AS root_id", "cast('p' || id AS binary) AS path", "id % 2 = 0 AS keep_anchor")
    assert table.subtrees(tops).groupBy("_top").count().where("count = 3").count() == n - 1
    assert table.purge(tops, None)["rewritten"] == 4
    left = {bytes(r.path).decode() for r in table.read().collect()}
    last = {f"p{n - 1}{end}" for end in ("", "/a", "/a/b")}
    assert left == {f"p{i}!" for i in range(n)} | {f"p{i}" for i in range(0, n - 1, 2)} | last


def test_projects_are_laid_out_in_enough_tasks(spark, monkeypatch):
    from cairn.sources import projects

    monkeypatch.setattr(projects, "TASK_DOCUMENTS", 20)  # of 200 documents
    for made in (projects.entries, projects.passes):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [doc_id" in plan and ", 10" in plan and plan.count("Generate explode") == 1
