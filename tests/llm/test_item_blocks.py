"""Benchmarks of several blocks, and documents with columns of any type."""

import pytest
from pyspark.sql import functions as F

from cairn.llm import decontaminate
from tests.llm.conftest import prose


@pytest.fixture()
def case(spark):
    items = [(f"i{i}", prose(500 + i, 14, 10**6)) for i in range(9)]
    rows = [(d, f"{prose(d, 30)} {items[d % 9][1] if d % 3 else ''} {prose(d + 99, 20)} {items[(d + 4) % 9][1] if d % 4 == 1 else ''}") for d in range(30)] + [(5, prose(7, 12)), (5, prose(7, 12)), (None, items[0][1]), (31, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tags": F.create_map(F.lit("a"), F.col("doc_id")), "deep": F.array(F.struct("doc_id"))}).repartition(3)
    return docs, spark.createDataFrame(items, "item_id string, text string")


def told(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("block_words", [14, 40, 90])
def test_blocks_tell_what_one_block_tells(case, block_words):
    docs, items = case
    whole = decontaminate.contaminated_documents(docs, items)
    assert told(decontaminate.contaminated_documents(docs, items, block_words=block_words)) == told(whole)
    assert whole.where("contaminated").count() > 15
    kept = decontaminate.decontaminate(docs, items)
    got = decontaminate.decontaminate(docs, items, block_words=block_words)
    assert got.columns == docs.columns and told(got) == told(kept)
