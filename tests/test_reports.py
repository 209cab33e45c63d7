"""Every report against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from cairn import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def comparable(rows):
    text = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, row)) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_report_matches_its_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    wanted = duck.sql(catalogue.ORACLE_SQL[name])
    assert columns == sorted(wanted.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert comparable(found.select(*columns).collect()) == comparable(duck.sql(f"SELECT {listed} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())
