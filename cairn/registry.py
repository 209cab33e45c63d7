"""Where reports are registered with the SQL that checks them."""

from __future__ import annotations

from functools import wraps

from cairn.shipping import ship

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def report(oracle: str | None):
    """Registers a query under its name with its SQL."""

    def add(query):
        @wraps(query)
        def run(spark, sf_dir):
            ship(spark)
            return query(spark, sf_dir)

        QUERIES[query.__name__] = run
        if oracle:
            ORACLE_SQL[query.__name__] = oracle
        return query

    return add
