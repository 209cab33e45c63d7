"""Whether rows of a group disagree, in aggregates that hash instead of sorting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def differ(*columns: str | Column) -> Column:
    """Whether the rows of a group differ in any of some numbers.

    Two rows that differ do so in some column, so each column's least and largest value are enough; they
    are plain numbers, which Spark keeps in a hash table, where the least of a struct makes it sort. A null
    is a value of its own.
    """
    one = lambda c: (F.min(c) != F.max(c)) | (F.count(c) < F.count("*")) & (F.count(c) > 0)
    return reduce(lambda a, b: a | b, (F.coalesce(one(F.col(c) if isinstance(c, str) else c), F.lit(False)) for c in columns))
