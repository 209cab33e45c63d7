"""Digests of trees are streamed."""

import hashlib

from cairn.operators import tree


def test_digests_are_streamed_in_path_order(spark):
    rows = [("a", f"p{i:06d}", "x" * (i % 3)) for i in range(25_000)] + [("b", "é", "y"), (None, "q", "z"), ("c", "n", None)]
    df = spark.createDataFrame(rows, "tree string, path string, fields string").repartition(5)
    found = tree.tree_digests(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    frame = lambda p, f: f"{len(p.encode())}:{p}{len(f.encode())}:{f}"
    want = {}
    for t, p, f in rows:
        want.setdefault(t, []).append("" if f is None else frame(p, f))
    assert {(r.tree, r.digest, r.records) for r in found.collect()} == {(t, hashlib.sha256("".join(x).encode()).hexdigest(), len(x)) for t, x in want.items()}
