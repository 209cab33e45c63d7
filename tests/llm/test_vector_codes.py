"""Codes against plain Lloyd rounds over whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from cairn.llm import vector_codes
from cairn.llm.vector_codes import Bounds, squared


def brute(rows, dim):
    top = vector_codes.largest(dim)
    kept = [(i, [x for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[max(-top, min(top, math.floor(1024 * x))) for x in v] + [0] * (dim - len(v)) for _, v, _ in kept]
    step = dim // 4
    parts = [[tuple(w[k * step : (k + 1) * step]) for w in whole] for k in range(4)]
    books = [list(p[:256]) for p in parts]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assigned(k):
        seen = {}
        for p in parts[k]:
            if p not in seen:
                seen[p] = min((apart(p, e), i) for i, e in enumerate(books[k]))
        return [seen[p] for p in parts[k]]

    for _ in range(4):
        for k in range(4):
            groups = {}
            for p, (_, i) in zip(parts[k], assigned(k)):
                groups.setdefault(i, []).append(p)
            for i, members in groups.items():
                books[k][i] = tuple(sum(c) // len(members) for c in zip(*members))
    final = [assigned(k) for k in range(4)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(f[n][0] for f in final) for n in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted([(i, "".join(f"{f[n][1]:02x}" for f in final), errors[n], by_label[label], digest) for n, (i, _, label) in enumerate(kept)], key=str)


def found(df):
    return sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()], key=str)


def vectors(seed, n, dim, scale=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (7, dim))
    return [[float(x) for x in centres[i % 7] + rng.normal(0, 0.02, dim)] for i in range(n)]


ROWS = "vec_id long, embedding array<double>, label int"


@pytest.fixture()
def odd_vectors():
    rows = [(i, v, None if i % 5 == 0 else i % 3) for i, v in enumerate(vectors(1, 700, 16))]
    rows += [(900 + i, rows[3][1], 2) for i in range(50)]  # copies, a repeated row and equal ids
    rows += [(900, rows[3][1], 2), (900, rows[4][1], 1), (None, rows[5][1], 0)]
    rows += [(1000, None, 1), (1001, [0.1, None] * 8, 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] * 16, 1), (1004, [0.0] * 16, None), (1005, [-0.0005] * 16, 1)]
    return rows + [(1006, [], 1), (1007, [0.5] * 7, 1)]


def test_codes_equal_plain_rounds(spark, odd_vectors):
    df = spark.createDataFrame(odd_vectors, ROWS).selectExpr("*", "1 AS code", "2 AS error", "3 AS _label", "4 AS v").repartition(3)
    assert found(vector_codes.vector_codes(df)) == brute(odd_vectors, 16)


def test_ties_and_unused_entries(spark):
    rows = [(i, [float(x) for x in np.array([i % 9, i % 4, -(i % 3), 1, i % 2, 0, 0, i % 5]) / 1024], i % 2) for i in range(400)]
    assert found(vector_codes.vector_codes(spark.createDataFrame(rows, ROWS))) == brute(rows, 8)


def test_large_components(spark):
    rows = [(i, [x * 10.0 ** (i % 12) for x in v], 1) for i, v in enumerate(vectors(2, 300, 8))] + [(999, [1e300, -1e300] * 4, 1)]
    got = found(vector_codes.vector_codes(spark.createDataFrame(rows, ROWS)))
    expected = brute(rows, 8)
    most = (1 << 63) - 1
    assert got == [(i, c, e, min(le, most), d) for i, c, e, le, d in expected]


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(4, [0.25, 0.5, 0.75, 1.0], None)], [(2, [], 1), (1, [], 1)]])
def test_few_vectors(spark, rows):
    assert found(vector_codes.vector_codes(spark.createDataFrame(rows, ROWS))) == (brute(rows, 4) if rows and rows[0][1] is not None else [])


def test_bounds_prune_and_never_change_an_assignment():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (40, 6))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-9, 9, (3000, 6))
    x[:200] = x[200:400]
    entries = np.unique(x, axis=0)[:64].copy()
    bounds, _ = Bounds.measured(x, entries)
    looked = []
    for _ in range(8):
        before = entries
        entries = np.stack([x[bounds.entry == e].sum(0) // (bounds.entry == e).sum() if (bounds.entry == e).any() else before[e] for e in range(64)])
        bounds = Bounds.unpacked(bounds.packed(), len(x), 64)
        bounds.moved(before, entries)
        d2 = squared(x, entries)
        looked.append(bounds.assign(x, entries))
        assert (bounds.entry == d2.argmin(1)).all()
        assert (bounds.lower <= np.sqrt(d2)).all() and (bounds.upper >= np.sqrt(d2.min(1))).all()
    assert sum(looked) < 0.2 * 8 * x.shape[0] * 64 and looked[-1] < looked[0]
