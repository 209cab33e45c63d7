"""Links across the borders of inverted lists."""

import numpy as np
import pytest

from cairn.llm import vector_dedup


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("directions", [2, 8])
def test_no_link_is_lost_in_a_hot_group_of_many_lists(spark, monkeypatch, directions, kind):
    monkeypatch.setattr(vector_dedup, "LIST_SIZE", 64)
    rng = np.random.default_rng(directions)
    x = rng.normal(size=32) + rng.normal(size=(1500, directions)) @ rng.normal(size=(directions, 32)) * 0.6 / directions**0.5
    x = x.astype("f4" if kind == "float" else "f8").astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(3)
    got = {r.vec_id: r.n_links for r in vector_dedup.vector_duplicates(df).collect()}
    u = x / np.sqrt((x * x).sum(1))[:, None]
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert want.sum() > 10_000
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_vectors_of_any_size_link_by_their_direction(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [3.0, 3.0]), (5, [5e-324, 5e-324]), (6, [1.7e308, -1.7e308]), (7, [1.0, -1.0]), (8, [0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (4, 1) for i in range(1, 6)}, 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_scaling_changes_no_digit():
    x = np.random.default_rng(1).normal(size=(200, 16)).astype("f4").astype(float)
    assert (vector_dedup.unit(x) == x / np.sqrt((x * x).sum(1))[:, None]).all()
