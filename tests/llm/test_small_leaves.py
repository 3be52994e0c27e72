"""Queries that lead to leaves with fewer rows than a list has."""

import numpy as np
import pytest

from blockloom.llm import neighbours


def clustered():
    """Six clusters of 250 vectors on axes of their own, and one of 8 so far away that it is a leaf by itself."""
    r = np.random.default_rng(11)
    x = np.repeat(10 * np.eye(8)[:6], 250, axis=0) + 0.05 * r.normal(size=(1500, 8))
    far = 1000 * np.eye(8)[7] + r.normal(size=(8, 8))
    return [(20 * i + (i % 20 != 0), row.tolist()) for i, row in enumerate(np.concatenate([x, far]))] + [(40_000, far[0].tolist())]


@pytest.mark.parametrize("recall", [0.95, 0.1])
def test_every_query_gets_a_full_list(spark, recall):
    rows = clustered()
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=recall).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    assert {len(set(ids)) for ids in got.values()} == {20}
    far = {i for i, _ in rows[1500:]}
    assert all(set(got[q][:8]) == far - {q} for q in far if q % 20 == 0)
