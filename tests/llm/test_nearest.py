"""Nearest vectors against brute force where codes or a sample tell little: near copies, and queries unlike the rows."""

import numpy as np
import pytest

from tunelode.llm import ivfpq

N, D = 6_000, 32


def near_copies(rng):
    return np.repeat(rng.standard_normal((15, D)), N // 15, axis=0) + 1e-3 * rng.standard_normal((N, D))


def odd_queries(rng):
    x = np.repeat(rng.standard_normal((60, D)), N // 60, axis=0) + 0.1 * rng.standard_normal((N, D))
    x[::50] = rng.standard_normal((N // 50, D))
    return x


def lone_rows(rng):
    """Nearly all are copies of a few rows; lists of the others hold fewer than five."""
    x = np.repeat(rng.standard_normal((20, D)), N // 20, axis=0)
    x[::49] = rng.standard_normal((len(x[::49]), D))
    return x


@pytest.mark.parametrize("made", [near_copies, odd_queries, lone_rows])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearly_all_of_the_nearest_are_found(spark, made, kind):
    rng = np.random.default_rng(8)
    x = made(rng).astype(np.float32).astype(np.float64)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"vec_id long, embedding array<{kind}>")
    got = ivfpq.search(rows, "vec_id % 50 = 0").collect()
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    score = unit[::50] @ unit.T
    score[np.arange(N // 50), np.arange(0, N, 50)] = -9
    fifth = np.sort(score, axis=1)[:, -5]
    assert len(got) == 5 * N // 50 and len({(r.query_id, r.vec_id) for r in got}) == len(got)
    assert np.mean([r.score >= fifth[r.query_id // 50] - 1e-12 for r in got]) > 0.95
    assert all(abs(r.score - score[r.query_id // 50, r.vec_id]) < 1e-12 for r in got)
