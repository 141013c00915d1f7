"""Nearest neighbours on ties, doubles, crowded directions and clashing names."""

import random
from collections import defaultdict

import numpy as np
import pytest

from granary.llm import hilbert


def ranks(rows, query):
    return [r.vec_id for r in sorted((r for r in rows if r.query_id == query), key=lambda r: r.rank)]


def test_multiples_tie(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    rows = [(i, (base * (i + 1)).tolist()) for i in range(61)] + [(1000 + i, rng.normal(size=8).tolist()) for i in range(200)]
    random.Random(1).shuffle(rows)
    got = hilbert.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert ranks(got, 0) == [1, 2, 3, 4, 5] and ranks(got, 50) == [0, 1, 2, 3, 4]


def test_equal_scores_of_unlike_vectors(spark):
    rows = [(i, [1.0 if j == i % 40 else 0.0 for j in range(40)]) for i in range(40)]  # every other one has cosine 0
    got = hilbert.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect()
    assert ranks(got, 0) == [1, 2, 3, 4, 5] and ranks(got, 20) == [0, 1, 2, 3, 4]


def test_doubles_are_scored_as_doubles(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12))
    x[7] = x[0] + 1e-9 * rng.normal(size=12)
    x[8] = x[0] * 1e200
    x[9] = x[0] * 1e-200
    got = hilbert.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    size = np.abs(x).max(axis=1, keepdims=True)
    unit = (x / size) / np.linalg.norm(x / size, axis=1, keepdims=True)
    assert set(ranks(got, 0)[:3]) == {7, 8, 9} and all(abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-14 for r in got)


@pytest.mark.parametrize("cell", [4096, 20])
def test_crowded_directions(spark, cell):
    """A third of the vectors lie almost in one direction, so that they share a key in every ordering."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 10))
    x[::3] = x[0] + 1e-7 * rng.normal(size=(300, 10))
    rows = [(i, v.tolist(), "a", 1, 2, b"c", 3.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>, key string, id int, q int, vec binary, score double")
    got = hilbert.nearest(df, cell=cell).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    by = defaultdict(set)
    for r in got:
        by[r.query_id].add(r.vec_id)
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12
    found = 0
    for q in range(0, 900, 50):
        scores = unit @ unit[q]
        scores[q] = -9
        assert len(by[q]) == 5
        least = sorted(np.round(scores, 12))[-5]
        found += sum(round(scores[v], 12) >= least for v in by[q])
    assert set(by) == set(range(0, 900, 50)) and found / (5 * 18) >= 0.9


def test_windows_are_narrow_where_vectors_have_structure():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(200, 32))
    x = hilbert.unit(centres[rng.integers(0, 200, 8000)] + 0.02 * rng.normal(size=(8000, 32)))
    curves = hilbert.Curves.fit(x, 16)
    near = [(x[i], x[np.argsort(-(x @ x[i]))[1]]) for i in range(0, 8000, 100)]
    assert hilbert.window(curves, near, 0.95) < 0.01
    loose = hilbert.unit(rng.normal(size=(4000, 32)))
    curves = hilbert.Curves.fit(loose, 16)
    far = [(loose[i], loose[np.argsort(-(loose @ loose[i]))[1]]) for i in range(0, 4000, 50)]
    assert 0.01 < hilbert.window(curves, far, 0.95) < 0.25


def test_codes_bound_what_they_lose():
    rng = np.random.default_rng(8)
    a, b = (hilbert.unit(rng.normal(size=(500, 64))) for _ in range(2))
    (x, x_lost, least), (y, y_lost, _) = (hilbert._decode(hilbert._encode(v, np.arange(500.0))) for v in (a, b))
    assert least.tolist() == list(range(500))
    bound = x_lost[:, None] + y_lost[None, :] * (1 + x_lost[:, None]) + 1e-5
    assert (np.abs(x @ y.T - a @ b.T) <= bound).all()
