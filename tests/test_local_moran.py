"""Local Moran statistics with pseudo-p, and keyed permutations."""

import numpy as np
import pytest

from geoloom.operators import stats
from tests.test_regressions import dense, grid


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 5000])
def test_shuffled_is_a_permutation(n):
    for draw in range(3):
        assert sorted(stats.shuffled(np.arange(n), n, 7, draw)) == list(range(n))
    if n == 10:  # each number lands anywhere about as often
        hits = np.array([stats.shuffled(np.arange(10), 10, 3, p) for p in range(4000)])
        counts = np.array([np.bincount(hits[:, k], minlength=10) for k in range(10)])
        assert abs(counts - 400).max() < 100


def made(spark, values, side):
    rows = spark.createDataFrame([*((k, float(v)) for k, v in enumerate(values)), (10**6, None), (10**6 + 1, float(np.mean(values)))], "id long, value double")
    return rows, spark.createDataFrame([*grid(side), (10**6, 0), (0, 10**6)], "i long, j long")


def test_local_p_is_that_of_many_draws(spark):
    """Against conditional draws of numpy, ten times as many."""
    r = np.random.default_rng(5)
    side, n = 7, 49
    values = r.normal(size=n) + np.repeat(np.arange(side), side) * 0.5
    rows, edges = made(spark, values, side)
    got = {x.id: x for x in stats.local_morans(rows, edges, permutations=999).collect()}
    assert len(got) == n + 1 and got[10**6 + 1].p is None and got[10**6 + 1].cluster is None
    every = np.append(values, values.mean())
    z, w = every - every.mean(), dense(n, grid(side))
    for k in range(n):
        lag = w[k] @ z[:n]
        d = int((w[k] > 0).sum())
        assert got[k].z == pytest.approx(z[k]) and got[k].lag == pytest.approx(lag) and got[k].i == pytest.approx(z[k] * lag / (z**2).mean())
        others = np.delete(z, k)
        drawn = np.array([r.choice(others, d, replace=False).mean() for _ in range(3000)])
        middle = others.mean()
        assert abs(got[k].p - (abs(drawn - middle) >= abs(lag - middle)).mean()) < 0.07
        assert got[k].cluster == ("H" if z[k] > 0 else "L") + ("H" if lag > 0 else "L")


def test_local_p_of_noise_and_of_planted_clusters(spark):
    r = np.random.default_rng(11)
    side = 30
    noise = r.normal(size=side * side)
    rows, edges = made(spark, noise, side)
    got = [x for x in stats.local_morans(rows, edges, permutations=499).collect() if x.p is not None]
    p = np.sort([x.p for x in got])
    assert abs(p - (np.arange(len(p)) + 0.5) / len(p)).max() < 0.07  # uniform
    assert sum(x.significant for x in got) <= 3
    planted = noise.reshape(side, side).copy()
    planted[3:9, 3:9] += 8
    planted[20:26, 18:24] -= 8
    rows, edges = made(spark, planted.ravel(), side)
    found = {x.id: x for x in stats.local_morans(rows, edges, permutations=999).collect()}
    inner = lambda a, b: [found[i * side + j] for i in range(a + 1, a + 5) for j in range(b + 1, b + 5)]
    assert all(x.significant and x.cluster == "HH" for x in inner(3, 3)) and all(x.significant and x.cluster == "LL" for x in inner(20, 18))
    away = [x for k, x in found.items() if k < side * side and not (2 <= k // side <= 9 and 2 <= k % side <= 9) and not (19 <= k // side <= 26 and 17 <= k % side <= 24)]
    assert sum(bool(x.significant) for x in away) <= 0.05 * len(away)


def test_permutations_by_vector_and_by_joins_are_the_same(spark):
    rows, edges = made(spark, np.random.default_rng(2).normal(size=36), 6)
    a, b = (stats.permuted_i(rows, edges, 99, most_vector=m).first() for m in (10**6, 0))
    assert a["p"] == b["p"] and a["z"] == pytest.approx(b["z"])
    assert stats.local_morans(rows.limit(0), edges).count() == 0
