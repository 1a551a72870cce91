"""Spatial, count and clustered regressions against dense fits and simulated truth."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.operators import regressions


def grid(side):
    """Edges of a square grid by shared sides, in both directions."""
    at = lambda r, c: r * side + c
    out = [(at(r, c), at(r + a, c + b)) for r in range(side) for c in range(side) for a, b in ((0, 1), (1, 0)) if r + a < side and c + b < side]
    return out + [(j, i) for i, j in out]


def dense(n, edges):
    w = np.zeros((n, n))
    for i, j in edges:
        w[i, j] = 1
    s = w.sum(axis=1, keepdims=True)
    return np.divide(w, s, out=np.zeros_like(w), where=s > 0)


def made(side, rho=0.0, lam=0.0, seed=1):
    r = np.random.default_rng(seed)
    n, edges = side * side, grid(side)
    w, x = dense(n, edges), r.normal(50, 3, (n, 2))
    u = np.linalg.solve(np.eye(n) - lam * w, r.normal(size=n))
    y = np.linalg.solve(np.eye(n) - rho * w, 2 + x @ [1.5, -0.7] + u)
    return w, x, y, edges


def frames(spark, x, y, edges):
    rows = [(k, float(v), *map(float, a)) for k, (v, a) in enumerate(zip(y, x))]
    return spark.createDataFrame([*rows, (10**6, None, 1.0, 2.0), (10**6 + 1, 5.0, None, 1.0)], "id long, y double, a double, b double"), spark.createDataFrame([*edges, (10**6, 0), (0, 10**6), edges[0]], "i long, j long")


def likelihood_lag(w, x, y, r):
    n = len(y)
    z = np.column_stack([np.ones(n), x])
    a = np.eye(n) - r * w
    beta, *_ = np.linalg.lstsq(z, a @ y, rcond=None)
    e = a @ y - z @ beta
    return np.linalg.slogdet(a)[1] - n / 2 * (math.log(2 * math.pi * (e @ e) / n) + 1), beta


def likelihood_error(w, x, y, r):
    n = len(y)
    a = np.eye(n) - r * w
    z = a @ np.column_stack([np.ones(n), x])
    beta, *_ = np.linalg.lstsq(z, a @ y, rcond=None)
    e = a @ y - z @ beta
    return np.linalg.slogdet(a)[1] - n / 2 * (math.log(2 * math.pi * (e @ e) / n) + 1), beta


def top(f):
    low, high = -0.99, 0.999
    for _ in range(8):
        g = np.linspace(low, high, 21)
        k = int(np.argmax([f(v)[0] for v in g]))
        low, high = g[max(0, k - 1)], g[min(20, k + 1)]
    return (low + high) / 2


@pytest.mark.parametrize("kind", ["lag", "error"])
def test_spatial_models_are_the_dense_fits(spark, kind):
    w, x, y, edges = made(14, **({"rho": 0.55} if kind == "lag" else {"lam": 0.6}))
    f = likelihood_lag if kind == "lag" else likelihood_error
    r = top(lambda v: f(w, x, y, v))
    value, beta = f(w, x, y, r)
    df, links = frames(spark, x, y, edges)
    got = (regressions.spatial_lag if kind == "lag" else regressions.spatial_error)(df, "y", ["a", "b"], links)
    assert list(got["term"]) == ["rho" if kind == "lag" else "lambda", "_cons", "a", "b"]
    assert np.allclose(got["coef"], [r, *beta], rtol=1e-4, atol=1e-5)
    assert abs(got["log_likelihood"][0] - value) < 1e-6 and got["log_det_se"][0] == 0 and got["n"][0] == 196
    h = 1e-4
    # the curvature of the whole likelihood by differences, as errors
    n = len(y)
    z = np.column_stack([np.ones(n), x])

    def whole(t):
        a = np.eye(n) - t[0] * w
        e = a @ y - z @ t[1:4] if kind == "lag" else a @ (y - z @ t[1:4])
        return np.linalg.slogdet(a)[1] - n / 2 * math.log(2 * math.pi * t[4]) - e @ e / 2 / t[4]

    a = np.eye(n) - r * w
    e = a @ y - z @ beta if kind == "lag" else a @ (y - z @ beta)
    t = np.array([r, *beta, e @ e / n])
    step = np.array([h, h, h, h, h])
    hess = np.array([[(whole(t + step * (i + j)) - whole(t + step * (i - j)) - whole(t - step * (i - j)) + whole(t - step * (i + j))) / (4 * h * h) for j in np.eye(5)] for i in np.eye(5)])
    se = np.sqrt(np.diag(np.linalg.inv(-hess)))[:4]
    assert np.allclose(got["se"], se, rtol=0.02)
    if kind == "lag":
        inverse = np.linalg.inv(np.eye(n) - r * w)
        assert abs(got["direct"][2] - beta[1] * np.trace(inverse) / n) < 1e-3
        assert abs(got["total"][2] - beta[1] / (1 - r)) < 1e-3


@pytest.mark.parametrize("kind", ["lag", "error"])
def test_spatial_models_from_probes(spark, kind):
    """With moments instead of eigenvalues the truth lies within the errors, and the log-determinant within its own."""
    w, x, y, edges = made(28, **({"rho": 0.5} if kind == "lag" else {"lam": 0.5}), seed=4)
    df, links = frames(spark, x, y, edges)
    fit = regressions.spatial_lag if kind == "lag" else regressions.spatial_error
    got, exact = fit(df, "y", ["a", "b"], links, exact=0, steps=12), fit(df, "y", ["a", "b"], links, exact=10**4)
    assert (abs(got["coef"] - [0.5, 2, 1.5, -0.7]) < 3.5 * got["se"]).all()
    assert (abs(got["coef"] - exact["coef"]) < 0.6 * exact["se"]).all() and np.allclose(got["se"], exact["se"], rtol=0.1)
    assert got["log_det_se"][0] > 0


def test_log_determinant_of_probes(spark):
    w, x, y, edges = made(24)
    rows = spark.range(576)
    links = regressions.weights(rows, spark.createDataFrame(edges, "i long, j long"))
    det = regressions.log_determinant(rows, links, 576, exact=0, steps=16)
    for r in (-0.6, 0.2, 0.8):
        assert abs(det.value(r) - np.linalg.slogdet(np.eye(576) - r * w)[1]) < 5 * det.error(r) + 1e-3
        assert abs(det.diagonal(r) - np.trace(np.linalg.inv(np.eye(576) - r * w)) / 576) < 0.05


def test_spatial_lag_by_instruments(spark):
    w, x, y, edges = made(15, rho=0.4, seed=7)
    n = len(y)
    z, h = np.column_stack([w @ y, np.ones(n), x]), np.column_stack([np.ones(n), x, w @ x, w @ w @ x])
    zh = h @ np.linalg.lstsq(h, z, rcond=None)[0]
    beta = np.linalg.solve(zh.T @ z, zh.T @ y)
    e = y - z @ beta
    inner = np.linalg.inv(zh.T @ zh)
    df, links = frames(spark, x, y, edges)
    got = regressions.spatial_lag_iv(df, "y", ["a", "b"], links)
    assert np.allclose(got["coef"], beta, rtol=1e-5, atol=1e-5)
    assert np.allclose(got["se"], np.sqrt(np.diag(inner) * (e @ e) / n), rtol=1e-4)
    robust = regressions.spatial_lag_iv(df, "y", ["a", "b"], links, robust=True)
    cov = inner @ (zh * (e**2)[:, None]).T @ zh @ inner
    assert np.allclose(robust["se"], np.sqrt(np.diag(cov)), rtol=1e-4)


def test_spatial_weights_must_be_symmetric(spark):
    rows, edges = spark.range(3), spark.createDataFrame([(0, 1)], "i long, j long")
    with pytest.raises(ValueError):
        regressions.weights(rows, edges)
    islands = regressions.spatial_lag(spark.createDataFrame([(k, float(k * k % 7), float(k % 5)) for k in range(30)], "id long, y double, x double"), "y", ["x"], edges.limit(0))
    assert islands["n"][0] == 30 and np.isfinite(islands["coef"][1:]).all()


def count_rows(family, seed=3, n=300):
    r = np.random.default_rng(seed)
    a, b = r.normal(3, 1, n), r.integers(0, 2, n).astype(float)
    group = r.integers(0, 25, n)
    eta = 0.4 + 0.3 * a - 0.5 * b + 0.2 * r.normal(size=25)[group]
    if family == "binomial":
        y = (r.random(n) < 1 / (1 + np.exp(-(eta - 1)))).astype(float)
    elif family == "gaussian":
        y = eta + r.normal(size=n)
    elif family == "poisson":
        y = r.poisson(np.exp(eta)).astype(float)
    else:
        y = r.poisson(np.exp(eta) * r.gamma(1.7, 1 / 1.7, n)).astype(float)
    return pd.DataFrame({"y": y, "a": a, "b": b, "g": group, "e": r.uniform(1, 5, n)})


def log_likelihood(family, d, t, offset):
    """Each row's, with math's own gamma function; t: constant, a, b and (negative binomial) ln_alpha."""
    eta = t[0] + t[1] * d["a"].to_numpy() + t[2] * d["b"].to_numpy() + offset
    y = d["y"].to_numpy()
    lg = np.vectorize(math.lgamma)
    if family == "binomial":
        return y * eta - np.log1p(np.exp(eta))
    if family == "poisson":
        return y * eta - np.exp(eta) - lg(y + 1)
    r = math.exp(-t[3])
    return lg(y + r) - math.lgamma(r) - lg(y + 1) + r * math.log(r) + y * eta - (y + r) * np.log(r + np.exp(eta))


@pytest.mark.parametrize("family", ["binomial", "poisson", "negative binomial"])
def test_models_are_the_dense_maximum(spark, family):
    d = count_rows(family)
    df = spark.createDataFrame(d).unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1, 1.0)], "y double, a double, b double, g long, e double"))
    for exposed in (None, "e") if family != "binomial" else (None,):
        offset = np.log(d["e"].to_numpy()) if exposed else 0.0
        got = regressions.fitted(df, "y", ["a", "b"], family, exposure=exposed)
        t, k = got["coef"].to_numpy(), len(got)
        each = lambda v: log_likelihood(family, d, v, offset)
        h = 1e-4
        unit = np.eye(k) * h
        scores = np.array([(each(t + u) - each(t - u)) / (2 * h) for u in unit]).T
        assert np.abs(scores.sum(axis=0)).max() < 1e-3 and abs(each(t).sum() - got["log_likelihood"][0]) < 1e-6
        hess = np.array([[(each(t + u + v) - each(t + u - v) - each(t - u + v) + each(t - u - v)).sum() / (4 * h * h) for u in unit] for v in unit])
        bread = np.linalg.inv(-hess)
        assert np.allclose(got["se"], np.sqrt(np.diag(bread)), rtol=1e-3)
        robust = regressions.fitted(df, "y", ["a", "b"], family, robust=True, exposure=exposed)
        assert np.allclose(robust["se"], np.sqrt(np.diag(bread @ scores.T @ scores @ bread) * len(d) / (len(d) - 1)), rtol=1e-3)
        sums = pd.DataFrame(scores).groupby(d["g"].to_numpy()).sum().to_numpy()
        clustered = regressions.fitted(df, "y", ["a", "b"], family, cluster="g", exposure=exposed)
        assert np.allclose(clustered["se"], np.sqrt(np.diag(bread @ sums.T @ sums @ bread) * 25 / 24), rtol=1e-3) and clustered["clusters"][0] == 25
        assert list(got["term"])[:3] == ["_cons", "a", "b"] and got["n"][0] == 300


def test_linear_models_with_clusters(spark):
    d = count_rows("gaussian")
    x = np.column_stack([np.ones(300), d["a"], d["b"]])
    y = d["y"].to_numpy()
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    df = spark.createDataFrame(d)
    plain_fit, robust, clustered = (regressions.fitted(df, "y", ["a", "b"], "gaussian", **o) for o in ({}, {"robust": True}, {"cluster": "g"}))
    assert np.allclose(plain_fit["coef"], beta) and np.allclose(plain_fit["se"], np.sqrt(np.diag(inverse) * (e @ e) / 297))
    assert np.allclose(robust["se"], np.sqrt(np.diag(inverse @ (x * (e**2)[:, None]).T @ x @ inverse) * 300 / 297))
    sums = pd.DataFrame(x * e[:, None]).groupby(d["g"].to_numpy()).sum().to_numpy()
    assert np.allclose(clustered["se"], np.sqrt(np.diag(inverse @ sums.T @ sums @ inverse) * 25 / 24 * 299 / 297))


def test_negative_binomial_without_dispersion(spark):
    """Counts that vary less than Poisson's end at the least dispersion, with Poisson's terms."""
    d = spark.range(200).select((F.col("id") % 3).cast("double").alias("x"), F.round(F.exp(F.col("id") % 3 * 0.5)).alias("y"))
    a, b = (regressions.fitted(d, "y", ["x"], f) for f in ("negative binomial", "poisson"))
    assert np.allclose(a["coef"][:2], b["coef"], atol=1e-4) and a["coef"][2] < -10


def test_inverse_distance_weights(spark):
    points = spark.createDataFrame([(1, 40.0, -75.0), (2, 40.1, -75.0), (3, 40.0, -75.2), (4, 41.0, -75.0)], "id long, lat double, lon double")
    got = {(r.i, r.j): r.w for r in regressions.inverse_distance(points, 25.0).collect()}
    assert set(got) == {(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)} and abs(1 / got[1, 2] - 11.12) < 0.01 and abs(got[1, 3] - got[3, 1]) < 1e-12


def test_models_by_command(spark):
    from geoloom.plans import commands

    w, x, y, edges = made(8, rho=0.4, seed=9)
    rows = [(k, float(v), *map(float, a), k % 5, abs(int(v)) % 7) for k, (v, a) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double, county long, hits long")
    links = spark.createDataFrame(edges, "i long, j long")
    r = commands.run(df, "spatial lag y on a and b\nspatial error of y on a\nnegative binomial hits on a\nregress y on a and b, clustered by county\npoisson hits on a robust\nregress y on a robust\nspatial lag y on nothing", edges=links)
    assert [ok for _, ok, _ in r.steps] == [True] * 6 + [False]
    terms = [[t.term for t in table.collect()] for table in r.tables]
    assert terms == [["rho", "_cons", "a", "b"], ["lambda", "_cons", "a"], ["_cons", "a", "ln_alpha"], ["_cons", "a", "b"], ["_cons", "a"], ["_cons", "a"]]
    assert not commands.run(df, "spatial lag y on a").steps[0][1]
