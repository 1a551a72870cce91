"""Regressions beyond the plain ones: spatial lag and error models, negative binomial counts, errors by clusters.

Every model is fitted from sums over its rows: lags are joins with the weights, products are one aggregation, and only
matrices of the size of the terms (and moments of the weights) reach the driver.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import scratch

#: Areas up to which the log-determinant comes from all eigenvalues; beyond, from Chebyshev moments of random probes.
EXACT = 1500
#: Probes and steps of the moments; each step gives two of them.
PROBES, STEPS, SEED = 16, 24, 20240101


# --- weights -------------------------------------------------------------------------------------------------------


def weights(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, w, s) among the areas of rows (id): row-standardised weights, and the symmetric ones similar to them.

    edges: (i, j) or (i, j, w) in both directions, with the same w in both; repeated edges and loops are left out.
    """
    raw = edges.select("i", "j", (F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)).alias("a")).where("i != j and a > 0").groupBy("i", "j").agg(F.max("a").alias("a"))
    ids = rows.select("id")
    known = scratch.written(raw.join(ids.select(F.col("id").alias("i")), "i", "left_semi").join(ids.select(F.col("id").alias("j")), "j", "left_semi"))
    forth, back = known.agg(F.bit_xor(F.xxhash64("i", "j", "a")), F.bit_xor(F.xxhash64("j", "i", "a"))).first()
    if forth != back:
        raise ValueError("weights must be the same in both directions before they are standardised")
    total = known.groupBy("i").agg(F.sum("a").alias("total"))
    j = known.join(total, "i").join(total.select(F.col("i").alias("j"), F.col("total").alias("other")), "j")
    return scratch.written(j.select("i", "j", (F.col("a") / F.col("total")).alias("w"), (F.col("a") / F.sqrt(F.col("total") * F.col("other"))).alias("s")))


def lags(rows: DataFrame, w: DataFrame, columns: list[str], by: str = "w", prefix: str = "w_") -> DataFrame:
    """rows with the weighted sums of the neighbours' columns; islands have 0."""
    side = rows.select(F.col("id").alias("j"), *columns)
    found = w.join(side, "j").groupBy(F.col("i").alias("id")).agg(*(F.sum(F.col(by) * F.col(c)).alias(f"{prefix}{c}") for c in columns))
    return rows.join(found, "id", "left").na.fill(0.0, [f"{prefix}{c}" for c in columns])


class LogDeterminant:
    """log |I - r W| of the weights for any r, and the mean of the diagonal of (I - r W)^-1."""

    def __init__(self, n: int, eigenvalues: np.ndarray | None = None, moments: np.ndarray | None = None):
        self.n, self.eigenvalues, self.moments = n, eigenvalues, moments

    def _sum(self, f) -> np.ndarray:
        """The trace of f(W), of each probe if there are probes."""
        if self.eigenvalues is not None:
            return np.array([f(self.eigenvalues).sum() + f(np.zeros(1))[0] * (self.n - len(self.eigenvalues))])
        k = self.moments.shape[1]
        angles = (np.arange(4 * k) + 0.5) * math.pi / (4 * k)
        c = 2 / (4 * k) * np.cos(np.outer(np.arange(k), angles)) @ f(np.cos(angles))
        c[0] /= 2
        return self.moments @ c

    def value(self, r: float) -> float:
        return float(self._sum(lambda x: np.log1p(-r * x)).mean())

    def error(self, r: float) -> float:
        """Standard error of the value over the probes; 0 if it is exact."""
        each = self._sum(lambda x: np.log1p(-r * x))
        return float(each.std(ddof=1) / math.sqrt(len(each))) if len(each) > 1 else 0.0

    def diagonal(self, r: float) -> float:
        return float(self._sum(lambda x: 1 / (1 - r * x)).mean() / self.n)


def log_determinant(rows: DataFrame, w: DataFrame, n: int, exact: int = EXACT, probes: int = PROBES, steps: int = STEPS, seed: int = SEED) -> LogDeterminant:
    """From all eigenvalues of up to `exact` areas (so many squared numbers in the driver), else from probes.

    A probe is a vector of signs by hash; its moments of the Chebyshev polynomials of W come from `steps` products of the
    weights with all probes at once, each a join and a sum. Moments 0 to 2 are exact (n, 0 and the sum of squares).
    """
    if n <= exact:
        e = w.select("i", "j", "s").toPandas()
        names = pd.Index(pd.unique(pd.concat([e["i"], e["j"]], ignore_index=True)))
        a = np.zeros((len(names), len(names)))
        a[names.get_indexer(e["i"]), names.get_indexer(e["j"])] = e["s"]
        return LogDeterminant(n, eigenvalues=np.linalg.eigvalsh(a) if len(names) else np.zeros(0))
    columns = [f"u{p}" for p in range(probes)]
    sign = lambda p: (F.xxhash64("id", F.lit(seed), F.lit(p)).bitwiseAND(2) - 1).cast("double")
    now = rows.select("id", *(sign(p).alias(c) for p, c in enumerate(columns)), *(F.lit(0.0).alias(f"o_{c}") for c in columns))
    products = []
    for step in range(steps):
        ahead = lags(now, w, columns, by="s", prefix="n_")
        factor = 1.0 if step == 0 else 2.0
        ahead = scratch.written(ahead.select("id", *columns, *((factor * F.col(f"n_{c}") - F.col(f"o_{c}")).alias(f"n_{c}") for c in columns)))
        s = ahead.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{k}_{c}") for c in columns for k, a, b in (("same", f"n_{c}", f"n_{c}"), ("next", c, f"n_{c}")))).first()
        products.append(([s[f"next_{c}"] for c in columns], [s[f"same_{c}"] for c in columns]))
        scratch.dropped(now)
        now = ahead.select("id", *(F.col(f"n_{c}").alias(c) for c in columns), *(F.col(c).alias(f"o_{c}") for c in columns))
        now._written_at = ahead._written_at
    scratch.dropped(now)
    moments = np.zeros((probes, 2 * steps + 1))
    moments[:, 0] = n
    first = np.array(products[0][0])  # u0 . u1
    for k, (crossed, squared) in enumerate(products):  # of u_k and u_(k+1)
        moments[:, 2 * k + 1] = 2 * np.array(crossed) - first
        moments[:, 2 * k + 2] = 2 * np.array(squared) - n
    squares = w.agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0))).first()[0]
    moments[:, 1], moments[:, 2] = 0.0, 2 * squares - n
    return LogDeterminant(n, moments=moments)


# --- spatial models ------------------------------------------------------------------------------------------------


def _products(rows: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """Number of rows, and sums of products of all pairs of columns, of one pass."""
    k = len(columns)
    s = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(columns[a]) * F.col(columns[b])).alias(f"{a}_{b}") for a in range(k) for b in range(a, k))).first()
    return s["n"], np.array([[s[f"{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(k)] for a in range(k)])


def _complete(df: DataFrame, y: str, xs: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """(id, y, one, centred x0, x1, ...) of the rows with all values, and the centres: sums of products lose less."""
    d = df.select("id", F.col(y).cast("double").alias("y"), *(F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(xs)))
    d = scratch.written(d.dropna())
    means = d.agg(*(F.avg(f"x{k}").alias(f"x{k}") for k in range(len(xs)))).first().asDict() if xs else {}
    means = {k: v or 0.0 for k, v in means.items()}
    return d.select("id", "y", F.lit(1.0).alias("one"), *((F.col(k) - v).alias(k) for k, v in means.items())), means


def _best(f, low: float = -0.99, high: float = 0.999) -> float:
    """Where f is largest: a grid, then golden sections around its best point."""
    grid = np.linspace(low, high, 81)
    k = int(np.argmax([f(g) for g in grid]))
    a, b, g = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)], (math.sqrt(5) - 1) / 2
    while b - a > 1e-10:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if f(c) >= f(d) else (c, b)
    return (a + b) / 2


def _uncentred(beta: np.ndarray, cov: np.ndarray, means: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Terms (one, x...) of centred columns as those of the given ones."""
    back = np.eye(len(beta))
    back[0, 1:] = -np.array(means)
    return back @ beta, back @ cov @ back.T


def _table(names: list[str], beta: np.ndarray, cov: np.ndarray, **more) -> pd.DataFrame:
    se = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(se > 0, beta / se, np.nan)
    return pd.DataFrame({"term": names, "coef": beta, "se": se, "z": z, **more})


def spatial_lag(df: DataFrame, y: str, xs: list[str], edges: DataFrame, exact: int = EXACT, probes: int = PROBES, steps: int = STEPS) -> pd.DataFrame:
    """y = rho W y + X b + e by maximum likelihood: term, coef, se, z, direct, total, n, log_likelihood, log_det_se.

    df has an id for each area; rows that lack a value take no part, nor do their edges, and islands have lag 0. direct
    and total are the mean effects of a term on its own area and on all areas. log_det_se is the error that probes leave
    in the log-determinant at the estimate (0 where it is exact).
    """
    d, means = _complete(df, y, xs)
    w = weights(d, edges)
    lagged = lags(d, w, ["y"])
    columns = ["y", "w_y", "one", *means]
    n, m = _products(lagged, columns)
    det = log_determinant(d, w, n, exact, probes, steps)
    inverse = np.linalg.inv(m[2:, 2:])
    b0, b1 = inverse @ m[2:, 0], inverse @ m[2:, 1]
    e00, e01, e11 = m[0, 0] - m[0, 2:] @ b0, m[0, 1] - m[0, 2:] @ b1, m[1, 1] - m[1, 2:] @ b1
    squares = lambda r: e00 - 2 * r * e01 + r * r * e11
    likelihood = lambda r: det.value(r) - n / 2 * (math.log(2 * math.pi * squares(r) / n) + 1)
    rho = _best(likelihood)
    beta, sigma2 = b0 - rho * b1, squares(rho) / n
    h = 1e-4
    bend = (det.value(rho + h) - 2 * det.value(rho) + det.value(rho - h)) / h**2
    k = 2 + len(beta)
    information = np.zeros((k, k))  # of rho, the terms and sigma squared
    information[:-1, :-1] = m[1:, 1:] / sigma2
    information[0, 0] -= bend
    information[:-1, -1] = information[-1, :-1] = (m[1:, 0] - rho * m[1:, 1] - m[1:, 2:] @ beta) / sigma2**2
    information[-1, -1] = n / (2 * sigma2**2)
    linked = m[1, 1] > 0  # without a link rho is 0 and has no error
    rho, first = (rho, 0) if linked else (0.0, 1)
    cov = np.full((k, k), np.nan)
    cov[first:, first:] = np.linalg.inv(information[first:, first:])
    beta, own = _uncentred(b0 - rho * b1, cov[1:-1, 1:-1], list(means.values()))
    full = np.zeros((1 + len(beta), 1 + len(beta)))
    full[0, 0], full[1:, 1:] = cov[0, 0], own
    names = ["rho", "_cons", *xs]
    effects = lambda f: [math.nan, math.nan, *(f * b for b in beta[1:])]
    scratch.dropped(w)
    return _table(names, np.array([rho, *beta]), full, direct=effects(det.diagonal(rho)), total=effects(1 / (1 - rho)), n=n, log_likelihood=likelihood(rho), log_det_se=det.error(rho))


def spatial_error(df: DataFrame, y: str, xs: list[str], edges: DataFrame, exact: int = EXACT, probes: int = PROBES, steps: int = STEPS) -> pd.DataFrame:
    """y = X b + u, u = lambda W u + e by maximum likelihood: term, coef, se, z, n, log_likelihood, log_det_se."""
    d, means = _complete(df, y, xs)
    w = weights(d, edges)
    own = ["y", "one", *means]
    n, m = _products(lags(d, w, own), [*own, *(f"w_{c}" for c in own)])
    det = log_determinant(d, w, n, exact, probes, steps)
    k = len(own)

    def fit(r: float):
        keep = np.hstack([np.eye(k), -r * np.eye(k)])
        p = keep @ m @ keep.T  # products of what the filter I - r W leaves
        beta = np.linalg.solve(p[1:, 1:], p[1:, 0])
        return beta, (p[0, 0] - p[0, 1:] @ beta) / n, p[1:, 1:]

    likelihood = lambda r: det.value(r) - n / 2 * (math.log(2 * math.pi * fit(r)[1]) + 1)
    r = _best(likelihood)
    beta, sigma2, xx = fit(r)
    h = 1e-4
    bend = (likelihood(r + h) - 2 * likelihood(r) + likelihood(r - h)) / h**2
    beta, cov = _uncentred(beta, sigma2 * np.linalg.inv(xx), list(means.values()))
    full = np.zeros((1 + len(beta), 1 + len(beta)))
    full[0, 0], full[1:, 1:] = -1 / bend if bend else math.nan, cov
    scratch.dropped(w)
    return _table(["lambda", "_cons", *xs], np.array([r, *beta]), full, n=n, log_likelihood=likelihood(r), log_det_se=det.error(r))


def spatial_lag_iv(df: DataFrame, y: str, xs: list[str], edges: DataFrame, robust: bool = False) -> pd.DataFrame:
    """The lag model by two stages with the instruments X, W X and W W X: no log-determinant; term, coef, se, z, n."""
    d, means = _complete(df, y, xs)
    w = weights(d, edges)
    x = list(means)
    once = scratch.written(lags(d, w, ["y", *x]))
    rows = lags(once, w, [f"w_{c}" for c in x])
    columns = ["y", "w_y", "one", *x, *(f"w_{c}" for c in x), *(f"w_w_{c}" for c in x)]
    n, m = _products(rows, columns)
    k = 2 + len(x)
    instruments = np.linalg.pinv(m[2:, 2:])
    to = instruments @ m[2:, 1 : 1 + k]  # the first stage: terms on instruments
    inner = np.linalg.inv(to.T @ m[2:, 2:] @ to)
    beta = inner @ to.T @ m[2:, 0]
    keep = np.zeros(len(columns))
    keep[0], keep[1 : 1 + k] = 1, -beta
    if robust:
        e = reduce(lambda a, b: a + b, (float(v) * F.col(c) for v, c in zip(keep, columns) if v))
        squared = rows.withColumn("_e", e * e)
        s = squared.agg(*(F.sum(F.col("_e") * F.col(columns[2 + a]) * F.col(columns[2 + b])).alias(f"{a}_{b}") for a in range(len(columns) - 2) for b in range(a, len(columns) - 2))).first()
        meat = np.array([[s[f"{min(a, b)}_{max(a, b)}"] for b in range(len(columns) - 2)] for a in range(len(columns) - 2)])
        cov = inner @ to.T @ meat @ to @ inner
    else:
        cov = inner * (keep @ m @ keep) / n
    own, own_cov = _uncentred(beta[1:], cov[1:, 1:], list(means.values()))
    full = np.zeros((k, k))
    full[0, 0], full[1:, 1:] = cov[0, 0], own_cov
    scratch.dropped(once)
    scratch.dropped(w)
    return _table(["rho", "_cons", *xs], np.array([beta[0], *own]), full, n=n)


def inverse_distance(points: DataFrame, km: float) -> DataFrame:
    """(i, j, w) of points (id, lat, lon) up to a distance apart: one over it, of places less than a metre apart 1000."""
    from geoloom.operators.joins import within

    other = points.select(F.col("id").alias("j"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    pairs = within(points.select(F.col("id").alias("i"), "lat", "lon"), other, km).where("i != j")
    return pairs.select("i", "j", (1 / F.greatest(F.col("km"), F.lit(0.001))).alias("w"))


# --- counts, shares and clusters -----------------------------------------------------------------------------------


def _log_gamma(x):
    """Stirling's series eight up, within 1e-13."""
    up = x + 8
    inv = 1 / (up * up)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / up
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + series - reduce(lambda a, b: a + b, (F.ln(x + k) for k in range(8)))


def _digamma(x):
    up = x + 8
    inv = 1 / (up * up)
    series = F.ln(up) - 0.5 / up - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240)))
    return series - reduce(lambda a, b: a + b, (1 / (x + k) for k in range(8)))


def _trigamma(x):
    up = x + 8
    inv = 1 / (up * up)
    series = 1 / up + 0.5 * inv + inv / up * (1 / 6 - inv * (1 / 30 - inv * (1 / 42 - inv / 30)))
    return series + reduce(lambda a, b: a + b, (1 / ((x + k) * (x + k)) for k in range(8)))


def _family(family: str, y, eta, r: float):
    """(mean, factor of the score, weight of the observed information, log-likelihood) of a row."""
    if family == "gaussian":
        return eta, y - eta, F.lit(1.0), -(y - eta) * (y - eta) / 2
    if family == "binomial":
        mu = 1 / (1 + F.exp(-eta))
        return mu, y - mu, mu * (1 - mu), y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))
    mu = F.exp(eta)
    if family == "poisson":
        return mu, y - mu, mu, y * eta - mu - _log_gamma(y + 1)
    if family == "negative binomial":
        size = F.lit(r)
        return mu, (y - mu) * size / (size + mu), mu * size * (size + y) / ((size + mu) * (size + mu)), _log_gamma(y + size) - _log_gamma(size) - _log_gamma(y + 1) + size * F.ln(size) + y * eta - (y + size) * F.ln(size + mu)
    raise ValueError(f"no family named {family}")


def fitted(df: DataFrame, y: str, xs: list[str], family: str, cluster: str | None = None, robust: bool = False, exposure: str | None = None, most: int = 60) -> pd.DataFrame:
    """A gaussian, binomial, poisson or negative binomial model: term, coef, se, z, n, clusters, log_likelihood.

    Each step is one aggregation over the rows with all values (a cluster too, and an exposure above 0, whose logarithm
    is added). Errors come from the observed information; robust ones from each row's score, clustered ones from the sums
    of scores of each cluster, with the usual small factors. The negative binomial has the term ln_alpha, the logarithm
    of its dispersion, fitted with the others; where counts vary no more than Poisson's it falls to its least value.
    """
    more = [F.col(cluster).alias("g")] if cluster else [F.lit(None).cast("string").alias("g")]
    offset = F.ln(F.when(F.col(exposure) > 0, F.col(exposure).cast("double"))) if exposure else F.lit(0.0)
    d = df.select(F.col(y).cast("double").alias("y"), offset.alias("o"), *more, *(F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(xs)))
    d = scratch.written(d.dropna(subset=[c for c in d.columns if c != "g" or cluster]))
    terms = ["one", *(f"x{k}" for k in range(len(xs)))]
    first = d.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.avg(F.exp("o")).alias("exposed"), *(F.avg(t).alias(t) for t in terms[1:]), *(F.stddev_pop(t).alias(f"s_{t}") for t in terms[1:])).first()
    n, means, scales = first["n"], [first[t] or 0.0 for t in terms[1:]], [first[f"s_{t}"] or 1.0 for t in terms[1:]]
    if not n:
        raise ValueError("no row has all values")
    rows = d.select("y", "o", "g", F.lit(1.0).alias("one"), *(((F.col(t) - m) / s).alias(t) for t, m, s in zip(terms[1:], means, scales)))
    k, size = len(terms), 1.0
    mean = min(max(first["mean"], 1e-9), 1 - 1e-9) if family == "binomial" else max(first["mean"], 1e-9)
    beta = np.zeros(k)
    beta[0] = first["mean"] if family == "gaussian" else math.log(mean / (1 - mean)) if family == "binomial" else math.log(mean / max(first["exposed"], 1e-300))
    negative = family == "negative binomial"
    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def parts(beta, size):
        eta = reduce(lambda a, b: a + b, (float(v) * F.col(t) for v, t in zip(beta, terms))) + F.col("o")
        return (F.col("y"), *_family(family, F.col("y"), eta, float(size)))

    def at(beta, size):
        """The gradient and the negative Hessian (with ln_alpha last if there is one), and the log-likelihood."""
        yy, mu, score, weight, like = parts(beta, size)
        out = [F.sum(like).alias("like"), *(F.sum(score * F.col(t)).alias(f"g{i}") for i, t in enumerate(terms)), *(F.sum(weight * F.col(terms[a]) * F.col(terms[b])).alias(f"h{a}_{b}") for a, b in pairs)]
        if negative:
            r = F.lit(float(size))
            out += [F.sum(_digamma(yy + r) - _digamma(r) + F.ln(r) + 1 - F.ln(r + mu) - (yy + r) / (r + mu)).alias("d1"), F.sum(_trigamma(yy + r) - _trigamma(r) + 1 / r - 2 / (r + mu) + (yy + r) / ((r + mu) * (r + mu))).alias("d2"), *(F.sum((yy - mu) * mu / ((r + mu) * (r + mu)) * F.col(t)).alias(f"c{i}") for i, t in enumerate(terms))]
        s = rows.agg(*out).first()
        g, h = [s[f"g{i}"] for i in range(k)], np.array([[s[f"h{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])
        if negative:
            g.append(-size * s["d1"])
            h = np.pad(h, (0, 1))
            h[k, k] = -(size * size * s["d2"] + size * s["d1"])
            h[:k, k] = h[k, :k] = [size * s[f"c{i}"] for i in range(k)]
        return np.array(g), h, s["like"]

    g, h, like = at(beta, size)
    for _ in range(most):
        move = np.zeros(len(g))
        move[:k] = np.linalg.lstsq(h[:k, :k], g[:k], rcond=None)[0]
        if negative:  # terms and dispersion in turn, and together once the whole Hessian bends downwards
            move[k] = np.clip(g[k] / h[k, k] if h[k, k] > 0 else np.sign(g[k]), -1, 1)
            if np.linalg.eigvalsh(h)[0] > 0 and np.abs(whole := np.linalg.solve(h, g)).max() < 1:
                move = whole
        step = 1.0
        while True:
            new_beta, new_size = beta + step * move[:k], min(1e8, size * math.exp(-step * move[k])) if negative else size
            new = at(new_beta, new_size)
            if np.isfinite(new[2]) and new[2] >= like - 1e-9 * abs(like) or step < 1e-4:
                break
            step /= 2
        beta, size, gain = new_beta, new_size, new[2] - like
        g, h, like = new
        if np.abs(step * move).max() < 1e-8 or gain < 1e-12 * abs(like) and np.abs(step * move).max() < 1e-5 or size >= 1e8:
            break
    bread = np.linalg.pinv(h[:k, :k]) if negative and size >= 1e8 else np.linalg.pinv(h)
    cov, groups = bread, None
    if family == "gaussian":
        sigma2 = -2 * like / n
        like = -n / 2 * (math.log(2 * math.pi * sigma2) + 1)
        cov = bread * sigma2 * n / max(1, n - k)
    if cluster or robust:
        yy, mu, score, *_ = parts(beta, size)
        own = [(score * F.col(t)).alias(f"u{i}") for i, t in enumerate(terms)]
        if len(bread) > k:
            r = F.lit(float(size))
            own.append((-r * (_digamma(yy + r) - _digamma(r) + F.ln(r) + 1 - F.ln(r + mu) - (yy + r) / (r + mu))).alias(f"u{k}"))
        u = rows.select("g", *own)
        if cluster:
            u = u.groupBy("g").agg(*(F.sum(f"u{i}").alias(f"u{i}") for i in range(len(bread))))
        groups, meat = _products(u, [f"u{i}" for i in range(len(bread))])
        small = groups / max(1, groups - 1) if cluster else 1.0
        if family == "gaussian":
            small *= (n - 1) / (n - k) if cluster else n / (n - k)
        elif not cluster:
            small = n / max(1, n - 1)
        cov = bread @ meat @ bread * small
    back = np.eye(len(cov))  # of centred and scaled terms to the given ones
    for i, (m, s) in enumerate(zip(means, scales)):
        back[1 + i, 1 + i] = 1 / s
        back[0, 1 + i] = -m / s
    values = back @ np.array([*beta, -math.log(size)][: len(cov)])
    cov = back @ cov @ back.T
    names = ["_cons", *xs, "ln_alpha"][: len(cov)]
    if negative and len(cov) == k:
        names, values, cov = [*names, "ln_alpha"], np.append(values, -math.log(size)), np.pad(cov, (0, 1))
    scratch.dropped(d)
    return _table(names, values, cov, n=n, clusters=groups if cluster else None, log_likelihood=like)
