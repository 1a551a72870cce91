"""Spatial autocorrelation and regressions on DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import scratch

#: Permutations of the pseudo-p value, and the seed of their order.
PERMUTATIONS, SEED = 999, 20240101


def _standardised(values: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """z of the areas with a value, and row-standardised weights among those."""
    v = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    mean = v.agg(F.avg("value").alias("m"))
    z = v.crossJoin(F.broadcast(mean)).select("id", (F.col("value") - F.col("m")).alias("z"))
    known = edges.join(z.select(F.col("id").alias("i")), "i", "left_semi").join(z.select(F.col("id").alias("j")), "j", "left_semi")
    degree = known.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return z, known.join(degree, "i").select("i", "j", (1 / F.col("n")).alias("w"))


def lagged(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, z, lag) of each area with a value: its deviation and the mean deviation of its neighbours (null: island)."""
    z, w = _standardised(values, edges)
    lag = w.join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    return z.join(lag, "id", "left")


def morans_i(values: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n, islands, i, expected. values: (id, value), edges: (i, j) in both directions."""
    x = lagged(values, edges)
    linked = F.col("lag").isNotNull()
    return x.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~linked).alias("islands"),
        ((F.count(F.lit(1)) / F.count_if(linked)) * F.sum(F.col("z") * F.col("lag")) / F.sum(F.col("z") * F.col("z"))).alias("i"),
        (-1 / (F.count(F.lit(1)) - 1)).alias("expected"),
    )


#: Areas whose values are sent to every task for the permutation test, as 8 bytes each; more are fetched by joins.
MOST_VECTOR = 5_000_000


def shuffled(k: np.ndarray, n: int, seed: int, draw: int) -> np.ndarray:
    """Where a random permutation of 0..n-1, drawn by seed and number, sends each of k.

    Six rounds of a keyed mixing of the two halves of a number are a permutation of the powers of four; numbers that
    fall beyond n go round again until they do not. So any task can apply it to any numbers, without an order.
    """
    half = np.uint64(max(1, ((max(2, n) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng([seed, draw]).integers(0, 2**63, 6, dtype=np.uint64)
    out, todo = np.array(k, np.uint64), np.arange(len(k))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in keys:
            x = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def permuted_i(values: DataFrame, edges: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED, most_vector: int | None = None) -> DataFrame:
    """One row: i, expected, z and pseudo-p over seeded random permutations of the values.

    Areas are numbered, edges carry the two numbers, and each task sends those through each permutation. The vector of
    values goes to every task if it was counted to fit; else the values come by joins. Both give the same sums, and only
    sums by permutation are shuffled on. The driver holds the vector while it is sent (40 MB for five million areas).
    """
    z, w = _standardised(values, edges)
    z = scratch.written(z)
    n = z.count()
    numbered = scratch.written(scratch.prefix_sums(z.withColumn("one", F.lit(1).cast("long")), "id", "one").select("id", "z", (F.col("upto") - 1).alias("k")))
    side = lambda c, k: numbered.select(F.col("id").alias(c), F.col("k").alias(k))
    pairs = w.join(side("i", "ki"), "i").join(side("j", "kj"), "j").select("ki", "kj", "w")
    sums = (_sums_by_vector if n <= (MOST_VECTOR if most_vector is None else most_vector) else _sums_by_joins)(pairs, numbered, n, permutations, seed)
    linked = w.select("i").distinct().count()
    squares = z.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    scale = n / linked / squares if linked and squares else float("nan")
    own = morans_i(values, edges)
    j = sums.select((F.col("s") * scale).alias("ip")).crossJoin(F.broadcast(own))
    return j.groupBy("i", "expected").agg(
        ((F.first("i") - F.avg("ip")) / F.stddev_samp("ip")).alias("z"),
        ((F.count_if(F.abs(F.col("ip") - F.col("expected")) >= F.abs(F.col("i") - F.col("expected"))) + 1) / (F.count(F.lit(1)) + 1)).alias("p"),
    )


def _sums_by_vector(pairs: DataFrame, numbered: DataFrame, n: int, permutations: int, seed: int) -> DataFrame:
    """(p, s): the weighted sum of products over all edges under each permutation."""
    vector = pairs.sparkSession.sparkContext.broadcast(numbered.orderBy("k").select("z").toPandas()["z"].to_numpy(float))

    def summed(batches):
        out = np.zeros(permutations)
        for b in batches:
            ki, kj, weight = b["ki"].to_numpy(), b["kj"].to_numpy(), b["w"].to_numpy()
            for p in range(permutations):
                out[p] += (weight * vector.value[shuffled(ki, n, seed, p)] * vector.value[shuffled(kj, n, seed, p)]).sum()
        yield pd.DataFrame({"p": np.arange(permutations), "s": out})

    return pairs.mapInPandas(summed, "p int, s double").groupBy("p").agg(F.sum("s").alias("s"))


def _sums_by_joins(pairs: DataFrame, numbered: DataFrame, n: int, permutations: int, seed: int) -> DataFrame:
    """The same with the values of each permutation joined to the edges; they are never in one place."""

    def drawn(batches):
        for b in batches:
            for p in range(permutations):
                yield pd.DataFrame({"p": p, "k": b["k"].to_numpy(), "r": shuffled(b["k"].to_numpy(), n, seed, p)})

    placed = numbered.select("k").mapInPandas(drawn, "p int, k long, r long")
    value = scratch.written(placed.join(numbered.select(F.col("k").alias("r"), "z"), "r").select("p", "k", "z"))
    a, b = (value.select("p", F.col("k").alias(x), F.col("z").alias(f"z{x}")) for x in ("ki", "kj"))
    return pairs.join(a, "ki").join(b, ["p", "kj"]).groupBy("p").agg(F.sum(F.col("w") * F.col("zki") * F.col("zkj")).alias("s"))


#: Values that local permutations may send to every task: permutations times one more than the most neighbours.
MOST_DRAWS = 5_000_000


def local_morans(values: DataFrame, edges: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """(id, z, lag, i, cluster, p, significant) of each area with a value; islands have only z.

    i is the local Moran statistic. p is two-sided, from permutations that hold an area's own value and draw its
    neighbours from all others without repeats: the same seeded draws serve all areas, and where a draw holds the area
    itself its next value takes that place. significant: false discoveries are held to a share alpha over all areas.
    """
    x = scratch.written(lagged(values, edges).join(_degrees(values, edges), "id", "left").na.fill(0, ["degree"]))
    facts = x.agg(F.count(F.lit(1)).alias("n"), F.max("degree").alias("most"), F.avg(F.col("z") * F.col("z")).alias("m2")).first()
    n, most = facts["n"], min(facts["most"] or 0, max(0, facts["n"] - 1))
    if permutations * (most + 1) > MOST_DRAWS:
        raise ValueError(f"{most} neighbours and {permutations} permutations need more than {MOST_DRAWS} values in every task: take fewer permutations")
    numbered = scratch.written(scratch.prefix_sums(x.withColumn("one", F.lit(1).cast("long")), "id", "one").select("id", "z", "lag", "degree", (F.col("upto") - 1).alias("k")))
    draws = np.empty((permutations, most + 1), np.int64)
    for p in range(permutations if n else 0):  # distinct numbers: the first ones of a random permutation
        draws[p] = shuffled(np.arange(most + 1), n, seed, p)
    asked = pd.DataFrame({"k": np.unique(draws) if n else np.zeros(0, np.int64)})
    got = numbered.join(F.broadcast(x.sparkSession.createDataFrame(asked, "k long")), "k").select("k", "z").toPandas() if n else pd.DataFrame({"k": [], "z": []})
    at = got.sort_values("k")
    value = at["z"].to_numpy(float)[np.searchsorted(at["k"].to_numpy(), draws)] if n else np.zeros((0, 1))
    sent = x.sparkSession.sparkContext.broadcast((draws, value))

    def tested(batches):
        numbers, drawn = sent.value
        upto = np.cumsum(drawn, axis=1)
        for b in batches:
            p = np.full(len(b), np.nan)
            for i, (k, z, lag, degree) in enumerate(zip(b["k"], b["z"], b["lag"], b["degree"])):
                if degree > 0:
                    d = int(degree)
                    hit = numbers[:, :d] == k
                    total = upto[:, d - 1] + np.where(hit.any(axis=1), drawn[:, min(d, most)] - z, 0.0)
                    middle = -z / (n - 1)  # the mean of the others
                    # what rounding alone tells apart is equal
                    p[i] = (1 + (np.abs(total / d - middle) >= abs(lag - middle) * (1 - 1e-12)).sum()) / (len(numbers) + 1)
            yield b.assign(p=p)[["id", "z", "lag", "p"]]

    kind = dict(numbered.dtypes)["id"]
    out = scratch.written(numbered.mapInPandas(tested, f"id {kind}, z double, lag double, p double").withColumn("p", F.nanvl("p", F.lit(None).cast("double"))))
    counts = sorted((r["p"], r["n"]) for r in out.where("p is not null").groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())  # as many rows as permutations at most
    areas, rank, cut = sum(c for _, c in counts), 0, -1.0
    for p, c in counts:
        rank += c
        cut = p if p <= alpha * rank / areas else cut
    kinds = F.when(F.col("lag").isNotNull(), _kind())
    scale = facts["m2"] or float("nan")
    return out.select("id", "z", "lag", (F.col("z") * F.col("lag") / F.lit(float(scale))).alias("i"), kinds.alias("cluster"), "p", (F.col("p") <= cut).alias("significant"))


def _degrees(values: DataFrame, edges: DataFrame) -> DataFrame:
    return _standardised(values, edges)[1].groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def _kind():
    high, around = F.col("z") > 0, F.col("lag") > 0
    return F.when(high & around, "HH").when(~high & ~around, "LL").when(high, "HL").otherwise("LH")


def clusters(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): HH, LL, HL or LH by the signs of an area's and its neighbours' deviation; null for islands."""
    return lagged(values, edges).select("id", F.when(F.col("lag").isNotNull(), _kind()).alias("cluster"))


def least_squares(df: DataFrame, y: str, xs: list[str], robust: bool = False) -> pd.DataFrame:
    """Coefficients, standard errors and t of a linear model, from sums of products over complete rows.

    robust: heteroskedasticity-consistent (HC1) errors, by a second pass over the rows.
    """
    names = ["_cons", *xs]
    d = df.select(F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_cons"), *(F.col(x).cast("double").alias(x) for x in xs)).dropna()
    k = len(names)
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for i, a in enumerate(names) for b in names[i:]]
    s = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), *products, *(F.sum(F.col(a) * F.col("_y")).alias(f"{a}|_y") for a in names)).first()
    xx = np.array([[s[f"{names[min(i, j)]}|{names[max(i, j)]}"] for j in range(k)] for i in range(k)])
    xy = np.array([s[f"{a}|_y"] for a in names])
    inverse = _inverse(xx)
    beta = inverse @ xy
    if robust:
        e = F.col("_y") - sum(float(b) * F.col(a) for a, b in zip(names, beta))
        m = d.withColumn("_e", e * e).agg(*(F.sum(F.col("_e") * F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names))).first()
        meat = np.array([[m[f"{i}_{j}"] for j in range(k)] for i in range(k)])
        cov = inverse @ meat @ inverse * s["n"] / (s["n"] - k)
    else:
        cov = inverse * max(0.0, s["yy"] - beta @ xy) / max(1, s["n"] - k)
    se = np.sqrt(np.maximum(0, np.diag(cov)))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(se > 0, beta / se, np.nan)
    return pd.DataFrame({"term": names, "coef": beta, "se": se, "t": t, "n": s["n"]})


def _inverse(xx: np.ndarray) -> np.ndarray:
    """Inverse of sums of products whose first column is the constant: the others are centred and scaled first."""
    n, means = xx[0, 0], xx[0] / xx[0, 0]
    means[0] = 0
    shift = np.eye(len(xx))
    shift[0, 1:] = -means[1:]  # columns of shift are the centred variables
    centred = shift.T @ xx @ shift
    scale = 1 / np.sqrt(np.maximum(np.diag(centred), np.finfo(float).tiny))
    scaled = centred * scale[:, None] * scale
    back = shift * scale
    return back @ np.linalg.inv(scaled) @ back.T if n else np.linalg.inv(xx)


def generalised(df: DataFrame, y: str, xs: list[str], family: str):
    """A Poisson or binomial (logit) model over complete rows, fitted by Spark: (term, coef, se) and the deviance."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    d = df.select(F.col(y).cast("double").alias("label"), *(F.col(x).cast("double").alias(x) for x in xs)).dropna()
    d = VectorAssembler(inputCols=xs, outputCol="features").transform(d)
    model = GeneralizedLinearRegression(family=family, maxIter=50, tol=1e-9).fit(d)
    errors = model.summary.coefficientStandardErrors
    terms = [*xs, "_cons"]
    return pd.DataFrame({"term": terms, "coef": [*model.coefficients, model.intercept], "se": errors}), model.summary.deviance
