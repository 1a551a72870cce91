"""Census-style aggregations: apportionment, pooled rates, dissimilarity, null-aware sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.operators import scratch

#: Tracts that an area needs, and people of each group, before a dissimilarity index is given.
LEAST_TRACTS, LEAST_GROUP = 3, 100


def strict_sum(x: Column) -> Column:
    """Sum that is null if any value is."""
    return F.when(F.bool_and(x.isNotNull()), F.sum(x))


def pooled_rate(count: str, weight: str, least_years: int = 1) -> Column:
    """Sum of counts over sum of weights, of rows that have both; null below so many rows."""
    both = F.col(count).isNotNull() & (F.col(weight) > 0)
    return F.when(F.count_if(both) >= least_years, F.sum(F.when(both, F.col(count))) / F.sum(F.when(both, F.col(weight))))


def weighted_mean(x: str, weight: str) -> Column:
    ok = F.col(x).isNotNull() & F.col(weight).isNotNull()
    return F.sum(F.when(ok, F.col(x) * F.col(weight))) / F.nullif(F.sum(F.when(ok, F.col(weight))), F.lit(0))


def apportion(crosswalk: DataFrame, values: DataFrame, source: str, target: str, weight: str, columns: list[str]) -> DataFrame:
    """Counts of source areas shared among target areas by weight; a source without weight is split evenly."""
    own = W.partitionBy(source)
    total = F.sum(weight).over(own)
    part = F.when(total > 0, F.col(weight) / total).otherwise(1 / F.count(F.lit(1)).over(own))
    j = crosswalk.withColumn("_part", part).join(values, source)
    return j.groupBy(target).agg(*(F.sum(F.col(c) * F.col("_part")).alias(c) for c in columns))


def dissimilarity(tracts: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, tracts, d): half the sum over tracts of |a / A - b / B|, in percent; null for few tracts or small groups.

    Totals and the sum are two aggregations on the same key, joined without carrying rows through a window.
    """
    totals = tracts.groupBy(*by).agg(F.sum(a).alias("_a"), F.sum(b).alias("_b"), F.count(F.lit(1)).alias("tracts"))
    away = F.abs(F.col(a) / F.nullif(F.col("_a"), F.lit(0)) - F.col(b) / F.nullif(F.col("_b"), F.lit(0)))
    sums = tracts.join(totals, by).groupBy(*by).agg(F.first("tracts").alias("tracts"), F.min("_a").alias("_a"), F.min("_b").alias("_b"), F.sum(away).alias("_s"))
    enough = (F.col("tracts") >= LEAST_TRACTS) & (F.col("_a") >= LEAST_GROUP) & (F.col("_b") >= LEAST_GROUP)
    return sums.select(*by, "tracts", F.when(enough, F.col("_s") * 50).alias("d"))


def mean_with_error(x: str, se: str) -> list[Column]:
    """Mean, and the standard error of the mean of independent estimates; null if any error is missing."""
    return [F.avg(x).alias("mean"), F.when(F.bool_and(F.col(se).isNotNull()), F.sqrt(F.sum(F.col(se) * F.col(se))) / F.count(F.lit(1))).alias("se")]


def top_list(key: str, value: str, n: int) -> Column:
    """"key:value" of the n largest values, ties by key, comma-joined."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))))
    return F.array_join(F.transform(F.slice(ordered, 1, n), lambda x: F.concat(x["k"].cast("string"), F.lit(":"), F.format_string("%.1f", -x["v"]))), ",")


def first_of_each(rows: DataFrame, key: str, order: list[str], n: int, parts: int = 64) -> DataFrame:
    """The first n rows of each key: n of each of some parts of a key first, so that a hot key never meets whole."""
    salt = F.pmod(F.xxhash64(*order), F.lit(parts))
    some = rows.withColumn("_s", salt).withColumn("_k", F.row_number().over(W.partitionBy(key, "_s").orderBy(*order))).where(F.col("_k") <= n).drop("_s", "_k")
    return some.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def grid_density(points: DataFrame, x: str, y: str, cell: float, reach: float) -> DataFrame:
    """Quartic kernel density per unit area on a grid: (cx, cy, density) of the cells whose centres are within reach.

    Each point adds to the cells around it; sums are combined before the shuffle.
    """
    r = int(-(-reach // cell))
    near = F.sequence(F.lit(-r), F.lit(r))
    placed = points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("cx", F.explode(F.transform(near, lambda k: (F.floor(F.col("_x") / cell) + k).cast("long"))))
    placed = placed.withColumn("cy", F.explode(F.transform(near, lambda k: (F.floor(F.col("_y") / cell) + k).cast("long"))))
    d2 = F.pow((F.col("cx") + 0.5) * cell - F.col("_x"), F.lit(2)) + F.pow((F.col("cy") + 0.5) * cell - F.col("_y"), F.lit(2))
    scale = 3 / (3.141592653589793 * reach * reach)
    return placed.withColumn("_d", d2 / (reach * reach)).where("_d < 1").groupBy("cx", "cy").agg(F.sum(scale * F.pow(1 - F.col("_d"), F.lit(2))).alias("density"))


def index_breaks(values: DataFrame, column: str, parts: list[float], least: float) -> DataFrame:
    """The values at place floor(p * n) of the ascending values from `least` on, by p.

    Ranks come from counts of distinct values, dealt out by range, so nothing is collected into one list or one task.
    """
    counts = values.where(F.col(column) >= least).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.written(counts)
    ranked = scratch.prefix_sums(counts, "v", "n").crossJoin(F.broadcast(counts.agg(F.sum("n").alias("of"))))
    asked = F.explode(F.array(*map(F.lit, parts))).alias("p")
    return ranked.select("v", "upto", "n", "of", asked).withColumn("at", F.floor(F.col("p") * F.col("of"))).where("at >= upto - n and at < upto").select("p", F.col("v").alias("break"))


def runs(cells: DataFrame, by: list[str], at: str, band: str) -> DataFrame:
    """Neighbouring cells of one band joined: (by, band, first, last)."""
    island = F.col(at) - F.row_number().over(W.partitionBy(*by, band).orderBy(at))
    return cells.withColumn("_i", island).groupBy(*by, band, "_i").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("_i")


def in_all_periods(rows: DataFrame, key: str, period: str, needed: list, size: Column | None = None, least: float = 0) -> DataFrame:
    """(key) of those with a row in every needed period, of at least a size in each if one is given."""
    some = rows.where(F.col(period).isin(*needed))
    some = some if size is None else some.where(size >= least)
    return some.groupBy(key).agg(F.count_distinct(period).alias("_n")).where(F.col("_n") == len(needed)).select(key)


def without_stacks(points: DataFrame, place: list[str], address: str, least_points: int = 10, least_addresses: int = 3) -> DataFrame:
    """points without those of places that are a fallback: many points of several addresses in one spot."""
    stacked = points.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(F.lower(F.col(address).cast("string"))).alias("_a")).where((F.col("_n") >= least_points) & (F.col("_a") >= least_addresses))
    return points.join(stacked.select(*place), place, "left_anti")


def within_budget(rows: DataFrame, by: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """The first rows of each group whose sizes add up to the budget at most, with the sum so far as `used`."""
    used = F.sum(size).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    over = F.max(F.col("used") > most).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).withColumn("_over", over).where(~F.col("_over")).drop("_over")


def rising(rows: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """(key, rising, n): whether a key's times only rise in their order."""
    up = F.col(time) > F.lag(time).over(W.partitionBy(key).orderBy(order))
    return rows.select(key, up.alias("_up")).groupBy(key).agg(F.coalesce(F.bool_and("_up"), F.lit(True)).alias("rising"), F.count(F.lit(1)).alias("n"))


def grade_shares(areas: DataFrame, by: str, grade: str, grades: list[str], area: str) -> DataFrame:
    """(by, areas, a share in percent for each grade) of what is graded; rows of other grades and null ones are left out.

    A grade that a group lacks has a null share, as has a group without graded area.
    """
    some = areas.where(F.col(grade).isin(*grades))
    of = lambda g: F.sum(F.when(F.col(grade) == g, F.col(area)))
    return some.groupBy(by).agg(F.count(F.lit(1)).alias("areas"), *((100 * of(g) / F.nullif(F.sum(area), F.lit(0))).alias(g) for g in grades))
