"""Registered aggregations, statistics and grids."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import aggregates, joins, regressions, stats
from geoloom.plans.base import FEED, TRACTS, feed, t, tracts
from geoloom.plans.joining import _county_squares
from geoloom.plans.registry import register
from geoloom.plans.scans import _FIRE, fires
from geoloom.streaming import live


@register("SELECT n_nationkey, count(s_suppkey) AS n, round(count(s_suppkey) * 100000.0 / (n_nationkey * 1000 + 5000), 4) AS rate FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey")
def agg_a1_count_per_area(spark, d):
    n = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    areas = t(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 1000 + 5000).alias("pop"))
    j = areas.join(n, "n_nationkey", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return j.select("n_nationkey", "n", F.round(F.col("n") * 100000.0 / F.col("pop"), 4).alias("rate"))


@register(f"""WITH {TRACTS}, s AS (SELECT county, sum(minority) AS a, sum(white) AS b, count(*) AS tracts FROM tracts GROUP BY county)
SELECT county, max(tracts) AS tracts, CASE WHEN max(tracts) >= 3 AND max(a) >= 100 AND max(b) >= 100 THEN round(sum(abs(minority / a - white / b)) * 50, 6) END AS d FROM tracts JOIN s USING (county) GROUP BY county""")
def agg_a2_dissimilarity(spark, d):
    x = aggregates.dissimilarity(tracts(spark, d), ["county"], "minority", "white")
    return x.select("county", "tracts", F.round("d", 6).alias("d"))


@register("SELECT o_custkey, CASE WHEN count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) >= 2 THEN round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) / sum(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 9 + 1 END) + 0.0000017, 4) END AS rate FROM orders GROUP BY o_custkey")
def agg_a3_pooled_rate(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("count"), (F.col("o_orderkey") % 9 + 1).alias("pop"))
    return o.groupBy("o_custkey").agg(F.round(aggregates.pooled_rate("count", "pop", 2) + 0.0000017, 4).alias("rate"))


@register("SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) AS weighted, round(avg(l_discount), 8) AS plain FROM lineitem GROUP BY l_suppkey")
def agg_a4_weighted_mean(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(aggregates.weighted_mean("l_discount", "l_quantity"), 8).alias("weighted"), F.round(F.avg("l_discount"), 8).alias("plain"))


@register(f"WITH {TRACTS} SELECT place, segment, CASE WHEN count(*) = count(income) THEN round(sum(income), 2) END AS total FROM tracts GROUP BY 1, 2")
def agg_a5_strict_sum(spark, d):
    return tracts(spark, d).groupBy("place", "segment").agg(F.round(aggregates.strict_sum(F.col("income")), 2).alias("total"))


@register("""WITH x AS (SELECT l_suppkey AS source, l_partkey AS target, sum(CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE l_quantity END) AS w FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN sum(w) OVER s > 0 THEN w / sum(w) OVER s ELSE 1.0 / count(*) OVER s END AS part FROM x WINDOW s AS (PARTITION BY source))
SELECT target, round(sum(part * s_acctbal), 4) AS balance, round(sum(part * 100), 4) AS people FROM p JOIN supplier ON source = s_suppkey GROUP BY target""")
def agg_a6_apportion(spark, d):
    w = F.when(F.col("l_suppkey") % 7 == 0, 0).otherwise(F.col("l_quantity"))
    x = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.sum(w).alias("w"))
    v = t(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_acctbal").alias("balance"), F.lit(100.0).alias("people"))
    out = aggregates.apportion(x, v, "source", "target", "w", ["balance", "people"])
    return out.select("target", F.round("balance", 4).alias("balance"), F.round("people", 4).alias("people"))


@register("""WITH s AS (SELECT c_nationkey, c_mktsegment AS k, round(sum(c_acctbal), 1) AS v FROM customer GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY v DESC, k) AS rn FROM s) SELECT c_nationkey, string_agg(k || ':' || printf('%.1f', v), ',' ORDER BY rn) AS top FROM r WHERE rn <= 3 GROUP BY c_nationkey""")
def agg_a7_top_list(spark, d):
    s = t(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.sum("c_acctbal"), 1).alias("v"))
    return s.groupBy("c_nationkey").agg(aggregates.top_list("c_mktsegment", "v", 3).alias("top"))


@register("SELECT n_regionkey, count(*) AS n, round(100.0 * sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer), 6) AS coverage FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def agg_a8_coverage(spark, d):
    c = t(spark, d, "customer")
    total = c.agg(F.sum("c_acctbal").alias("total"))
    s = c.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    return s.crossJoin(F.broadcast(total)).select("n_regionkey", "n", F.round(100.0 * F.col("s") / F.col("total"), 6).alias("coverage"))


@register("SELECT l_suppkey AS development, count(*) AS buildings, CAST(floor(sum(l_quantity)) AS BIGINT) AS units, min(year(l_shipdate)) AS first_year, max(year(l_shipdate)) AS last_year, round(avg(l_extendedprice), 4) AS mean_price, min(l_partkey) AS first_part FROM lineitem GROUP BY l_suppkey")
def agg_a9_development(spark, d):
    y = F.year("l_shipdate")
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("development")).agg(
        F.count(F.lit(1)).alias("buildings"), F.floor(F.sum("l_quantity")).alias("units"), F.min(y).cast("long").alias("first_year"), F.max(y).cast("long").alias("last_year"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.min("l_partkey").alias("first_part"),
    )


@register("SELECT l_suppkey, round(100 * sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) / sum(l_quantity), 6) AS a, round(100 * sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) / sum(l_quantity), 6) AS n, round(100 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) / sum(l_quantity), 6) AS r FROM lineitem GROUP BY l_suppkey")
def agg_a10_grade_shares(spark, d):
    p = aggregates.grade_shares(t(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"], "l_quantity")
    return p.select("l_suppkey", *(F.round(c, 6).alias(c.lower()) for c in "ANR"))


@register("SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS BIGINT) AS decade, year(o_orderdate) AS year, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def agg_a13_decade_files(spark, d):
    y = F.year("o_orderdate")
    return t(spark, d, "orders").groupBy((F.floor(y / 10) * 10).cast("long").alias("decade"), y.cast("long").alias("year"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT l_suppkey AS point, count(*) AS n, count(DISTINCT lower(l_shipmode)) AS addresses FROM (SELECT l_suppkey, 'A' || l_partkey AS l_shipmode FROM lineitem) GROUP BY 1")
def agg_a14_stacks(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("point")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower(F.concat(F.lit("A"), F.col("l_partkey").cast("string")))).alias("addresses"))


@register(f"""WITH {TRACTS}, c AS (SELECT lon AS x, lat AS y, CAST(floor(lon / 5) AS BIGINT) + dx AS cx, CAST(floor(lat / 5) AS BIGINT) + dy AS cy FROM tracts, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
w AS (SELECT cx, cy, (pow((cx + 0.5) * 5 - x, 2) + pow((cy + 0.5) * 5 - y, 2)) / 100.0 AS d FROM c)
SELECT cx, cy, round(sum(3 / (pi() * 100) * pow(1 - d, 2)), 8) AS density FROM w WHERE d < 1 GROUP BY cx, cy""")
def agg_a15_kernel_density(spark, d):
    return aggregates.grid_density(tracts(spark, d), "lon", "lat", 5.0, 10.0).select("cx", "cy", F.round("density", 8).alias("density"))


@register(f"WITH {_FIRE} SELECT CAST(floor(lat / 2) AS BIGINT) AS r, CAST(floor(lon / 2) AS BIGINT) AS c, count(*) AS n, round(max(frp), 6) AS max_frp, max(ms) AS newest, count(CASE WHEN acq_time < 600 OR acq_time >= 1800 THEN 1 END) AS night FROM fires GROUP BY 1, 2")
def agg_a16_fire_cells(spark, d):
    r, c = geo.cell("lat", "lon", 2)
    return fires(spark, d).groupBy(r.alias("r"), c.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("frp"), 6).alias("max_frp"), F.max("ms").alias("newest"), F.count_if((F.col("acq_time") < 600) | (F.col("acq_time") >= 1800)).alias("night"))


@register("SELECT p_brand AS class, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY p_brand")
def agg_a17_legend(spark, d):
    n = t(spark, d, "part").groupBy(F.col("p_brand").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "class")).cast("long"))


@register("SELECT c.category, count(*) AS n FROM part JOIN (VALUES ('steel', 'STEEL'), ('brass', 'BRASS'), ('gold', 'GOLD')) c(category, needle) ON contains(p_type, needle) GROUP BY 1")
def agg_a18_categories(spark, d):
    tags = F.array(*(F.when(F.col("p_type").contains(n), c) for c, n in (("steel", "STEEL"), ("brass", "BRASS"), ("gold", "GOLD"))))
    return t(spark, d, "part").select(F.explode(F.array_compact(tags)).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {FEED}, r AS (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY speed, seq) AS rn FROM feed) SELECT vehicle, CASE WHEN count(CASE WHEN kind = 'error' THEN 1 END) > 1 THEN 'UNKNOWN' ELSE 'KNOWN' END AS state, count(*) AS n, string_agg(CASE WHEN rn <= 3 THEN CAST(seq AS VARCHAR) END, ',' ORDER BY rn) AS nearest FROM r GROUP BY vehicle")
def agg_a19_cohort(spark, d):
    """Counts, and the three nearest: of each of 64 parts of a vehicle's rows three are left before they meet."""
    f = feed(spark, d)
    totals = f.groupBy("vehicle").agg(F.when(F.count_if(F.col("kind") == "error") > 1, "UNKNOWN").otherwise("KNOWN").alias("state"), F.count(F.lit(1)).alias("n"))
    nearest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("speed", "seq"))), lambda x: x["seq"].cast("string")), ",")
    few = aggregates.first_of_each(f.select("vehicle", "speed", "seq"), "vehicle", ["speed", "seq"], 3)
    return totals.join(few.groupBy("vehicle").agg(nearest.alias("nearest")), "vehicle", "left")


@register(f"WITH {FEED}, s AS (SELECT vehicle, k > 5 AS ok, row_number() OVER (PARTITION BY vehicle, ms ORDER BY seq) AS rn FROM feed) SELECT vehicle, count(CASE WHEN ok AND rn = 1 THEN 1 END) AS accepted, count(CASE WHEN NOT ok OR rn > 1 THEN 1 END) AS rejected, count(CASE WHEN NOT ok OR rn > 1 THEN 1 END) = 0 AS complete FROM s GROUP BY vehicle")
def agg_a20_admission(spark, d):
    return live.admission(feed(spark, d), "vehicle", "ms", F.col("k") > 5, "seq")


@register(f"WITH {FEED} SELECT kind, max(ms) AS newest FROM feed GROUP BY kind")
def agg_a21_newest(spark, d):
    return feed(spark, d).groupBy("kind").agg(F.max("ms").alias("newest"))


@register("SELECT l_suppkey, round(avg(l_discount), 8) AS mean, CASE WHEN count(*) = count(CASE WHEN l_linenumber < 7 THEN l_tax END) THEN round(sqrt(sum(l_tax * l_tax)) / count(*), 8) END AS se, array_to_string(list_sort(list_distinct(list(year(l_shipdate)))), ',') AS years FROM lineitem GROUP BY l_suppkey")
def agg_a22_mean_and_error(spark, d):
    x = t(spark, d, "lineitem").select("l_suppkey", "l_discount", F.when(F.col("l_linenumber") < 7, F.col("l_tax")).alias("se"), F.year("l_shipdate").alias("y"))
    mean, se = aggregates.mean_with_error("l_discount", "se")
    g = x.groupBy("l_suppkey").agg(mean, se, F.array_join(F.sort_array(F.collect_set("y")), ",").alias("years"))
    return g.select("l_suppkey", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"), "years")


@register("SELECT l_suppkey, CAST(floor(year(l_shipdate) / 5) * 5 AS BIGINT) AS block, round(avg(l_discount) * 100, 6) AS mean FROM lineitem WHERE year(l_shipdate) >= 1995 GROUP BY 1, 2")
def agg_a23_block_means(spark, d):
    from geoloom.functions.dates import block_start

    y = F.year("l_shipdate")
    return t(spark, d, "lineitem").where(y >= 1995).groupBy("l_suppkey", block_start(y).alias("block")).agg(F.round(F.avg("l_discount") * 100, 6).alias("mean"))


@register("SELECT l_suppkey, median(l_quantity) AS median FROM lineitem GROUP BY l_suppkey")
def agg_a24_median(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("median"))


@register("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS low, max(l_quantity) AS high, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def agg_a25_summary(spark, d):
    q = "l_quantity"
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("sd"), F.min(q).alias("low"), F.max(q).alias("high"), F.round(F.corr(q, "l_extendedprice"), 6).alias("r"))


@register("SELECT CAST(floor(l_extendedprice / 5000) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def agg_a25_histogram(spark, d):
    return t(spark, d, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 5000).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _cells(spark, d):
    v = tracts(spark, d).groupBy((F.floor(F.col("lon") / 20) * 100 + F.floor(F.col("lat") / 20)).cast("long").alias("id")).agg(F.sum("pop").cast("double").alias("value"))
    return v, joins.contiguity(_county_squares(spark, d), "id", rook=True)


_MORAN = f"""{TRACTS}, v AS (SELECT CAST(floor(lon / 20) AS BIGINT) AS c, CAST(floor(lat / 20) AS BIGINT) AS r, CAST(sum(pop) AS DOUBLE) AS x FROM tracts GROUP BY 1, 2),
z AS (SELECT c, r, x - avg(x) OVER () AS z FROM v), e AS (SELECT a.c, a.r, max(a.z) AS z, avg(b.z) AS lag FROM z a LEFT JOIN z b ON abs(a.c - b.c) + abs(a.r - b.r) = 1 GROUP BY a.c, a.r)"""


@register(f"WITH {_MORAN} SELECT count(*) AS n, count(*) - count(lag) AS islands, round(count(*) * 1.0 / count(lag) * sum(z * lag) / sum(z * z), 8) AS i, round(-1.0 / (count(*) - 1), 8) AS expected FROM e")
def stat_a26_morans_i(spark, d):
    return stats.morans_i(*_cells(spark, d)).select("n", "islands", F.round("i", 8).alias("i"), F.round("expected", 8).alias("expected"))


@register()
def stat_a26_permuted_p(spark, d):
    return stats.permuted_i(*_cells(spark, d)).select(F.round("i", 8).alias("i"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@register(f"WITH {_MORAN} SELECT c * 100 + r AS id, CASE WHEN lag IS NULL THEN NULL WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z <= 0 AND lag <= 0 THEN 'LL' WHEN z > 0 THEN 'HL' ELSE 'LH' END AS cluster FROM e")
def stat_a27_clusters(spark, d):
    return stats.clusters(*_cells(spark, d))


@register(f"WITH {_MORAN}, m AS (SELECT avg(z * z) AS m2 FROM e) SELECT c * 100 + r AS id, round(z, 6) AS z, round(lag, 6) AS lag, round(z * lag / m2, 6) AS i FROM e, m")
def stat_a27_local_i(spark, d):
    return stats.local_morans(*_cells(spark, d), permutations=9).select("id", *(F.round(c, 6).alias(c) for c in ("z", "lag", "i")))


@register()
def stat_a27_local_p(spark, d):
    return stats.local_morans(*_cells(spark, d)).select("id", "cluster", "p", "significant")


@register("SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS coef, count(*) AS n FROM lineitem UNION ALL SELECT '_cons', round(regr_intercept(l_extendedprice, l_quantity), 4), count(*) FROM lineitem")
def stat_a28_least_squares(spark, d):
    m = stats.least_squares(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame(m[["term", "coef", "n"]]).select("term", F.round("coef", 4).alias("coef"), F.col("n").cast("long").alias("n"))


@register()
def stat_a28_poisson(spark, d):
    m, _ = stats.generalised(t(spark, d, "lineitem").withColumn("y", F.col("l_linenumber")), "y", ["l_quantity", "l_discount"], "poisson")
    return spark.createDataFrame(m)


@register()
def stat_a28_logit(spark, d):
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select(F.col("quality").alias("y"), F.log1p("n_chars").alias("length"))
    m, _ = stats.generalised(j, "y", ["length"], "binomial")
    return spark.createDataFrame(m)


def _measured_cells(spark, d):
    """The cells of 20 degrees with measures, and their contiguity."""
    cell = (F.floor(F.col("lon") / 20) * 100 + F.floor(F.col("lat") / 20)).cast("long").alias("id")
    v = tracts(spark, d).groupBy(cell).agg((100 * F.sum("minority") / F.sum("pop")).alias("share"), (F.avg("income") / 1000).alias("income"), F.log(F.sum("pop")).alias("people"))
    return v, joins.contiguity(_county_squares(spark, d), "id", rook=True)


def _terms(spark, fit, *columns):
    names = ["term", *columns]
    return spark.createDataFrame(fit[names]).select("term", *(F.round(c, 6).alias(c) for c in columns))


@register()
def stat_a28_spatial_lag(spark, d):
    v, edges = _measured_cells(spark, d)
    return _terms(spark, regressions.spatial_lag(v, "share", ["income", "people"], edges), "coef", "se", "z", "log_likelihood")


@register()
def stat_a28_spatial_error(spark, d):
    v, edges = _measured_cells(spark, d)
    return _terms(spark, regressions.spatial_error(v, "share", ["income", "people"], edges), "coef", "se", "z", "log_likelihood")


@register()
def stat_a28_spatial_lag_probes(spark, d):
    """The lag model whose log-determinant comes from random probes, as it does for many areas."""
    v, edges = _measured_cells(spark, d)
    return _terms(spark, regressions.spatial_lag(v, "share", ["income"], edges, exact=0, probes=8, steps=6), "coef", "se", "log_det_se")


@register()
def stat_a28_spatial_lag_instruments(spark, d):
    v, edges = _measured_cells(spark, d)
    return _terms(spark, regressions.spatial_lag_iv(v, "share", ["income", "people"], edges, robust=True), "coef", "se", "z")


@register()
def stat_a28_negative_binomial(spark, d):
    orders = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("units"), F.avg("l_discount").alias("discount"), F.first("l_suppkey").alias("supplier"))
    return _terms(spark, regressions.fitted(orders, "units", ["lines", "discount"], "negative binomial"), "coef", "se", "log_likelihood")


@register("""WITH r AS (SELECT l_suppkey AS g, CAST(l_quantity AS DOUBLE) - avg(l_quantity) OVER () AS x, CAST(l_extendedprice AS DOUBLE) - avg(l_extendedprice) OVER () AS y FROM lineitem),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n, count(DISTINCT g) AS m FROM r),
s AS (SELECT g, sum(x * (y - b * x)) AS s FROM r, b GROUP BY g)
SELECT 'l_quantity' AS term, round(max(b), 4) AS coef, round(sqrt(sum(s * s) * max(m * 1.0 / (m - 1) * (n - 1) / (n - 2))) / max(xx), 4) AS se, max(n) AS n, max(m) AS clusters FROM s, b""")
def stat_a28_clustered(spark, d):
    fit = regressions.fitted(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "gaussian", cluster="l_suppkey")
    return spark.createDataFrame(fit).where("term = 'l_quantity'").select("term", F.round("coef", 4).alias("coef"), F.round("se", 4).alias("se"), F.col("n").cast("long").alias("n"), F.col("clusters").cast("long").alias("clusters"))


@register("SELECT count(*) <> count(DISTINCT l_orderkey * 10 + l_linenumber) AS repeated FROM lineitem")
def agg_a29_distinct_ids(spark, d):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t(spark, d, "lineitem").agg((F.count(F.lit(1)) != F.count_distinct(key)).alias("repeated"))


@register(f"WITH {TRACTS} SELECT state, county, count(*) AS n, CAST(sum(pop) AS BIGINT) AS pop FROM tracts GROUP BY ROLLUP (state, county)")
def agg_a31_rollup(spark, d):
    return tracts(spark, d).rollup("state", "county").agg(F.count(F.lit(1)).alias("n"), F.sum("pop").alias("pop"))


@register(f"WITH {TRACTS}, s AS (SELECT state, sum(minority) AS a, sum(pop) AS b FROM tracts GROUP BY state) SELECT round(sum(a) * 100.0 / sum(b), 8) AS national FROM s")
def agg_a32_national(spark, d):
    s = tracts(spark, d).groupBy("state").agg(F.sum("minority").alias("a"), F.sum("pop").alias("b"))
    return s.agg(F.round(F.sum("a") * 100.0 / F.sum("b"), 8).alias("national"))


@register("SELECT o_custkey, round(100.0 * sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) / count(*), 2) AS share FROM orders GROUP BY o_custkey")
def agg_a33_cell_sums(spark, d):
    hit = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.round(100.0 * F.sum(hit) / F.count(F.lit(1)), 2).alias("share"))
