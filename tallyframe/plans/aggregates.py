"""Queries of grouped aggregates, sets and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import samples as P
from ..operators.quantiles import exact_quantiles
from ..registry import query, r6


@query("agg1_count_vs_size", "SELECT l_suppkey, count(x) AS n_known, count(*) AS n_all, round(sum(x), 6) AS s, round(avg(x), 6) AS m FROM (SELECT l_suppkey, CASE WHEN l_discount > 0.02 THEN l_discount END AS x FROM lineitem) GROUP BY l_suppkey")
def agg1(t):
    x = F.when(F.col("l_discount") > 0.02, F.col("l_discount"))
    return t.lineitem.select("l_suppkey", x.alias("x")).groupBy("l_suppkey").agg(F.count("x").alias("n_known"), F.count("*").alias("n_all"), r6(F.sum("x")).alias("s"), r6(F.avg("x")).alias("m"))


@query("agg2_named", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 6) AS s, min(o_totalprice) AS lo, arg_min(o_orderpriority, o_orderdate) AS first_priority FROM orders GROUP BY o_custkey")
def agg2(t):
    # As in SQL, orders without a date or a priority are never the first; orders of one date, which SQL leaves open, go by key.
    dated = F.when(F.col("o_orderdate").isNotNull() & F.col("o_orderpriority").isNotNull(), F.struct("o_orderdate", "o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), r6(F.sum("o_totalprice")).alias("s"), F.min("o_totalprice").alias("lo"), F.min_by("o_orderpriority", dated).alias("first_priority"))


@query("agg3_global_mean", "WITH {EV} SELECT round(avg(y), 6) AS prior FROM ev")
def agg3(t):
    return t.ev.agg(r6(F.avg("y")).alias("prior"))


@query("agg4_count_distinct", "WITH {EV} SELECT season, count(DISTINCT entity) AS entities, count(DISTINCT part) AS parts FROM ev GROUP BY season")
def agg4(t):
    return t.ev.groupBy("season").agg(F.count_distinct("entity").alias("entities"), F.count_distinct("part").alias("parts"))


@query("agg5_moments", "WITH {EV} SELECT entity, round(avg(price), 4) AS m, round(stddev_samp(price), 4) AS sd1, round(stddev_pop(price), 4) AS sd0, round(var_samp(qty), 4) AS v1 FROM ev GROUP BY entity")
def agg5(t):
    return t.ev.groupBy("entity").agg(F.round(F.avg("price"), 4).alias("m"), F.round(F.stddev_samp("price"), 4).alias("sd1"), F.round(F.stddev_pop("price"), 4).alias("sd0"), F.round(F.var_samp("qty"), 4).alias("v1"))


@query("agg6_quantiles", "WITH {EV} SELECT entity, round(quantile_cont(price, 0.25), 6) AS q1, round(quantile_cont(price, 0.5), 6) AS q2, round(quantile_cont(price, 0.9), 6) AS q3 FROM ev GROUP BY entity")
def agg6(t):
    q = exact_quantiles(t.ev, ["entity"], "price", (0.25, 0.5, 0.9))
    return q.select("entity", *[r6(F.col("quantiles")[i]).alias(f"q{i + 1}") for i in range(3)])


@query("agg7_mode", "WITH {EV}, n AS (SELECT entity, qty, count(*) AS n FROM ev GROUP BY entity, qty) SELECT entity, qty AS mode FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, qty) AS k FROM n) WHERE k = 1")
def agg7(t):
    return A.mode(t.ev, ["entity"], "qty")


@query("agg8_shares", "WITH {EV} SELECT entity, flag, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY entity), 6) AS share FROM ev GROUP BY entity, flag")
def agg8(t):
    return A.shares(t.ev, ["entity"], "flag").withColumn("share", r6("share"))


@query("agg9_last_row", "WITH {EV} SELECT entity, season, qty, price FROM (SELECT *, row_number() OVER (PARTITION BY entity, season ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS k FROM ev) WHERE k = 1")
def agg9(t):
    return A.last_row(t.ev, ["entity", "season"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "qty", "price")


@query("agg10_last_n", "WITH {EV} SELECT entity, CAST(sum(y) FILTER (k <= 1) AS BIGINT) AS s1, CAST(sum(y) FILTER (k <= 3) AS BIGINT) AS s3, CAST(sum(y) AS BIGINT) AS s5 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS k FROM ev) WHERE k <= 5 GROUP BY entity HAVING count(*) = 5")
def agg10(t):
    rows = A.last_rows(t.ev, ["entity"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], 5)
    upto = lambda n: F.sum(F.when(F.col("from_end") <= n, F.col("y")).otherwise(0))
    return rows.groupBy("entity").agg(F.count("*").alias("n"), upto(1).alias("s1"), upto(3).alias("s3"), upto(5).alias("s5")).where("n = 5").drop("n")


@query("agg11_pivot", "WITH {EV} SELECT entity, count(*) FILTER (flag = 'A') AS flag_A, count(*) FILTER (flag = 'N') AS flag_N, count(*) FILTER (flag = 'R') AS flag_R FROM ev GROUP BY entity")
def agg11(t):
    return A.pivot_counts(t.ev, ["entity"], "flag", ["A", "N", "R"])


@query("agg12_target_groups", """WITH {EV}, g AS (
  SELECT 'season' AS key, CAST(season AS VARCHAR) AS value, y FROM ev UNION ALL SELECT 'flag', flag, y FROM ev UNION ALL SELECT 'status', status, y FROM ev UNION ALL SELECT 'line', CAST(line AS VARCHAR), y FROM ev)
SELECT key, value, count(*) AS n, CAST(sum(y) AS BIGINT) AS s, round(avg(y), 6) AS rate FROM g GROUP BY key, value""")
def agg12(t):
    return A.target_groups(t.ev, ["season", "flag", "status", "line"], "y").withColumn("rate", r6("rate"))


@query("agg13_conditional_sums", "WITH {EV} SELECT entity, CAST(sum(CAST(qty >= 10 AS INTEGER)) AS BIGINT) AS n10, CAST(sum(CAST(qty >= 25 AS INTEGER)) AS BIGINT) AS n25, CAST(sum(CAST(qty >= 40 AS INTEGER)) AS BIGINT) AS n40 FROM ev GROUP BY entity")
def agg13(t):
    return t.ev.groupBy("entity").agg(*[F.count_if(F.col("qty") >= q).alias(f"n{q}") for q in (10, 25, 40)])


@query("agg14_decayed", "WITH {EV} SELECT entity, round(sum(pow(0.7, 1999 - season) * y) / (sum(pow(0.7, 1999 - season)) + 50), 6) AS rate FROM ev WHERE season < 2000 GROUP BY entity")
def agg14(t):
    return A.decayed(t.ev, ["entity"], "y", "season", 2000, 0.7).select("entity", r6(F.col("ws") / (F.col("w") + 50)).alias("rate"))


CELLS = "WITH {EV}, c AS (SELECT entity, flag, count(qty) AS n, avg(qty) AS m, coalesce(var_samp(qty), 0) AS v FROM ev GROUP BY entity, flag)"


@query("agg15_variance_parts", CELLS + """, s AS (SELECT entity, sum(n) AS n, CASE WHEN sum(n - 1) > 0 THEN sum((n - 1) * v) / sum(n - 1) ELSE 0 END AS w, greatest(sum(n * m * m) / sum(n) - pow(sum(n * m) / sum(n), 2), 0) AS b FROM c GROUP BY entity)
SELECT entity, CAST(n AS BIGINT) AS n, round(w, 4) AS within, round(b, 4) AS between, round(CASE WHEN w + b > 0 THEN w / (w + b) ELSE 0 END, 6) AS within_share FROM s""")
def agg15(t):
    out = A.variance_parts(t.ev, "entity", ["flag"], "qty")
    return out.select("entity", "n", F.round("within", 4).alias("within"), F.round("between", 4).alias("between"), r6("within_share").alias("within_share"))


@query("agg16_mixture", CELLS + " SELECT entity, CAST(sum(n) AS BIGINT) AS n, round(sum(n * m) / sum(n), 6) AS mean, round(sqrt(sum(n * (v + m * m)) / sum(n) - pow(sum(n * m) / sum(n), 2)), 4) AS sd FROM c GROUP BY entity")
def agg16(t):
    return A.mixture_moments(t.ev, "entity", ["flag"], "qty").select("entity", "n", r6("mean").alias("mean"), F.round("sd", 4).alias("sd"))


@query("agg17_pooled_correlation", """WITH {EV}, d AS (SELECT entity, qty - avg(qty) OVER w AS a, disc - avg(disc) OVER w AS b FROM ev WINDOW w AS (PARTITION BY entity, flag))
SELECT entity, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS r FROM d GROUP BY entity""")
def agg17(t):
    return A.pooled_correlation(t.ev, "entity", ["flag"], "qty", "disc").withColumn("r", r6("r"))


@query("agg18_ellipse", """WITH {EV}, s AS (SELECT entity, var_samp(qty) AS a, var_samp(line) AS b, corr(qty, line) AS r FROM ev GROUP BY entity),
e AS (SELECT entity, (a + b) / 2 AS m, sqrt(pow((a - b) / 2, 2) + pow(r * sqrt(a * b), 2)) AS g FROM s)
SELECT entity, round(ln(sqrt((m + g) * (m - g))), 5) AS log_area, round(sqrt((m + g) / (m - g)), 5) AS ratio FROM e""")
def agg18(t):
    s = t.ev.groupBy("entity").agg(F.var_samp("qty").alias("a"), F.var_samp("line").alias("b"), F.corr("qty", "line").alias("r"))
    area, ratio = A.ellipse(F.col("a"), F.col("b"), F.col("r"))
    return s.select("entity", F.round(area, 5).alias("log_area"), F.round(ratio, 5).alias("ratio"))


@query("agg19_entropy", "WITH {EV}, p AS (SELECT entity, count(*) / sum(count(*)) OVER (PARTITION BY entity) AS p FROM ev GROUP BY entity, flag) SELECT entity, round(sum(-p * ln(greatest(p, 1e-12))), 6) AS entropy FROM p GROUP BY entity")
def agg19(t):
    return A.shares(t.ev, ["entity"], "flag").groupBy("entity").agg(r6(F.sum(S.entropy_term(F.col("share")))).alias("entropy"))


@query("agg20_correlation_levels", """WITH {EV}, w AS (SELECT qty - avg(qty) OVER (PARTITION BY entity) AS a, price - avg(price) OVER (PARTITION BY entity) AS b FROM ev),
g AS (SELECT avg(qty) AS a, avg(price) AS b FROM ev GROUP BY entity)
SELECT round((SELECT corr(qty, price) FROM ev), 6) AS pooled, round((SELECT corr(a, b) FROM g), 6) AS between, round((SELECT corr(a, b) FROM w), 6) AS within""")
def agg20(t):
    means = t.ev.groupBy("entity").agg(F.avg("qty").alias("_a"), F.avg("price").alias("_b"))
    # One scan for the entity means, one for the rows centred by them.
    centred = t.ev.join(means, "entity").agg(F.corr(F.col("qty") - F.col("_a"), F.col("price") - F.col("_b")).alias("within"), F.corr("qty", "price").alias("pooled"))
    return centred.crossJoin(means.agg(F.corr("_a", "_b").alias("between"))).select(r6("pooled").alias("pooled"), r6("between").alias("between"), r6("within").alias("within"))


@query("agg21_correlation_matrix", "WITH {EV} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM ev" for a, b in (("qty", "price"), ("qty", "disc"), ("qty", "tax"), ("price", "disc"), ("price", "tax"), ("disc", "tax"))))
def agg21(t):
    return A.correlations(t.ev, ["qty", "price", "disc", "tax"]).withColumn("r", r6("r"))


@query("agg22_category_effects", """WITH {EV}, g AS (SELECT 'flag' AS key, flag AS value, count(*) AS n, avg(disc) AS m FROM ev GROUP BY flag UNION ALL SELECT 'line', CAST(line AS VARCHAR), count(*), avg(disc) FROM ev GROUP BY line), o AS (SELECT avg(disc) AS o FROM ev)
SELECT key, round(sqrt(sum(n * pow(m - o, 2)) / sum(n)), 8) AS effect, round(min(m), 6) AS low, round(max(m), 6) AS high FROM g, o GROUP BY key""")
def agg22(t):
    groups = A.target_groups(t.ev, ["flag", "line"], "disc")
    return groups.crossJoin(F.broadcast(t.ev.agg(F.avg("disc").alias("o")))).groupBy("key").agg(
        F.round(F.sqrt(F.sum(F.col("n") * F.pow(F.col("rate") - F.col("o"), 2)) / F.sum("n")), 8).alias("effect"), r6(F.min("rate")).alias("low"), r6(F.max("rate")).alias("high"))


@query("agg23_extremes", """WITH {EV}, r AS (SELECT part, count(*) AS n, avg(y) AS rate FROM ev GROUP BY part HAVING count(*) >= 20)
SELECT * FROM (SELECT 'low' AS side, part, n, round(rate, 6) AS rate FROM r ORDER BY r.rate, part LIMIT 10) UNION ALL SELECT * FROM (SELECT 'high', part, n, round(rate, 6) FROM r ORDER BY r.rate DESC, part LIMIT 10)""")
def agg23(t):
    rates = t.ev.groupBy("part").agg(F.count("*").alias("n"), F.avg("y").alias("rate")).where("n >= 20")
    side = lambda name, order: rates.orderBy(order, "part").limit(10).select(F.lit(name).alias("side"), "part", "n", r6("rate").alias("rate"))
    return side("low", F.asc("rate")).unionByName(side("high", F.desc("rate")))


@query("agg24_calibration", "SELECT CAST(least(floor(l_discount * 100), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(l_discount), 6) AS feature, round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS rate FROM lineitem GROUP BY 1")
def agg24(t):
    b = F.least(F.floor(F.col("l_discount") * 100), F.lit(9)).cast("int")
    return t.lineitem.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("l_discount")).alias("feature"), r6(F.avg((F.col("l_returnflag") == "R").cast("int"))).alias("rate"))


@query("agg25_gram", "WITH {EV} SELECT season, count(*) AS n, " + ", ".join(f"round(avg({a} * {b}), 6) AS g_{a}_{b}" for a, b in (("disc", "disc"), ("disc", "tax"), ("disc", "y"), ("tax", "tax"), ("tax", "y"), ("y", "y"))) + " FROM ev GROUP BY season")
def agg25(t):
    g = A.gram(t.ev, ["disc", "tax", "y"], ["season"])
    return g.select("season", "n", *[r6(c).alias(c) for c in g.columns if c.startswith("g_")])


@query("agg26_shift_share", """WITH {EV}, c AS (SELECT entity, season, count(*) AS n, avg(y) AS m FROM ev GROUP BY entity, season), w AS (SELECT season, count(*) AS total, avg(y) AS mean FROM ev GROUP BY season),
i AS (SELECT b.season, sum(b.n * (b.m - a.m)) AS s FROM c b JOIN c a ON a.entity = b.entity AND b.season = a.season + 1 WHERE a.n >= 5 AND b.n >= 5 GROUP BY b.season)
SELECT w.season, round(w.mean - p.mean, 6) AS change, round(coalesce(i.s / w.total, 0), 6) AS within, round(w.mean - p.mean - coalesce(i.s / w.total, 0), 6) AS composition FROM w JOIN w p ON w.season = p.season + 1 LEFT JOIN i ON i.season = w.season""")
def agg26(t):
    out = A.shift_share(t.ev, "entity", "season", "y", 5)
    return out.select("season", *[r6(c).alias(c) for c in ("change", "within", "composition")])


@query("agg27_seen_before", "WITH {EV}, f AS (SELECT part, min(season) AS first FROM ev GROUP BY part) SELECT season, round(avg(CAST(first < season AS INTEGER)), 6) AS seen FROM ev JOIN f USING (part) GROUP BY season")
def agg27(t):
    first = t.ev.groupBy("part").agg(F.min("season").alias("first"))
    return t.ev.select("part", "season").join(first, "part").groupBy("season").agg(r6(F.avg((F.col("first") < F.col("season")).cast("int"))).alias("seen"))


@query("agg28_trend", "WITH {EV}, r AS (SELECT entity, season, avg(y) AS m FROM ev WHERE season BETWEEN 1996 AND 1999 GROUP BY entity, season) SELECT entity, round(regr_slope(m, season), 6) AS slope, round(avg(m) + regr_slope(m, season) * (2000 - avg(season)), 6) AS at_2000 FROM r GROUP BY entity HAVING count(*) >= 3")
def agg28(t):
    yearly = t.ev.where("season between 1996 and 1999").groupBy("entity", "season").agg(F.avg("y").alias("m"))
    slope = F.regr_slope("m", "season")
    return yearly.groupBy("entity").agg(F.count("*").alias("n"), r6(slope).alias("slope"), r6(F.avg("m") + slope * (2000 - F.avg("season"))).alias("at_2000")).where("n >= 3").drop("n")


@query("agg29_winsorised", "WITH {EV}, q AS (SELECT quantile_cont(price, 0.9) AS q FROM ev) SELECT entity, round(avg(least(price, q)), 6) AS m FROM ev, q GROUP BY entity")
def agg29(t):
    cap = exact_quantiles(t.ev, [], "price", (0.9,)).select(F.col("quantiles")[0].alias("q"))
    return t.ev.crossJoin(F.broadcast(cap)).groupBy("entity").agg(r6(F.avg(F.least("price", "q"))).alias("m"))


@query("agg30_profile", "WITH {EV} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS sd, min({c}) AS low, max({c}) AS high, round(corr({c}, y), 5) AS r, round(quantile_cont({c}, 0.1), 5) AS q1, round(quantile_cont({c}, 0.5), 5) AS q5, round(quantile_cont({c}, 0.9), 5) AS q9 FROM ev" for c in ("qty", "price", "disc", "tax")))
def agg30(t):
    p = A.profile(t.ev, ["qty", "price", "disc", "tax"], "y", (0.1, 0.5, 0.9))
    rounded = [F.round(c, 5).alias(c) for c in ("mean", "sd")] + ["low", "high", F.round("r", 5).alias("r")]
    return p.select("name", "n", "missing", *rounded, *[F.round(F.col("quantiles")[i], 5).alias(f"q{q}") for i, q in enumerate((1, 5, 9))])


@query("agg31_systematic_sample", "SELECT event_id, user_id FROM events WHERE event_id % 10 = 0")
def agg31(t):
    return P.every_kth(t.events, "event_id", 10).select("event_id", "user_id")


@query("agg32_duplicates", "WITH {EV}, g AS (SELECT count(*) AS n, min(y) AS a, max(y) AS b FROM ev GROUP BY basket, line) SELECT count(*) FILTER (n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS surplus, CAST(coalesce(sum(n) FILTER (a < b), 0) AS BIGINT) AS conflicting FROM g")
def agg32(t):
    return A.duplicates(t.ev, ["basket", "line"], "y")


@query("agg33_violations", """WITH v AS (SELECT 'price' AS rule, o_orderkey AS id FROM orders WHERE NOT (o_totalprice < 400000) UNION ALL SELECT 'status', o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('F', 'O')) UNION ALL SELECT 'key', o_orderkey FROM orders WHERE NOT (o_orderkey >= 0)),
k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY id) AS k FROM v), n AS (SELECT unnest(['price', 'status', 'key']) AS rule)
SELECT rule, count(id) AS n, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (k <= 5), '') AS examples FROM n LEFT JOIN k USING (rule) GROUP BY rule""")
def agg33(t):
    return A.violations(t.orders, {"price": F.col("o_totalprice") < 400000, "status": F.col("o_orderstatus").isin("F", "O"), "key": F.col("o_orderkey") >= 0}, "o_orderkey")


@query("agg34_agreement", "SELECT round(avg(CAST(a = b AS INTEGER)) FILTER (a IS NOT NULL AND b IS NOT NULL), 6) AS agreement FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 5 > 0 THEN 'F' END AS b FROM orders)")
def agg34(t):
    a, b = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 5 > 0, "F")
    return t.orders.agg(r6(F.avg((a == b).cast("int"))).alias("agreement"))


@query("agg35_nested_deviation", """WITH {EV}, p AS (SELECT entity, avg(y) AS pm FROM ev GROUP BY entity), c AS (SELECT entity, flag, line, count(y) AS n, avg(y) AS m FROM ev GROUP BY entity, flag, line)
SELECT entity, flag, line, n, round(n / (n + 30.0) * (m - pm), 6) AS dev FROM c JOIN p USING (entity)""")
def agg35(t):
    return A.nested_deviation(t.ev, ["entity"], ["entity", "flag", "line"], "y", 30.0).withColumn("dev", r6("dev"))


@query("agg36_contrast", """WITH {EV}, s AS (SELECT entity, count(*) FILTER (line = 1) AS a, count(*) FILTER (line <> 1) AS b, avg(y) FILTER (line = 1) AS m, avg(y) FILTER (line <> 1) AS k FROM ev GROUP BY entity)
SELECT entity, round(a * b / (a + b), 6) AS n_eff, round((a * b / (a + b)) / (a * b / (a + b) + 40.0) * (m - k), 6) AS contrast FROM s WHERE a > 0 AND b > 0""")
def agg36(t):
    return A.two_level_contrast(t.ev, "entity", F.col("line") == 1, "y", 40.0).select("entity", r6("n_eff").alias("n_eff"), r6("contrast").alias("contrast"))


@query("srt1_total_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS k FROM orders")
def srt1(t):
    return P.total_order(t.orders, ["o_custkey"], ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"], "k").select("o_orderkey", F.col("k").cast("long").alias("k"))


@query("srt2_arg_best", "SELECT p_brand, arg_max(p_partkey, p_retailprice * 1e9 - p_size * 1e6 - p_partkey) AS best FROM part GROUP BY p_brand")
def srt2(t):
    return P.arg_best(t.part, ["p_brand"], "p_partkey", F.col("p_retailprice"), -F.col("p_size"), -F.col("p_partkey")).withColumnRenamed("p_partkey", "best")


@query("srt3_top_k", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def srt3(t):
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("smp1_hash_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def smp1(t):
    return P.hash_sample(t.orders, "o_orderkey", 500, 42).select("o_orderkey")


@query("smp2_evenly_spaced", "WITH {EV}, r AS (SELECT entity, basket, part, row_number() OVER (PARTITION BY entity ORDER BY {ORD}) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM ev) SELECT entity, basket, part FROM r WHERE n <= 8 OR i = 0 OR floor(i * 7 / (n - 1)) > floor((i - 1) * 7 / (n - 1))")
def smp2(t):
    return P.evenly_spaced(t.ev, ["entity"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], 8).select("entity", "basket", "part")


@query("smp3_half_split", "SELECT CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 2 AS INTEGER) AS half, count(*) AS n FROM orders GROUP BY 1")
def smp3(t):
    return t.orders.groupBy(S.md5_fold(F.col("o_orderkey"), 2).alias("half")).agg(F.count("*").alias("n"))


@query("smp4_hash_folds", "SELECT o_orderkey, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 3 AS INTEGER) AS fold FROM orders")
def smp4(t):
    return t.orders.select("o_orderkey", S.md5_fold(F.col("o_orderkey"), 3).alias("fold"))


@query("set1_union_by_name", "SELECT c_custkey AS k, c_acctbal AS bal, CAST(NULL AS VARCHAR) AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def set1(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")).unionByName(t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


@query("set2_intersect_except", "SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'left', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set2(t):
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return n("both", a.intersect(b)).unionByName(n("left", a.subtract(b)))


@query("set3_distinct", "SELECT DISTINCT l_suppkey, l_linestatus, l_returnflag FROM lineitem")
def set3(t):
    return t.lineitem.select("l_suppkey", "l_linestatus", "l_returnflag").distinct()
