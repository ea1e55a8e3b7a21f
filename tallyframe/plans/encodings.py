"""Queries of projections, filters, bins, keys, encodings and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import rows as R
from ..registry import query, r6


@query("prj1_prefix_view", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def prj1(t):
    return R.select_prefix(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_")


@query("prj2_feature_blocks", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS a, round(l_extendedprice / 100, 6) AS b, CAST(l_tax > 0.04 AS INTEGER) AS c FROM lineitem")
def prj2(t):
    ratio = {"a": r6(F.col("l_quantity") * F.col("l_discount")), "b": r6(F.col("l_extendedprice") / 100)}
    return R.with_blocks(t.lineitem, ratio, {"c": (F.col("l_tax") > 0.04).cast("int")}).select("l_orderkey", "l_linenumber", "a", "b", "c")


@query("prj3_coercing_cast", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS n FROM events")
def prj3(t):
    raw = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_id").cast("string"))
    return t.events.select("event_id", S.number(raw, "long").alias("n"))


@query("prj4_null_fill", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, -1) AS bal FROM customer")
def prj4(t):
    return t.customer.select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.lit(-1.0)).alias("bal"))


@query("prj5_drop_nulls", "SELECT c_custkey, c_acctbal AS bal FROM customer WHERE c_acctbal > 0")
def prj5(t):
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal")).dropna(subset=["bal"])


@query("prj6_drop_columns", "SELECT p_partkey, p_brand, p_type, p_size FROM part")
def prj6(t):
    return R.drop_columns(t.part, "p_name", "p_retailprice")


@query("flt1_mask", "SELECT event_id FROM events WHERE (event_type IN ('click', 'purchase') AND value > 50) OR (event_type <> 'click' AND NOT coalesce(value >= 10, false))")
def flt1(t):
    kind, v = F.col("event_type"), F.col("value")
    return t.events.where(S.true((kind.isin("click", "purchase") & (v > 50)) | ((kind != "click") & ~S.true(v >= 10)))).select("event_id")


@query("flt2_temporal_split", "WITH {EV} SELECT CASE WHEN season = 1999 THEN 'valid' ELSE 'train' END AS side, count(*) AS n, CAST(sum(y) AS BIGINT) AS s FROM ev WHERE season <= 1999 GROUP BY 1")
def flt2(t):
    train, valid = R.temporal_split(t.ev, "season", 1999)
    both = train.withColumn("side", F.lit("train")).unionByName(valid.withColumn("side", F.lit("valid")))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.sum("y").alias("s"))


@query("flt3_history_window", "WITH {EV} SELECT season, count(*) AS n FROM ev WHERE season >= 1997 AND season < 1999 GROUP BY season")
def flt3(t):
    return R.history_window(t.ev, "season", 1999, 2).groupBy("season").agg(F.count("*").alias("n"))


@query("flt4_validity", "SELECT count(*) AS n FROM lineitem WHERE l_quantity <= 30 AND l_discount <= 0.05 AND l_tax <= 0.06")
def flt4(t):
    return t.lineitem.where("l_quantity <= 30 and l_discount <= 0.05 and l_tax <= 0.06").agg(F.count("*").alias("n"))


@query("flt5_regime_exclusion", "WITH {EV} SELECT season, status, count(*) AS n FROM ev WHERE NOT (status = 'F' AND season < 1998) GROUP BY season, status")
def flt5(t):
    return R.exclude_regime(t.ev, F.col("status") == "F", "season", 1998).groupBy("season", "status").agg(F.count("*").alias("n"))


@query("cse1_case_ladder", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderstatus = 'P' THEN 'open' ELSE 'plain' END AS band FROM orders")
def cse1(t):
    band = F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderstatus") == "P", "open")
    return t.orders.select("o_orderkey", band.otherwise("plain").alias("band"))


@query("cse2_label_taxonomy", "WITH {EV} SELECT basket, part, entity, line, CASE WHEN qty <= 0 THEN 'invalid' WHEN y = 1 THEN 'hit' WHEN disc >= 0.08 THEN 'miss_deep' WHEN tax >= 0.06 THEN 'miss_tax' ELSE 'miss' END || ':' || status AS label FROM ev")
def cse2(t):
    label = R.outcome_label(F.col("qty") > 0, F.col("y") == 1, [("miss_deep", F.col("disc") >= 0.08), ("miss_tax", F.col("tax") >= 0.06)], "miss", F.col("status"))
    return t.ev.select("basket", "part", "entity", "line", label.alias("label"))


@query("bin1_right_closed", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 0 WHEN l_quantity > 10 AND l_quantity <= 25 THEN 1 WHEN l_quantity > 25 AND l_quantity <= 45 THEN 2 ELSE -1 END AS bin FROM lineitem")
def bin1(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.right_closed_bin(F.col("l_quantity"), (0, 10, 25, 45)).alias("bin"))


@query("bin2_digitize", "SELECT o_orderkey, CAST(o_totalprice >= 50000 AS INTEGER) + CAST(o_totalprice >= 150000 AS INTEGER) + CAST(o_totalprice >= 250000 AS INTEGER) AS bin FROM orders")
def bin2(t):
    return t.orders.select("o_orderkey", S.digitize(F.col("o_totalprice"), (50000, 150000, 250000)).alias("bin"))


@query("bin3_fixed_width", "SELECT event_id, CAST(coalesce(floor((least(greatest(value, 0), 100) - 0) / 7.5 + 1e-9), -1) AS INTEGER) AS bin FROM events")
def bin3(t):
    return t.events.select("event_id", S.fixed_bin(F.col("value"), 0, 100, 7.5).alias("bin"))


@query("bin4_log2_count", "SELECT o_custkey, CAST(floor(log2(count(*) + 1)) AS INTEGER) AS bin FROM orders GROUP BY o_custkey")
def bin4(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", S.log_count_bin(F.col("n")).alias("bin"))


@query("bin5_named_buckets", """SELECT c_custkey, CASE WHEN bal IS NULL THEN 'missing' WHEN bal < 1000 THEN 'low' WHEN bal < 5000 THEN 'mid' ELSE 'high' END AS band,
  CAST(least(floor(rate * 10), 9) AS INTEGER) AS tenth FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal, CASE WHEN c_acctbal > 0 THEN least(c_acctbal / 9000, 1) END AS rate FROM customer)""")
def bin5(t):
    bal = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return t.customer.select("c_custkey", S.ladder(bal, ((1000, "low"), (5000, "mid")), "high").alias("band"), S.decile(F.least(bal / 9000, F.when(bal.isNotNull(), 1.0))).alias("tenth"))


@query("bin6_clip", "SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(CAST(l_quantity AS INTEGER) - 25, -4), 4) AS c, least(l_linenumber, 5) AS d FROM lineitem")
def bin6(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.clip(F.col("l_quantity").cast("int") - 25, -4, 4).alias("c"), F.least("l_linenumber", F.lit(5)).alias("d"))


@query("key1_composite", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '__missing__') || '|' || o_orderpriority AS k FROM orders")
def key1(t):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", S.composite_key(status, F.col("o_orderpriority")).alias("k"))


@query("key2_mixed_radix", "WITH {EV} SELECT basket, part, entity, line, ((least(line, 15) * 2 + CAST(status = 'O' AS INTEGER)) * 3 + y) * 4 + CAST(qty AS INTEGER) % 4 AS code FROM ev")
def key2(t):
    digits = [(F.least("line", F.lit(15)), 16), ((F.col("status") == "O").cast("int"), 2), (F.col("y"), 3), (F.col("qty").cast("int") % 4, 4)]
    return t.ev.select("basket", "part", "entity", "line", S.mixed_radix(digits).alias("code"))


@query("key3_symmetric_pair", "SELECT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def key3(t):
    trade = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    pair = R.symmetric_pair("s_nationkey", "c_nationkey")
    return trade.groupBy(pair[0].alias("a"), pair[1].alias("b")).agg(F.count("*").alias("n"))


@query("key4_role_swap", "WITH {EV} SELECT basket, part, entity, line, CASE WHEN status = 'O' THEN part ELSE entity END AS home, CASE WHEN status = 'O' THEN entity ELSE part END AS away FROM ev")
def key4(t):
    home, away = R.role_swap(F.col("status") == "O", "part", "entity")
    return t.ev.select("basket", "part", "entity", "line", home.alias("home"), away.alias("away"))


@query("key5_pressure", "WITH {EV} SELECT basket, part, entity, line, CASE WHEN line = 3 AND qty < 20 THEN 1 WHEN line < 3 AND qty = 20 THEN 2 WHEN line = 3 AND qty = 20 THEN 3 ELSE 0 END AS pressure FROM ev")
def key5(t):
    return t.ev.select("basket", "part", "entity", "line", R.pressure("line", "qty", 3, 20).alias("pressure"))


@query("enc1_cell_products", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN l_discount ELSE 0 END AS o_n, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN l_discount ELSE 0 END AS f_r FROM lineitem")
def enc1(t):
    is_cell = lambda s, f: (F.col("l_linestatus") == s) & (F.col("l_returnflag") == f)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *S.one_hot_products(F.col("l_discount"), {"o_n": is_cell("O", "N"), "f_r": is_cell("F", "R")}))


@query("enc2_ordinal_codes", """WITH known AS (SELECT o_orderpriority AS v, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE year(o_orderdate) < 1996 AND o_orderpriority <> '5-LOW'))
SELECT o_orderkey, coalesce(code, 0) AS code FROM orders LEFT JOIN known ON o_orderpriority = v""")
def enc2(t):
    train = t.orders.where((F.year("o_orderdate") < 1996) & (F.col("o_orderpriority") != "5-LOW"))
    return R.ordinal_encode(t.orders, train, "o_orderpriority", "code").select("o_orderkey", "code")


@query("enc3_top_categories", """WITH top AS (SELECT p_type AS v FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 5)
SELECT p_partkey, CASE WHEN v IS NULL THEN 'OTHER' ELSE p_type END AS kind FROM part LEFT JOIN top ON p_type = v""")
def enc3(t):
    return R.keep_top_categories(t.part, t.part, "p_type", 5, "kind").select("p_partkey", "kind")


@query("enc4_label_map", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'buy' WHEN event_type IN ('click', 'view') THEN event_type ELSE 'Other' END AS kind FROM events")
def enc4(t):
    return t.events.select("event_id", R.normalise_label(F.col("event_type"), {"purchase": "buy"}, ("buy", "click", "view"), "Other").alias("kind"))


@query("fn1_math", """SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_quantity), 6) AS a, round(ln(1 + l_tax), 6) AS b, round(exp(l_discount) - 1, 6) AS c, round(log2(l_quantity), 6) AS d, round(sqrt(l_extendedprice), 6) AS e,
  round_even(l_quantity / 2, 0) AS f, sign(l_discount - 0.05) AS g, CAST(floor(l_quantity / 7) AS BIGINT) AS h, round(sqrt(l_quantity * l_quantity + 9), 6) AS i, CAST(l_orderkey % 7 AS BIGINT) AS j FROM lineitem""")
def fn1(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(F.ln(q)).alias("a"), r6(F.log1p("l_tax")).alias("b"), r6(F.expm1("l_discount")).alias("c"), r6(F.log2(q)).alias("d"),
        r6(F.sqrt("l_extendedprice")).alias("e"), F.rint(q / 2).alias("f"), F.signum(F.col("l_discount") - 0.05).cast("int").alias("g"), F.floor(q / 7).alias("h"), r6(F.hypot(q, F.lit(3.0))).alias("i"), (F.col("l_orderkey") % 7).alias("j"),
    )


@query("fn2_safe_divide", "SELECT c_custkey, CASE WHEN n > 0 THEN round(s / n, 6) ELSE 0 END AS mean FROM (SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_totalprice), 0) AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)")
def fn2(t):
    sums = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("s"))
    return sums.select("c_custkey", r6(S.safe_divide(F.col("s"), F.col("n"), 0.0)).alias("mean"))


@query("fn3_logit_expit", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(p) - ln(1 - p), 6) AS z, round(1 / (1 + exp(-(ln(p) - ln(1 - p)))), 6) AS p FROM (SELECT *, least(greatest(l_discount, 0.001), 0.999) AS p FROM lineitem)")
def fn3(t):
    z = S.logit(F.col("l_discount"), 0.001)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r6(z).alias("z"), r6(S.expit(z)).alias("p"))


@query("fn4_interpolate", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity < 20 THEN (l_quantity - 5) * (0.6 / 15) WHEN l_quantity < 40 THEN 0.6 + (l_quantity - 20) * (0.4 / 20) ELSE 1 END, 6) AS v FROM lineitem")
def fn4(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r6(S.interpolate(F.col("l_quantity"), (5, 20, 40), (0.0, 0.6, 1.0))).alias("v"))


@query("fn5_cyclic", "SELECT o_orderkey, round(sin(month(o_orderdate) * (2 * pi() / 12)), 6) + 0 AS s, round(cos(month(o_orderdate) * (2 * pi() / 12)), 6) + 0 AS c FROM orders")
def fn5(t):
    s, c = S.cyclic(F.month("o_orderdate"), 12)
    return t.orders.select("o_orderkey", (r6(s) + 0).alias("s"), (r6(c) + 0).alias("c"))


@query("fn6_gcd_lcm", "SELECT o_orderkey, CAST(gcd(o_orderkey, o_custkey) AS BIGINT) AS g, CAST(lcm(o_orderkey, o_custkey) AS BIGINT) AS l FROM orders")
def fn6(t):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", S.gcd(a, b).alias("g"), S.lcm(a, b).alias("l"))


@query("fn7_strings", """SELECT p_partkey, upper(p_brand) AS a, string_split(p_name, ' ')[1] AS b, contains(p_type, 'A') AS c, starts_with(p_brand, 'Brand') AS d, substr(p_name, 2, 4) AS e, replace(p_type, ' ', '_') AS f,
  regexp_extract(p_brand, '([0-9]+)', 1) AS g, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER) AS h FROM part""")
def fn7(t):
    return t.part.select(
        "p_partkey", F.upper("p_brand").alias("a"), F.split("p_name", " ")[0].alias("b"), F.col("p_type").contains("A").alias("c"), F.col("p_brand").startswith("Brand").alias("d"), F.substring("p_name", 2, 4).alias("e"),
        F.replace("p_type", F.lit(" "), F.lit("_")).alias("f"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("g"), F.size(F.regexp_extract_all("p_name", F.lit("[aeiou]"), F.lit(0))).alias("h"),
    )


@query("fn8_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS wd, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders")
def fn8(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    d = S.parse_date(text)
    return t.orders.select("o_orderkey", d.alias("d"), F.weekday(d).alias("wd"), F.month(d).alias("m"))


@query("fn9_digest", "SELECT o_custkey, md5(string_agg(o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey)) AS digest FROM orders GROUP BY o_custkey")
def fn9(t):
    states = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"])
    return t.orders.groupBy("o_custkey").agg(F.md5(F.array_join(states, ",")).alias("digest"))


@query("fn10_arrays", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS s, list_max(embedding)::DOUBLE AS m, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) - 1 AS at FROM embeddings")
def fn10(t):
    e = F.col("embedding")
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.embeddings.select("vec_id", r6(total).alias("s"), F.array_max(e).cast("double").alias("m"), (F.array_position(e, F.array_max(e)) - 1).alias("at"))


@query("fn11_map_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS code FROM orders")
def fn11(t):
    table = F.create_map(F.lit("F"), F.lit(2), F.lit("O"), F.lit(1))
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(table, F.col("o_orderstatus")), F.lit(0)).alias("code"))


@query("fn12_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn12(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("fn13_null_tests", "SELECT CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (x IS NOT NULL) AS BIGINT) AS finite FROM (SELECT CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer)")
def fn13(t):
    x = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.lit(float("nan")))
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return t.customer.agg(F.count_if(x.isNull() | F.isnan(x)).alias("missing"), F.count_if(finite).alias("finite"))


@query("fn14_signed_hashing", """WITH tokens AS (SELECT o_custkey, unnest(['p=' || o_orderpriority, 's=' || o_orderstatus, 'ps=' || o_orderpriority || o_orderstatus]) AS t FROM orders),
parts AS (SELECT o_custkey, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket, CASE WHEN ('0x' || substr(md5(t), 9, 1))::BIGINT >= 8 THEN 1 ELSE -1 END AS sign FROM tokens)
SELECT o_custkey, bucket, CAST(sum(sign) AS BIGINT) AS v FROM parts GROUP BY o_custkey, bucket""")
def fn14(t):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    tokens = F.array(F.concat(F.lit("p="), p), F.concat(F.lit("s="), s), F.concat(F.lit("ps="), p, s))
    return t.orders.select("o_custkey", F.explode(S.signed_buckets(tokens, 6)).alias("h")).groupBy("o_custkey", "h.bucket").agg(F.sum("h.sign").alias("v"))


@query("fn15_robust_scale", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b, stddev_pop(value) AS sd FROM events)
SELECT event_id, round(least(greatest((value - m) / CASE WHEN b - a > 0 THEN (b - a) / 1.349 WHEN sd > 0 THEN sd ELSE 1 END, -6), 6), 6) AS z FROM events, q""")
def fn15(t):
    return R.robust_scale(t.events, "value", "z").select("event_id", r6("z").alias("z"))


@query("fn16_standardise", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.5) AS m, avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM orders WHERE year(o_orderdate) < 1998)
SELECT o_orderkey, round((coalesce(CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END, m) - mu) / sd, 6) AS z FROM orders, q""")
def fn16(t):
    rows = t.orders.withColumn("x", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice")))
    source = t.orders.where(F.year("o_orderdate") < 1998).withColumn("x", F.col("o_totalprice"))
    return R.standardise(rows, source, "x", "z").select("o_orderkey", r6("z").alias("z"))
