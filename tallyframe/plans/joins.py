"""Queries of lookups, joins and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import neighbours as N
from ..operators import samples as P
from ..operators import similarity as M
from ..operators.intervals import interval_join, seconds_since_1970
from ..registry import query, r6


@query("jn1_lookup", "WITH {EV}, r AS (SELECT entity, avg(y) AS rate FROM ev GROUP BY entity HAVING count(*) > 600) SELECT basket, part, line, e.entity, round(coalesce(rate, 0.5), 6) AS rate FROM ev e LEFT JOIN r ON r.entity = e.entity")
def jn1(t):
    rates = t.ev.groupBy("entity").agg(F.avg("y").alias("rate"), F.count("*").alias("n")).where("n > 600")
    return J.lookup(t.ev, rates, ["entity"], {"rate": 0.5}).select("basket", "part", "line", "entity", r6("rate").alias("rate"))


@query("jn2_composite_lookup", "WITH {EV}, r AS (SELECT entity, line, season + 1 AS season, sum(y) AS s, count(*) AS n FROM ev GROUP BY ALL) SELECT basket, part, e.line, e.entity, CAST(coalesce(s, 0) AS BIGINT) AS s, coalesce(n, 0) AS n FROM ev e LEFT JOIN r ON r.entity = e.entity AND r.line = e.line AND r.season = e.season")
def jn2(t):
    sums = t.ev.groupBy("entity", "line", (F.col("season") + 1).alias("season")).agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    return J.lookup(t.ev, sums, ["entity", "line", "season"], {"s": 0, "n": 0}).select("basket", "part", "line", "entity", "s", "n")


@query("jn3_order_kept", "SELECT o_orderkey, c_mktsegment AS seg, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jn3(t):
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg")), "o_custkey", "left")
    return P.total_order(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "k").select("o_orderkey", "seg", F.col("k").cast("long").alias("k"))


@query("jn4_contracted", "SELECT o_orderkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def jn4(t):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    return J.contracted_join(t.orders.select("o_orderkey", "o_custkey"), customers, ["o_custkey"], "many_to_one").drop("o_custkey")


@query("jn5_suffixed", "WITH {EV}, s AS (SELECT entity, season, count(*) AS n, avg(y) AS m FROM ev GROUP BY entity, season) SELECT a.entity, a.season, a.n AS n_a, round(a.m, 6) AS m_a, b.n AS n_b, round(b.m, 6) AS m_b FROM s a JOIN s b ON a.entity = b.entity AND a.season = b.season - 1")
def jn5(t):
    s = t.ev.groupBy("entity", "season").agg(F.count("*").alias("n"), r6(F.avg("y")).alias("m"))
    return J.suffixed_join(s, s.withColumn("season", F.col("season") - 1), ["entity", "season"], "_a", "_b")


@query("jn7_fallback_chain", """WITH {EV}, a AS (SELECT entity, line, season + 1 AS season, avg(y) AS v FROM ev GROUP BY ALL HAVING count(*) >= 10), b AS (SELECT line, season + 1 AS season, avg(y) AS v FROM ev GROUP BY ALL HAVING count(*) >= 1000)
SELECT basket, part, e.line, e.entity, round(coalesce(a.v, b.v, 0), 6) AS v FROM ev e LEFT JOIN a ON a.entity = e.entity AND a.line = e.line AND a.season = e.season LEFT JOIN b ON b.line = e.line AND b.season = e.season""")
def jn7(t):
    past = t.ev.withColumn("season", F.col("season") + 1)
    a = past.groupBy("entity", "line", "season").agg(F.avg("y").alias("v"), F.count("*").alias("n")).where("n >= 10")
    b = past.groupBy("line", "season").agg(F.avg("y").alias("v"), F.count("*").alias("n")).where("n >= 1000")
    return J.fallback_lookup(t.ev, [(a, ["entity", "line", "season"]), (b, ["line", "season"])], "v", "v", 0.0).select("basket", "part", "line", "entity", r6("v").alias("v"))


@query("jn8_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def jn8(t):
    big = t.orders.where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(big, "c_custkey", "left_semi")


@query("jn9_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def jn9(t):
    big = t.orders.where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(big, "c_custkey", "left_anti")


#: Two logs of the same baskets: the second has other ids and lacks every seventh basket.
LOGS = """{EV}, a AS (SELECT basket, CAST(part * 100 + CAST(qty AS INTEGER) AS BIGINT) AS state, line, part FROM ev),
b AS (SELECT 1000000 - basket AS other, CAST(part * 100 + CAST(qty AS INTEGER) AS BIGINT) AS state, line, part FROM ev WHERE basket % 7 <> 0)"""


def logs(t):
    state = (F.col("part") * 100 + F.col("qty").cast("int")).cast("long")
    a = t.ev.select("basket", state.alias("state"), "line", "part")
    return a, a.where("basket % 7 <> 0").select((1000000 - F.col("basket")).alias("other"), "state", "line", "part")


@query("jn10_fingerprint_link", "WITH " + LOGS + """, pa AS (SELECT basket, string_agg(state || ':' || c, ',' ORDER BY state || ':' || c) AS p FROM (SELECT basket, state, count(*) AS c FROM a GROUP BY ALL) GROUP BY basket),
pb AS (SELECT other, string_agg(state || ':' || c, ',' ORDER BY state || ':' || c) AS p FROM (SELECT other, state, count(*) AS c FROM b GROUP BY ALL) GROUP BY other),
m AS (SELECT basket, other, count(*) OVER (PARTITION BY basket) AS x, count(*) OVER (PARTITION BY other) AS y FROM pa JOIN pb USING (p)) SELECT basket, other FROM m WHERE x = 1 AND y = 1""")
def jn10(t):
    return linked(t)


def linked(t):
    a, b = logs(t)
    prints = J.fingerprints(a, ["basket"], "state").drop("size").join(J.fingerprints(b, ["other"], "state").drop("size"), "print")
    return J.one_to_one(prints.select("basket", "other"), "basket", "other")


@query("jn11_zip_rows", "WITH " + LOGS + """, x AS (SELECT basket, state, row_number() OVER (PARTITION BY basket ORDER BY line, state) AS place FROM a), y AS (SELECT other, state, row_number() OVER (PARTITION BY other ORDER BY line, state) AS place FROM b)
SELECT basket, other, CAST(place AS INTEGER) AS place, x.state = y.state AS same FROM x JOIN y USING (place) WHERE other = 1000000 - basket""")
def jn11(t):
    a, b = logs(t)
    pairs = a.select("basket").distinct().select("basket", (1000000 - F.col("basket")).alias("other"))
    out = J.zip_rows(a, b.withColumnRenamed("state", "state_b").drop("line_b"), pairs, "basket", "other", ["line", "state"], ["line", "state_b"])
    return out.select("basket", "other", "place", (F.col("state") == F.col("state_b")).alias("same"))


BLOCKED = "WITH " + LOGS + """, c AS (SELECT DISTINCT a.basket, b.other FROM a JOIN b USING (part, line))"""


@query("jn12_blocked_pairs", BLOCKED + " SELECT basket, other FROM c")
def jn12(t):
    return blocked(t).select("basket", "other")


def blocked(t):
    a, b = logs(t)
    return J.blocked_pairs(a, b, "basket", "other", ["part", "line"], "state")


SIMILAR = BLOCKED + """, ca AS (SELECT basket, state, count(*) AS c FROM a GROUP BY ALL), cb AS (SELECT other, state, count(*) AS c FROM b GROUP BY ALL),
na AS (SELECT basket, sum(c) AS n, count(*) AS d FROM ca GROUP BY basket), nb AS (SELECT other, sum(c) AS n, count(*) AS d FROM cb GROUP BY other),
s AS (SELECT c.basket, c.other, coalesce(sum(least(ca.c, coalesce(cb.c, 0))), 0) AS s, count(cb.c) AS k FROM c JOIN ca ON ca.basket = c.basket LEFT JOIN cb ON cb.other = c.other AND cb.state = ca.state GROUP BY ALL),
d AS (SELECT basket, other, 2 * s / (na.n + nb.n) AS dice, k / (na.d + nb.d - k) AS jaccard FROM s JOIN na USING (basket) JOIN nb USING (other))"""


@query("jn13_dice_jaccard", SIMILAR + " SELECT basket, other, round(dice, 6) AS dice, round(jaccard, 6) AS jaccard FROM d")
def jn13(t):
    out = blocked(t).dropna(subset=["basket", "other"])
    return out.select("basket", "other", r6("dice").alias("dice"), r6("jaccard").alias("jaccard"))


@query("jn14_mutual_best", SIMILAR + """, r AS (SELECT *, row_number() OVER x AS ra, row_number() OVER y AS rb, dice - coalesce(lead(dice) OVER x, 0) AS ma, dice - coalesce(lead(dice) OVER y, 0) AS mb FROM d WINDOW x AS (PARTITION BY basket ORDER BY dice DESC, other), y AS (PARTITION BY other ORDER BY dice DESC, basket))
SELECT basket, other FROM r WHERE ra = 1 AND rb = 1 AND ma >= 0.05 AND mb >= 0.05""")
def jn14(t):
    # A pair without a shared state is no one's best by a margin, and as a runner-up it counts as none does.
    scored = blocked(t).where("dice > 0")
    return J.mutual_best(scored, "basket", "other", "dice", 0.05).select("basket", "other")


@query("jn12_similar_candidates", SIMILAR + " SELECT basket, other FROM d WHERE dice >= 0.6")
def jn12_similar(t):
    a, b = logs(t)
    return M.similar_pairs(a, b, "basket", "other", "state", 0.6, ["part", "line"]).select("basket", "other")


@query("jn13_similar_pairs", SIMILAR.replace("JOIN b USING (part, line)", "JOIN b USING (state)") + " SELECT basket, other, round(dice, 6) AS dice, round(jaccard, 6) AS jaccard FROM d WHERE dice >= 0.4")
def jn13_similar(t):
    a, b = logs(t)
    out = M.similar_pairs(a, b, "basket", "other", "state", 0.4)
    return out.select("basket", "other", r6("dice").alias("dice"), r6("jaccard").alias("jaccard"))


@query("jn14_best_links", SIMILAR + """, r AS (SELECT *, row_number() OVER x AS ra, row_number() OVER y AS rb, dice - coalesce(lead(dice) OVER x, 0) AS ma, dice - coalesce(lead(dice) OVER y, 0) AS mb FROM d WINDOW x AS (PARTITION BY basket ORDER BY dice DESC, other), y AS (PARTITION BY other ORDER BY dice DESC, basket))
SELECT basket, other, round(dice, 6) AS dice FROM r WHERE ra = 1 AND rb = 1 AND ma >= 0.05 AND mb >= 0.05 AND dice >= 0.5""")
def jn14_links(t):
    a, b = logs(t)
    return M.best_links(a, b, "basket", "other", "state", 0.5, 0.05, ["part", "line"]).select("basket", "other", r6("dice").alias("dice"))


@query("jn15_sequence_alignment", """WITH RECURSIVE {EV}, a AS (SELECT basket, CAST(part * 100 + CAST(qty AS INTEGER) AS BIGINT) AS state, line FROM ev),
x AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY line, state) AS o FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY o) AS j FROM x WHERE (basket + line) % 9 <> 0),
n AS (SELECT basket, (SELECT count(*) FROM x WHERE x.basket = k.basket) + (SELECT count(*) FROM y WHERE y.basket = k.basket) AS n FROM (SELECT DISTINCT basket FROM x) k),
m AS (SELECT x.basket, x.o AS i, y.j, y.o AS oj FROM x JOIN y ON x.basket = y.basket AND x.state = y.state),
c AS (SELECT basket, i, j, 1 AS k, [{'i': i, 'j': j}] AS p, [oj] AS q FROM m
  UNION ALL SELECT c.basket, m.i, m.j, k + 1, list_append(p, {'i': m.i, 'j': m.j}), list_append(q, oj) FROM c JOIN m ON m.basket = c.basket AND m.i > c.i AND m.j > c.j),
best AS (SELECT basket, k, p, q FROM c QUALIFY row_number() OVER (PARTITION BY basket ORDER BY k DESC, p) = 1)
SELECT basket, 1000000 - basket AS other, unnest(list_transform(p, lambda z: z.i)) AS order_a, unnest(q) AS order_b FROM best JOIN n USING (basket) WHERE 2 * k >= 0.9 * n""")
def jn15(t):
    a, b = logs(t)
    order = F.row_number().over(P.Window.partitionBy("basket").orderBy("line", "state")).cast("long")
    x = a.withColumn("o", order)
    y = x.where("(basket + line) % 9 <> 0").select((1000000 - F.col("basket")).alias("other"), "o", "state")
    pairs = x.select("basket").distinct().select("basket", (1000000 - F.col("basket")).alias("other"))
    return M.align_sequences(x, y, pairs, "basket", "other", "o", "state", 0.9)


@query("jn16_identity_map", """WITH {EV}, n AS (SELECT part, CASE WHEN basket % 20 = 0 THEN part % 13 ELSE part + 5000 END AS code, count(*) AS n FROM ev GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, code) AS k, n / sum(n) OVER (PARTITION BY part) AS purity FROM n),
u AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, part) AS j FROM t WHERE k = 1 AND purity >= 0.9) SELECT part, code, n, round(purity, 6) AS purity FROM u WHERE j = 1""")
def jn16(t):
    coded = t.ev.select("part", F.when(F.col("basket") % 20 == 0, F.col("part") % 13).otherwise(F.col("part") + 5000).alias("code"))
    return J.identity_map(coded, "part", "code", 0.9).withColumn("purity", r6("purity"))


@query("jn17_context_overlap", """WITH {EV}, a AS (SELECT status, flag, line, count(*) AS n FROM ev WHERE season = 1996 GROUP BY ALL), b AS (SELECT status, flag, line, count(*) AS c FROM ev WHERE season = 1997 AND line < 7 GROUP BY ALL),
j AS (SELECT coalesce(c, 0) AS c, sum(n) AS w FROM a LEFT JOIN b USING (status, flag, line) GROUP BY 1), r AS (SELECT c, sum(w) OVER (ORDER BY c) AS run, sum(w) OVER () AS total FROM j)
SELECT min(c) FILTER (run >= 0.1 * total) AS q10, min(c) FILTER (run >= 0.5 * total) AS q50, min(c) FILTER (run >= 0.9 * total) AS q90 FROM r""")
def jn17(t):
    keys = ["status", "flag", "line"]
    a = t.ev.where("season = 1996").groupBy(*keys).agg(F.count("*").alias("n"))
    b = t.ev.where("season = 1997 and line < 7").groupBy(*keys).agg(F.count("*").alias("c"))
    return J.weighted_quantile(J.lookup(a, b, keys, {"c": 0}), "c", "n", (0.1, 0.5, 0.9))


@query("jn18_bucketed_knn", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT q.vec_id, p.vec_id AS proto, sqrt(list_sum(list_transform(list_zip(q.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM e q JOIN e p ON q.label = p.label AND q.vec_id <> p.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, proto) AS rank FROM d) SELECT vec_id, proto, CAST(rank AS INTEGER) AS rank, round(dist, 5) AS dist FROM r WHERE rank <= 3""")
def jn18(t):
    e = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    out = N.nearest_prototypes(e, e.withColumnRenamed("vec_id", "proto"), "label", "vec_id", "proto", "v", 3)
    return out.select("vec_id", "proto", "rank", F.round("dist", 5).alias("dist"))


@query("jn18_prototype_means", """WITH raw AS (SELECT label, vec_id, vec_id % 500 + 1 AS n, (vec_id * 37 % 101) / 101 AS y, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
c AS (SELECT pos, quantile_cont(x, 0.5) AS m, CASE WHEN (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349 > 1e-3 THEN (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349 WHEN stddev_pop(x) > 1e-3 THEN stddev_pop(x) ELSE 1 END AS s
  FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM raw) GROUP BY pos),
l AS (SELECT list(m ORDER BY pos) AS ms, list(s ORDER BY pos) AS ss FROM c),
e AS (SELECT label, vec_id, n, y, list_transform(list_zip(v, ms, ss), lambda z: greatest(least((z[1] - z[2]) / z[3], 6.0), -6.0)) AS v FROM raw, l),
d AS (SELECT q.vec_id, p.n, p.y, p.vec_id AS proto, sqrt(list_sum(list_transform(list_zip(q.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM e q JOIN e p ON q.label = p.label AND q.vec_id <> p.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, proto) AS rank FROM d), w AS (SELECT *, sqrt(least(n, 256)) / (1 + dist) AS w FROM r WHERE rank <= 8)
SELECT vec_id, round(sum(w * y) / sum(w), 6) AS y, count(*) AS neighbours FROM w GROUP BY vec_id""")
def jn18_means(t):
    y = (F.col("vec_id") * 37 % 101 / 101).alias("y")
    e = t.embeddings.select("vec_id", "label", (F.col("vec_id") % 500 + 1).alias("n"), y, "embedding")
    z = N.scaled(e, N.robust_scales(e, "embedding"), "embedding")
    protos = z.withColumnRenamed("vec_id", "proto")
    near = N.nearest_prototypes(z, protos, "label", "vec_id", "proto", "embedding", 8)
    return N.neighbour_means(near, protos, "vec_id", "proto", "n", ["y"]).select("vec_id", r6("y").alias("y"), "neighbours")


@query("jn19_history_expansion", """WITH {EV}, h AS (SELECT entity, price, row_number() OVER (PARTITION BY entity ORDER BY {ORD}) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM ev WHERE season = 1996),
s AS (SELECT entity, avg(price) AS m, count(*) AS k FROM h WHERE n <= 5 OR i = 0 OR floor(i * 4 / (n - 1)) > floor((i - 1) * 4 / (n - 1)) GROUP BY entity)
SELECT basket, part, line, e.entity, round(m, 6) AS mean, k AS sampled FROM ev e LEFT JOIN s ON s.entity = e.entity WHERE season = 1997""")
def jn19(t):
    past = t.ev.where("season = 1996")
    out = J.expand_from_history(t.ev.where("season = 1997"), past, ["entity"], "entity", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "price", 5)
    return out.select("basket", "part", "line", "entity", r6("mean").alias("mean"), "sampled")


@query("jn20_aligned_artifacts", "SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS y, round(value / 200, 6) AS p1, round(value / 400, 6) AS p2 FROM events")
def jn20(t):
    y = (F.col("event_type") == "purchase").cast("int").alias("y")
    a = t.events.select("event_id", y, r6(F.col("value") / 200).alias("p1"))
    return J.aligned(a, t.events.select("event_id", y, r6(F.col("value") / 400).alias("p2")), "event_id", "y")


@query("jn21_grid_completion", """WITH {EV}, g AS (SELECT entity, line FROM (SELECT DISTINCT entity FROM ev), (SELECT unnest([1, 2, 3, 8]) AS line)), n AS (SELECT entity, line, count(*) AS n FROM ev GROUP BY ALL)
SELECT entity, line, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (entity, line)""")
def jn21(t):
    n = t.ev.groupBy("entity", "line").agg(F.count("*").alias("n"))
    return J.grid(t.ev, {"entity": None, "line": [1, 2, 3, 8]}, n, {"n": 0})


@query("rng1_interval_join", """WITH o AS (SELECT o_orderkey, 1704067200 + CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS BIGINT) * 1078 + o_orderkey % 1078 AS placed FROM orders),
p AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS opens, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 10) AS BIGINT) AS closes FROM events WHERE event_type = 'purchase')
SELECT o_orderkey, event_id, least(placed + 600, closes) - greatest(placed, opens) AS shared FROM o JOIN p ON placed <= closes AND opens <= placed + 600""")
def rng1(t):
    placed = F.lit(1704067200) + F.date_diff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("long") * 1078 + F.col("o_orderkey") % 1078
    orders = t.orders.select("o_orderkey", placed.alias("placed")).withColumn("kept_until", F.col("placed") + 600)
    opens = F.floor(seconds_since_1970(F.col("ts"))).cast("long")
    offers = t.events.where("event_type = 'purchase'").select("event_id", opens.alias("opens"), (opens + F.floor(F.col("value") * 10)).alias("closes"))
    pairs = interval_join(orders, offers, ("placed", "kept_until"), ("opens", "closes"))
    return pairs.select("o_orderkey", "event_id", (F.least("kept_until", "closes") - F.greatest("placed", "opens")).alias("shared"))
