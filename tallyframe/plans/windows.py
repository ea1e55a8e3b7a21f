"""Queries of ordered operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..registry import query, r6

TIME = ["ts", "event_id"]
O = ["o_orderdate", "o_orderkey"]  # noqa: E741
ROW = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


@query("win1_sessions", """WITH o AS (SELECT o_orderkey, o_orderdate, o_orderpriority AS k, o_totalprice AS v, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders),
b AS (SELECT *, CASE WHEN lag(season) OVER w IS DISTINCT FROM season OR lag(k) OVER w IS DISTINCT FROM k OR v < lag(v) OVER w THEN 1 ELSE 0 END AS starts FROM o WINDOW w AS (ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, CAST(sum(starts) OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS session FROM b""")
def win1(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("season"))
    return W.sessionise(rows, "season", O, ["o_orderpriority"], ["o_totalprice"]).select("o_orderkey", "session")


@query("win2_running_index", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events")
def win2(t):
    return t.events.select("event_id", W.running_index(["user_id"], TIME).cast("long").alias("i"))


@query("win3_exclusive_sum", "SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS s FROM events")
def win3(t):
    return t.events.select("event_id", r6(W.before(F.col("value"), ["user_id"], TIME)).alias("s"))


@query("win4_recovered_event", """WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER w - 1 AS n, coalesce(sum(CAST(o_orderstatus = 'F' AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, CAST(lead(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - c AS BIGINT) AS y FROM s""")
def win4(t):
    hit = (F.col("o_orderstatus") == "F").cast("int")
    counted = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", W.running_index(["o_custkey"], O).alias("n"), W.before(hit, ["o_custkey"], O).alias("c"))
    return counted.select("o_orderkey", W.recovered_event("n", "c", ["o_custkey"], O).alias("y"))


@query("win5_lag", "WITH {EV}, s AS (SELECT entity, season, count(*) AS n, avg(y) AS m FROM ev GROUP BY entity, season) SELECT entity, season, lag(n) OVER w AS prev_n, round(lag(m) OVER w, 6) AS prev_m FROM s WINDOW w AS (PARTITION BY entity ORDER BY season)")
def win5(t):
    w = Window.partitionBy("entity").orderBy("season")
    s = t.ev.groupBy("entity", "season").agg(F.count("*").alias("n"), F.avg("y").alias("m"))
    return s.select("entity", "season", F.lag("n").over(w).alias("prev_n"), r6(F.lag("m").over(w)).alias("prev_m"))


@query("win6_rolling", "SELECT event_id, CASE WHEN count(value) OVER w = 3 THEN round(sum(value) OVER w, 6) END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def win6(t):
    return t.events.select("event_id", r6(W.rolling_sum(F.col("value"), ["user_id"], TIME, 3)).alias("s"))


@query("win7_group_transform", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 5) AS d, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def win7(t):
    w = Window.partitionBy("user_id")
    return t.events.select("event_id", F.round(F.col("value") - F.avg("value").over(w), 5).alias("d"), F.count("*").over(w).alias("n"))


@query("win8_two_way_ranks", "WITH {EV}, n AS (SELECT entity, part, count(*) AS n FROM ev GROUP BY entity, part) SELECT entity, part, row_number() OVER (PARTITION BY entity ORDER BY n DESC, part) AS a, row_number() OVER (PARTITION BY part ORDER BY n DESC, entity) AS b FROM n")
def win8(t):
    n = t.ev.groupBy("entity", "part").agg(F.count("*").alias("n"))
    return n.select("entity", "part", W.best_rank([F.desc("n"), "part"], "entity").cast("long").alias("a"), W.best_rank([F.desc("n"), "entity"], "part").cast("long").alias("b"))


@query("win9_keep_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def win9(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("win10_group_number", "WITH f AS (SELECT o_custkey, min(o_orderdate * 1) AS x, NULL FROM (SELECT o_custkey, epoch(o_orderdate)::BIGINT * 1000000 + o_orderkey AS o_orderdate FROM orders) GROUP BY o_custkey) SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY x) - 1 AS BIGINT) AS g FROM orders JOIN f USING (o_custkey)")
def win10(t):
    return W.first_seen_number(t.orders, ["o_custkey"], O, "g").select("o_orderkey", "g")


@query("win11_duplicate_flags", "WITH {EV} SELECT basket, line, part, entity, count(*) OVER (PARTITION BY basket, line) > 1 AS twice FROM ev")
def win11(t):
    return t.ev.select("basket", "line", "part", "entity", (F.count("*").over(Window.partitionBy("basket", "line")) > 1).alias("twice"))


@query("win12_boundaries", "SELECT CAST(year(o_orderdate) AS INTEGER) AS season, arg_min(o_orderkey, epoch(o_orderdate) * 1e6 + o_orderkey) AS first, arg_max(o_orderkey, epoch(o_orderdate) * 1e6 + o_orderkey) AS last, count(*) AS n FROM orders GROUP BY 1")
def win12(t):
    return W.boundaries(t.orders.withColumn("season", F.year("o_orderdate")), "season", O, "o_orderkey")


@query("win13_difference", "WITH {EV}, s AS (SELECT season, avg(y) AS m FROM ev GROUP BY season) SELECT season, round(m - lag(m) OVER (ORDER BY season), 6) AS d FROM s")
def win13(t):
    s = t.ev.groupBy("season").agg(F.avg("y").alias("m"))
    return s.select("season", r6(F.col("m") - F.lag("m").over(Window.orderBy("season"))).alias("d"))
