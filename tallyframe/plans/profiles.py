"""Queries of entity profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import profiles as P
from ..operators import windows as W
from ..registry import query, r6

FLAGS = ["A", "N", "R"]
CELL = "c AS (SELECT entity, flag, count(qty) AS n, avg(qty) AS m, coalesce(var_samp(qty), 0) AS v FROM ev WHERE status = 'O' GROUP BY ALL)"


def rounded(df, *keep):
    return df.select(*keep, *[r6(c).alias(c) for c in df.columns if c not in keep])


@query("tm1_simple_profile", "WITH {EV}, " + CELL + ", s AS (SELECT entity, sum(n) AS n, sum(n * m) / sum(n) AS mean, sqrt(greatest(sum(n * (v + m * m)) / sum(n) - pow(sum(n * m) / sum(n), 2), 0)) AS sd FROM c GROUP BY entity) SELECT entity, CAST(s.n AS BIGINT) AS n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(avg(CAST(flag = 'A' AS INTEGER)), 6) AS share_A, round(avg(CAST(flag = 'N' AS INTEGER)), 6) AS share_N, round(avg(CAST(flag = 'R' AS INTEGER)), 6) AS share_R FROM s JOIN ev USING (entity) WHERE status = 'O' GROUP BY ALL")
def tm1(t):
    return rounded(P.simple_profile(t.ev.where("status = 'O'"), "entity", "flag", FLAGS, "qty"), "entity", "n")


METRICS = ("qty", "disc", "tax")


@query("tm2_rich_profile", "WITH {EV} SELECT entity, count(*) AS n, " + ", ".join([f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_sd" for m in METRICS] + [f"round(avg(CAST(flag = '{g}' AS INTEGER)), 6) AS share_{g}" for g in FLAGS] + [f"round(avg({m}) FILTER (flag = '{g}'), 6) AS {m}_{g}" for m in METRICS for g in FLAGS]) + " FROM ev GROUP BY entity")
def tm2(t):
    return rounded(P.rich_profile(t.ev, "entity", "flag", FLAGS, METRICS), "entity", "n")


@query("tm3_stability_profile", """WITH {EV}, c AS (SELECT entity, flag, count(qty) AS n, avg(qty) AS m, coalesce(var_samp(qty), 0) AS v FROM ev GROUP BY ALL), s AS (SELECT entity, sum(n) AS n, CASE WHEN sum(n - 1) > 0 THEN sum((n - 1) * v) / sum(n - 1) ELSE 0 END AS w, greatest(sum(n * m * m) / sum(n) - pow(sum(n * m) / sum(n), 2), 0) AS b FROM c GROUP BY entity),
d AS (SELECT entity, qty - avg(qty) OVER x AS a, price - avg(price) OVER x AS b FROM ev WINDOW x AS (PARTITION BY entity, flag)), r AS (SELECT entity, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS r FROM d GROUP BY entity), p AS (SELECT entity, n / sum(n) OVER (PARTITION BY entity) AS p FROM c), h AS (SELECT entity, sum(-p * ln(p)) AS h FROM p GROUP BY entity)
SELECT entity, CAST(n AS BIGINT) AS n, round(w, 4) AS within, round(b, 4) AS between, round(w / (w + b), 6) AS within_share, round(r, 6) AS r, round(h, 6) AS entropy FROM s JOIN r USING (entity) JOIN h USING (entity)""")
def tm3(t):
    out = P.stability_profile(t.ev, "entity", ["flag"], "flag", "qty", "price")
    return out.select("entity", "n", F.round("within", 4).alias("within"), F.round("between", 4).alias("between"), r6("within_share").alias("within_share"), r6("r").alias("r"), r6("entropy").alias("entropy"))


@query("tm4_group_stability", "WITH {EV} SELECT entity, " + ", ".join(f"count(*) FILTER (flag = '{g}') AS n_{g}, round(stddev_samp(qty) FILTER (flag = '{g}'), 6) AS sd_{g}" for g in FLAGS) + " FROM ev GROUP BY entity")
def tm4(t):
    return rounded(P.group_stability(t.ev, "entity", "flag", FLAGS, "qty"), "entity", "n_A", "n_N", "n_R")


@query("tm5_cell_deltas", "WITH {EV}, m AS (SELECT entity, avg(qty) AS m FROM ev GROUP BY entity) SELECT entity, status, count(*) AS n, round((sum(qty) + 40 * any_value(m)) / (count(*) + 40.0), 6) AS smooth, round((sum(qty) + 40 * any_value(m)) / (count(*) + 40.0) - any_value(m), 6) AS delta FROM ev JOIN m USING (entity) GROUP BY ALL")
def tm5(t):
    return rounded(P.cell_deltas(t.ev, "entity", "status", "qty", 40.0), "entity", "status", "n")


@query("tm6_mix_deltas", "WITH {EV}, m AS (SELECT entity, " + ", ".join(f"avg(CAST(flag = '{g}' AS INTEGER)) AS p{g}" for g in FLAGS) + " FROM ev GROUP BY entity) SELECT entity, line, count(*) AS n, " + ", ".join(f"round((count(*) FILTER (flag = '{g}') + 60 * any_value(p{g})) / (count(*) + 60.0) - any_value(p{g}), 6) + 0 AS d_{g}" for g in FLAGS) + " FROM ev JOIN m USING (entity) GROUP BY ALL")
def tm6(t):
    return rounded(P.mix_deltas(t.ev, "entity", "line", "flag", FLAGS, 60.0), "entity", "line", "n").withColumns({f"d_{g}": F.col(f"d_{g}") + 0 for g in FLAGS})


@query("tm7_trend_profile", "WITH {EV}, a AS (SELECT part, avg(qty) AS q, avg(disc) AS d FROM ev WHERE season >= 2000 GROUP BY part), b AS (SELECT part, avg(qty) AS q, avg(disc) AS d FROM ev WHERE season < 1997 GROUP BY part) SELECT coalesce(a.part, b.part) AS part, round(a.q - b.q, 6) AS q, round(a.d - b.d, 6) + 0 AS d FROM a FULL JOIN b ON a.part = b.part")
def tm7(t):
    part = lambda rows: rows.groupBy("part").agg(F.avg("qty").alias("q"), F.avg("disc").alias("d"))
    return rounded(P.trend_profile(part(t.ev.where("season >= 2000")), part(t.ev.where("season < 1997")), "part", ["q", "d"]), "part").withColumn("d", F.col("d") + 0)


@query("tm8_workload", "WITH {EV}, g AS (SELECT entity, season, count(*) AS n FROM ev GROUP BY ALL), f AS (SELECT entity, n FROM g UNION ALL SELECT -1, n FROM g) SELECT entity, count(*) AS games, round(avg(n), 6) AS mean_rows, round(avg(CAST(n >= 80 AS INTEGER)), 6) AS tail_80, round(avg(CAST(n >= 90 AS INTEGER)), 6) AS tail_90 FROM f GROUP BY entity")
def tm8(t):
    return rounded(P.workload_profile(t.ev, "entity", "season", [], [80, 90]), "entity", "games")


@query("tm9_repeatability", "WITH {EV}, c AS (SELECT entity, season, flag, count(qty) AS n, var_samp(qty) AS v FROM ev GROUP BY ALL HAVING count(qty) >= 3) SELECT entity, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n, round(sum((n - 1) * v) / sum(n - 1), 6) AS within FROM c GROUP BY entity")
def tm9(t):
    return rounded(P.repeatability(t.ev, "entity", "season", "flag", "qty"), "entity", "cells", "n")


@query("tm10_band_physics", """WITH {EV}, b AS (SELECT *, CAST(line > 2 AS INTEGER) + CAST(line > 5 AS INTEGER) AS band FROM ev), m AS (SELECT entity, avg(qty) AS m FROM ev GROUP BY entity), g AS (SELECT entity, band FROM m, (SELECT unnest([0, 1, 2]) AS band)), c AS (SELECT entity, band, sum(qty) AS s, count(*) AS n FROM b WHERE season = 1999 GROUP BY ALL)
SELECT entity, band, coalesce(n, 0) AS n, round((coalesce(s, 0) + 30 * m) / (coalesce(n, 0) + 30.0), 6) AS smooth FROM g JOIN m USING (entity) LEFT JOIN c USING (entity, band)""")
def tm10(t):
    rows = t.ev.withColumn("band", P.band(F.col("line"), (2, 5)))
    cells = rows.where("season = 1999").groupBy("entity", "band").agg(F.sum("qty").alias("s"), F.count("*").alias("n"))
    full = J.grid(rows, {"entity": None, "band": [0, 1, 2]}, cells, {"s": 0.0, "n": 0}).join(rows.groupBy("entity").agg(F.avg("qty").alias("m")), "entity")
    return full.select("entity", "band", "n", r6((F.col("s") + 30 * F.col("m")) / (F.col("n") + 30.0)).alias("smooth"))


@query("tm11_second_entity_profile", "WITH {EV} SELECT part, count(*) AS n, round(avg(y), 6) AS rate, round(avg(qty), 6) AS mean, round(stddev_samp(qty), 6) AS sd, round(avg(y) FILTER (status = 'O'), 6) AS rate_o, round(avg(y) FILTER (status = 'F'), 6) AS rate_f, round((count(*) FILTER (line = 1) + 5) / (count(*) + 25.0), 6) AS first_share FROM ev GROUP BY part")
def tm11(t):
    in_status = lambda s: F.avg(F.when(F.col("status") == s, F.col("y")))
    out = t.ev.groupBy("part").agg(F.count("*").alias("n"), F.avg("y").alias("rate"), F.avg("qty").alias("mean"), F.stddev_samp("qty").alias("sd"), in_status("O").alias("rate_o"), in_status("F").alias("rate_f"), F.count_if(F.col("line") == 1).alias("first"))
    return rounded(out.withColumn("first_share", (F.col("first") + 5) / (F.col("n") + 25.0)).drop("first"), "part", "n")


@query("tm12_expanded_mapping", """WITH {EV}, k AS (SELECT part, entity % 10 AS code, count(*) AS n FROM ev WHERE season < 1998 GROUP BY ALL), m AS (SELECT part, code FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, code) AS r, n / sum(n) OVER (PARTITION BY part) AS purity FROM k) WHERE r = 1 AND purity >= 0.3)
SELECT season, count(*) AS mapped FROM ev JOIN m USING (part) WHERE season >= 1998 GROUP BY season""")
def tm12(t):
    known = t.ev.where("season < 1998").select("part", (F.col("entity") % 10).alias("code"))
    table = J.identity_map(known, "part", "code", 0.3, injective=False)
    return t.ev.where("season >= 1998").join(table.select("part", "code"), "part").groupBy("season").agg(F.count("*").alias("mapped"))


@query("tm13_archetypes")
def tm13(t):
    table = P.rich_profile(t.ev, "entity", "flag", FLAGS, METRICS)
    columns = [c for c in table.columns if c not in ("entity", "n")]
    return P.archetypes(table, "entity", columns, 4, 5).select("entity", "archetype", F.round("distance", 6).alias("distance"), F.round("margin", 6).alias("margin"))


@query("tm14_recent_workload", """WITH g AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice AS v FROM orders), r AS (SELECT o_custkey, o_orderkey, v, CASE WHEN count(v) OVER w = 3 THEN sum(v) OVER w END AS last3, (sum(v) OVER p - v) / (count(*) OVER p - 1) AS others FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY o_custkey))
SELECT o_custkey, round(quantile_cont(last3, 0.5), 4) AS median3, round(max(others - v), 7) AS gap FROM r GROUP BY o_custkey HAVING count(*) > 1""")
def tm14(t):
    from pyspark.sql import Window

    p = Window.partitionBy("o_custkey")
    others = (F.sum("o_totalprice").over(p) - F.col("o_totalprice")) / F.when(F.count("*").over(p) > 1, F.count("*").over(p) - 1)
    r = t.orders.select("o_custkey", "o_totalprice", W.rolling_sum(F.col("o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).alias("last3"), others.alias("others"))
    out = r.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.median("last3"), 4).alias("median3"), F.round(F.max(F.col("others") - F.col("o_totalprice")), 7).alias("gap"))
    return out.where("n > 1").drop("n")


@query("tm15_teacher_fallbacks", """WITH {EV}, m AS (SELECT avg(disc) AS m FROM ev WHERE season < 1999), s AS (SELECT entity, line, flag, disc - m AS x FROM ev, m WHERE season < 1999), a AS (SELECT entity, line, sum(x) / (count(*) + 20.0) AS a FROM s GROUP BY ALL HAVING count(*) >= 30), b AS (SELECT entity, sum(x) / (count(*) + 50.0) AS b FROM s GROUP BY entity)
SELECT basket, part, e.line, e.entity, round(coalesce(a, b, 0), 7) + 0 AS signal FROM ev e LEFT JOIN a ON a.entity = e.entity AND a.line = e.line LEFT JOIN b ON b.entity = e.entity WHERE season = 1999""")
def tm15(t):
    past = t.ev.where("season < 1999")
    s = past.crossJoin(F.broadcast(past.agg(F.avg("disc").alias("m")))).withColumn("x", F.col("disc") - F.col("m"))
    a = s.groupBy("entity", "line").agg((F.sum("x") / (F.count("*") + 20.0)).alias("v"), F.count("*").alias("n")).where("n >= 30")
    b = s.groupBy("entity").agg((F.sum("x") / (F.count("*") + 50.0)).alias("v"))
    out = J.fallback_lookup(t.ev.where("season = 1999"), [(a, ["entity", "line"]), (b, ["entity"])], "v", "signal", 0.0)
    return out.select("basket", "part", "line", "entity", (F.round("signal", 7) + 0).alias("signal"))


@query("tm16_adjusted_command", """WITH {EV}, e AS (SELECT flag, line, (sum(y) + 10 * (SELECT avg(y) FROM ev WHERE season < 1997)) / (count(*) + 10.0) AS x FROM ev WHERE season < 1997 GROUP BY ALL), r AS (SELECT entity, season, y - coalesce(x, 0.3) AS r FROM ev LEFT JOIN e USING (flag, line) WHERE season IN (1998, 1999)), c AS (SELECT *, r - avg(r) OVER (PARTITION BY season) AS d FROM r),
s AS (SELECT entity, season, sum(d) / (count(*) + 80.0) AS v, count(*) AS n FROM c GROUP BY ALL) SELECT round(corr(a.v, b.v), 6) AS persistence, count(*) AS n FROM s a JOIN s b ON a.entity = b.entity AND a.season = 1998 AND b.season = 1999 AND a.n >= 50 AND b.n >= 50""")
def tm16(t):
    rows = P.impute_from_cells(t.ev, F.col("season") < 1997, ["flag", "line"], "y", 10.0, "x").where("season in (1998, 1999)").withColumn("r", F.col("y") - F.col("x"))
    means = rows.groupBy("season").agg(F.avg("r").alias("m"))
    s = rows.join(F.broadcast(means), "season").groupBy("entity", "season").agg((F.sum(F.col("r") - F.col("m")) / (F.count("*") + 80.0)).alias("v"), F.count("*").alias("n")).where("n >= 50")
    a, b = s.where("season = 1998").select("entity", F.col("v").alias("a")), s.where("season = 1999").select("entity", F.col("v").alias("b"))
    return a.join(b, "entity").agg(r6(F.corr("a", "b")).alias("persistence"), F.count("*").alias("n"))


@query("tm17_imputed_deltas", "WITH {EV}, m AS (SELECT avg(qty) AS m FROM ev WHERE season < 1999), c AS (SELECT entity, line, sum(qty) AS s, count(*) AS n FROM ev WHERE season < 1999 GROUP BY ALL), f AS (SELECT entity, avg(qty) AS f FROM ev WHERE season < 1998 GROUP BY entity HAVING count(*) >= 100) SELECT basket, part, e.line, e.entity, round((coalesce(s, 0) + 15 * m) / (coalesce(n, 0) + 15.0) - f, 6) AS delta FROM ev e LEFT JOIN c ON c.entity = e.entity AND c.line = e.line LEFT JOIN f ON f.entity = e.entity, m WHERE season = 1999")
def tm17(t):
    rows = P.impute_from_cells(t.ev, F.col("season") < 1999, ["entity", "line"], "qty", 15.0, "x").where("season = 1999")
    frozen = t.ev.where("season < 1998").groupBy("entity").agg(F.avg("qty").alias("f"), F.count("*").alias("k")).where("k >= 100").drop("k")
    return rows.join(frozen, "entity", "left").select("basket", "part", "line", "entity", r6(F.col("x") - F.col("f")).alias("delta"))
