"""Queries of evaluation operators, and the flagship query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import evaluation as V
from ..operators import states as E
from ..operators.isotonic import isotonic_fit
from ..registry import query, r6

#: Predictions of y: the part's rate before the season, the line's, and a constant.
SCORED = """{EV}, p0 AS (SELECT d.season, coalesce(avg(e.y), 0.5) AS prior FROM (SELECT DISTINCT season FROM ev) d LEFT JOIN ev e ON e.season < d.season GROUP BY d.season),
h AS (SELECT d.entity, d.season, (coalesce(sum(e.y), 0) + 50 * any_value(prior)) / (count(e.y) + 50.0) AS p FROM (SELECT DISTINCT entity, season FROM ev) d JOIN p0 USING (season) LEFT JOIN ev e ON e.entity = d.entity AND e.season < d.season GROUP BY ALL),
sc AS (SELECT ev.*, p, prior AS q, 0.1 + 0.05 * line + 0.2 * disc * 5 AS z FROM ev JOIN h USING (entity, season) JOIN p0 USING (season))"""


def scored(t):
    rows = E.history_rates(t.ev, ["entity"], "season", "y", 50.0)
    return rows.withColumns({"p": F.col("h_rate"), "q": F.col("h_rate") - F.col("h_delta"), "z": 0.1 + 0.05 * F.col("line") + 0.2 * F.col("disc") * 5})


SKILL = "count(*) AS n, round(avg(y), 6) AS rate, round(avg((p - y) * (p - y)), 6) AS brier, round(greatest(0, 1e5 * (1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))))), 3) AS score, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss"


def shown(df):
    return df.withColumns({"rate": r6("rate"), "brier": r6("brier"), "log_loss": r6("log_loss"), "score": F.round("score", 3)})


@query("ev1_yearly_skill", "WITH " + SCORED + f" SELECT season, {SKILL} FROM sc GROUP BY season")
def yearly_skill(t):
    return shown(V.skill(scored(t), "y", "p", ["season"]))


@query("ev2_log_loss", "WITH " + SCORED + " SELECT status, round(-avg(ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-7))), 6) AS log_loss FROM sc GROUP BY status")
def ev2(t):
    p = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return V.multiclass_log_loss(scored(t), p, ["status"]).withColumn("log_loss", r6("log_loss"))


@query("ev3_auc", "WITH {EV}, k AS (SELECT season, y, qty, rank() OVER (PARTITION BY season ORDER BY qty) + (count(*) OVER (PARTITION BY season, qty) - 1) / 2 AS r FROM ev) SELECT season, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM k GROUP BY season")
def ev3(t):
    return V.auc(t.ev, "y", "qty", ["season"]).withColumn("auc", r6("auc"))


@query("ev4_segments", "WITH " + SCORED + ", m AS (SELECT 'open' AS segment, * FROM sc WHERE status = 'O' UNION ALL SELECT 'first', * FROM sc WHERE line = 1 UNION ALL SELECT 'large', * FROM sc WHERE qty >= 25) SELECT segment, " + SKILL + " FROM m GROUP BY segment")
def ev4(t):
    masks = {"open": F.col("status") == "O", "first": F.col("line") == 1, "large": F.col("qty") >= 25}
    return shown(V.segments(scored(t), masks, "y", "p"))


@query("ev5_paired_delta", "WITH " + SCORED + " SELECT basket, part, line, entity, round((p - y) * (p - y) - (q - y) * (q - y), 6) + 0 AS delta FROM sc")
def ev5(t):
    y = F.col("y")
    return scored(t).select("basket", "part", "line", "entity", (r6(V.squared(F.col("p"), y) - V.squared(F.col("q"), y)) + 0).alias("delta"))


@query("ev6_cluster_bootstrap")
def ev6(t):
    ci = V.cluster_bootstrap(scored(t).where("season >= 1998"), "entity", "y", "q", "p", 500)
    return t.spark.createDataFrame([(ci["delta"], ci["low"], ci["high"], ci["se"], ci["significant"])], "delta double, low double, high double, se double, significant boolean")


@query("ev7_adoption_gate")
def ev7(t):
    rows = scored(t)
    ci = [V.cluster_bootstrap(rows.where(F.col("season") == s), "entity", "y", "q", "p", 200) for s in (1998, 1999)]
    return t.spark.createDataFrame([(V.gate(*ci),)], "adopt boolean")


@query("ev8_blend", "WITH " + SCORED + " SELECT season, round(avg(0.5 * p + 0.3 * q + 0.2 * z), 6) AS mean, round(avg(pow(0.5 * p + 0.3 * q + 0.2 * z - y, 2)), 6) AS brier FROM sc GROUP BY season")
def ev8(t):
    blend = 0.5 * F.col("p") + 0.3 * F.col("q") + 0.2 * F.col("z")
    return scored(t).groupBy("season").agg(r6(F.avg(blend)).alias("mean"), r6(F.avg(V.squared(blend, F.col("y")))).alias("brier"))


@query("ev9_simplex_grid", "WITH " + SCORED + ", w AS (SELECT i / 10 AS a, j / 10 AS b, (10 - i - j) / 10 AS c FROM range(11) x(i), range(11) z(j) WHERE i + j <= 10) SELECT round(a, 6) AS w_p, round(b, 6) AS w_q, round(c, 6) AS w_z, round(avg(pow(a * p + b * q + c * z - y, 2)), 6) AS mse FROM sc, w GROUP BY a, b, c")
def ev9(t):
    gram = A.gram(scored(t), ["p", "q", "z", "y"])
    return V.grid_search(gram, ["p", "q", "z"], "y", 10).select(r6("w_p").alias("w_p"), r6("w_q").alias("w_q"), r6("w_z").alias("w_z"), r6("mse").alias("mse"))


@query("ev10_two_model_weight", "WITH " + SCORED + " SELECT round(least(greatest(sum((y - q) * (z - q)) / sum((z - q) * (z - q)), 0), 1), 6) AS w FROM sc")
def ev10(t):
    return V.two_model_weight(scored(t), "y", "q", "z").withColumn("w", r6("w"))


@query("ev11_affine_calibrator", "WITH " + SCORED + ", s AS (SELECT least(greatest(regr_slope(y, z), 0), 3) AS b, avg(y) AS y, avg(z) AS z FROM sc) SELECT round(y - b * z, 6) AS intercept, round(b, 6) AS slope FROM s")
def ev11(t):
    return V.affine_calibrator(scored(t), "y", "z").select(r6("intercept").alias("intercept"), r6("slope").alias("slope"))


@query("ev11_intercept_and_isotonic")
def ev11b(t):
    rows = scored(t)
    shift = V.intercept_calibrator(rows, "y", "z")
    return isotonic_fit(rows, "y", "z").withColumn("shift", F.lit(float(shift)))


@query("ev11_isotonic", "WITH " + SCORED + """, r AS (SELECT y, round(z, 6) AS z FROM sc), d AS (SELECT z, sum(y) AS s, count(*) AS n, row_number() OVER (ORDER BY z) AS k FROM r GROUP BY z),
c AS (SELECT k, z, sum(s) OVER (ORDER BY k) AS cs, sum(n) OVER (ORDER BY k) AS cn, s, n FROM d),
m AS (SELECT i.k AS i, j.k AS j, (j.cs - i.cs + i.s) / (j.cn - i.cn + i.n) AS mean FROM c i JOIN c j ON i.k <= j.k),
low AS (SELECT a.k, m.i, min(m.mean) AS least FROM d a JOIN m ON m.i <= a.k AND m.j >= a.k GROUP BY a.k, m.i)
SELECT z AS p, round(max(least), 6) AS value FROM low JOIN d USING (k) GROUP BY z""")
def ev11c(t):
    rows = scored(t).withColumn("z", r6("z"))  # sums of decimals differ between engines
    return isotonic_fit(rows, "y", "z").withColumn("value", r6("value"))


@query("ev12_analytic_gain", "WITH " + SCORED + " SELECT round(1e5 * (2 * 0.5 * avg((y - q) * (p - q)) - 0.25 * avg((p - q) * (p - q))) / (avg(y) * (1 - avg(y))), 4) AS gain FROM sc")
def ev12(t):
    rows = scored(t).withColumn("c", F.col("p") - F.col("q"))
    return V.analytic_gain(rows, "y", "q", "c", 0.5).withColumn("gain", F.round("gain", 4))


@query("ev13_coordinate_search")
def ev13(t):
    rows = scored(t).withColumns({"r": F.col("y") - F.col("q"), "c1": F.col("p") - F.col("q"), "c2": F.col("z") - F.col("q")})
    grams = A.gram(rows.where("season >= 1997"), ["c1", "c2", "r"], ["season"]).orderBy("season").collect()
    lin = np.array([[2 * g["g_c1_r"], 2 * g["g_c2_r"]] for g in grams])
    quad = np.array([[[g["g_c1_c1"], g["g_c1_c2"]], [g["g_c1_c2"], g["g_c2_c2"]]] for g in grams])
    w, least = V.coordinate_search(lin, quad, [i / 10 for i in range(11)])
    return t.spark.createDataFrame([(float(w[0]), float(w[1]), least)], "w1 double, w2 double, least double")


@query("ev14_ridge", "WITH " + SCORED + """, g AS (SELECT 1 + 1e-3 AS a, avg(p) AS b, avg(z) AS c, avg(p * p) + 1e-3 AS d, avg(p * z) AS e, avg(z * z) + 1e-3 AS f, avg(y) AS u, avg(p * y) AS v, avg(z * y) AS w FROM sc),
x AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM g)
SELECT 'one' AS name, round((u * (d * f - e * e) - b * (v * f - w * e) + c * (v * e - w * d)) / det, 6) AS weight FROM x
UNION ALL SELECT 'p', round((a * (v * f - e * w) - u * (b * f - c * e) + c * (b * w - c * v)) / det, 6) FROM x
UNION ALL SELECT 'z', round((a * (d * w - e * v) - b * (b * w - c * v) + u * (b * e - c * d)) / det, 6) FROM x""")
def ev14(t):
    g = A.gram(scored(t).withColumn("one", F.lit(1.0)), ["one", "p", "z", "y"]).first().asDict()
    w = V.ridge(g, ["one", "p", "z"], "y", 1e-3)
    return t.spark.createDataFrame([(k, round(float(v), 6)) for k, v in w.items()], "name string, weight double")


@query("ev15_asof_baseline_grid", "WITH " + SCORED + ", g AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS a), s AS (SELECT season, a, avg(pow(a * p + (1 - a) * q - y, 2)) AS brier FROM sc, g GROUP BY season, a) SELECT season, a AS alpha, round(brier, 6) AS brier FROM s")
def ev15(t):
    grid = t.spark.createDataFrame([(a,) for a in (0.0, 0.25, 0.5, 0.75, 1.0)], "alpha double")
    gram = A.gram(scored(t), ["p", "q", "y"], ["season"])
    a, b = F.col("alpha"), 1 - F.col("alpha")
    mse = a * a * F.col("g_p_p") + 2 * a * b * F.col("g_p_q") + b * b * F.col("g_q_q") - 2 * a * F.col("g_p_y") - 2 * b * F.col("g_q_y") + F.col("g_y_y")
    return gram.crossJoin(F.broadcast(grid)).select("season", "alpha", r6(mse).alias("brier"))


@query("ev16_split_half_ceiling", "WITH {EV}, s AS (SELECT *, CAST(('0x' || substr(md5(CAST(basket AS VARCHAR)), 1, 8))::BIGINT % 2 AS INTEGER) AS half FROM ev), m AS (SELECT avg(y) AS m FROM s WHERE half = 0), r AS (SELECT entity, line, sum(y) AS s, count(*) AS n FROM s WHERE half = 0 GROUP BY ALL), x AS (SELECT y, (coalesce(r.s, 0) + 60 * m) / (coalesce(n, 0) + 60.0) AS p FROM s LEFT JOIN r ON r.entity = s.entity AND r.line = s.line, m WHERE half = 1) SELECT " + SKILL + " FROM x")
def ev16(t):
    return shown(V.split_half_ceiling(t.ev, S.md5_fold(F.col("basket"), 2), ["entity", "line"], "y", 60.0))


@query("ev17_row_invariance", "WITH {EV}, s AS (SELECT DISTINCT entity, line, season FROM ev) SELECT count(*) AS n, 0.0::DOUBLE AS gap FROM s")
def ev17(t):
    """Largest difference of the states of the same rows in another order, and over how many states."""
    state = E.platoon(t.ev, "entity", "line", "season", "y", 200.0, 200.0)
    shuffled = E.platoon(t.ev.repartition(5, "part").select(*reversed(t.ev.columns)), "entity", "line", "season", "y", 200.0, 200.0)
    gap = V.invariance_gap(state, shuffled, ["entity", "line", "season"], ["base", "residual"])
    return gap.select("n", F.round("gap", 9).alias("gap"))


@query("ev18_convex_weights", "WITH " + SCORED + """, g AS (SELECT avg(p * p) AS pp, avg(q * q) AS qq, avg(z * z) AS zz, avg(p * q) AS pq, avg(p * z) AS pz, avg(q * z) AS qz, avg(p * y) AS py, avg(q * y) AS qy, avg(z * y) AS zy FROM sc),
k AS (SELECT *, pp - 2 * pz + zz AS a, pq - pz - qz + zz AS b, qq - 2 * qz + zz AS c, py - zy - pz + zz AS u, qy - zy - qz + zz AS v FROM g),
w AS (SELECT 1.0 AS wp, 0.0 AS wq, 0.0 AS wz UNION ALL SELECT 0.0, 1.0, 0.0 UNION ALL SELECT 0.0, 0.0, 1.0
  UNION ALL SELECT (py - qy - pq + qq) / (pp - 2 * pq + qq), 1 - (py - qy - pq + qq) / (pp - 2 * pq + qq), 0 FROM k
  UNION ALL SELECT u / a, 0, 1 - u / a FROM k UNION ALL SELECT 0, v / c, 1 - v / c FROM k
  UNION ALL SELECT (u * c - b * v) / (a * c - b * b), (a * v - b * u) / (a * c - b * b), 1 - (u * c - b * v) / (a * c - b * b) - (a * v - b * u) / (a * c - b * b) FROM k),
best AS (SELECT wp, wq, wz FROM w, g WHERE wp >= 0 AND wq >= 0 AND wz >= 0 ORDER BY wp * wp * pp + wq * wq * qq + wz * wz * zz + 2 * (wp * wq * pq + wp * wz * pz + wq * wz * qz) - 2 * (wp * py + wq * qy + wz * zy) LIMIT 1)
SELECT 'p' AS name, round(wp, 6) AS weight FROM best UNION ALL SELECT 'q', round(wq, 6) FROM best UNION ALL SELECT 'z', round(wz, 6) FROM best""")
def ev18(t):
    g = A.gram(scored(t), ["p", "q", "z", "y"]).first().asDict()
    return t.spark.createDataFrame([(k, round(float(v), 6)) for k, v in V.convex_weights(g, ["p", "q", "z"], "y").items()], "name string, weight double")


@query("ev19_artifact_screen", "WITH " + SCORED + " SELECT unnest(['p', 'y', 'qty']) AS name, unnest([bool_and(coalesce(p BETWEEN 0 AND 1, false)) AND NOT bool_and(p = y), bool_and(coalesce(y BETWEEN 0 AND 1, false)) AND NOT bool_and(y = y), bool_and(coalesce(qty BETWEEN 0 AND 1, false)) AND NOT bool_and(qty = y)]) AS usable FROM sc")
def ev19(t):
    return V.artifact_screen(scored(t), "y", ["p", "y", "qty"])


@query("ev20_group_folds", "WITH {EV}, f AS (SELECT entity, CAST(('0x' || substr(md5(CAST(entity AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM ev) SELECT fold, count(*) AS n, count(DISTINCT entity) AS entities FROM f GROUP BY fold")
def ev20(t):
    return t.ev.groupBy(S.md5_fold(F.col("entity"), 5).alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))


@query("ud6_cross_fitted_encoding", "WITH {EV}, f AS (SELECT *, CAST(('0x' || substr(md5(CAST(basket AS VARCHAR)), 1, 8))::BIGINT % 3 AS INTEGER) AS fold FROM ev) SELECT basket, part, line, entity, round((sum(y) OVER (PARTITION BY part) - sum(y) OVER (PARTITION BY part, fold) + 10 * 0.3) / (count(*) OVER (PARTITION BY part) - count(*) OVER (PARTITION BY part, fold) + 10.0), 6) AS enc FROM f")
def ud6(t):
    rows = t.ev.withColumn("fold", S.md5_fold(F.col("basket"), 3))
    own = rows.groupBy("part", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    whole = own.groupBy("part").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    out = rows.join(own.join(whole, "part"), ["part", "fold"])
    return out.select("basket", "part", "line", "entity", r6(S.shrink(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"), 10.0, F.lit(0.3))).alias("enc"))


@query("ud7_effective_rows", "WITH {EV}, w AS (SELECT status, pow(0.8, 1999 - season) * CASE WHEN status = 'F' THEN 0.5 ELSE 1 END AS w FROM ev WHERE season < 2000) SELECT status, round(pow(sum(w), 2) / sum(w * w), 4) AS effective FROM w GROUP BY status")
def ud7(t):
    w = F.pow(F.lit(0.8), 1999 - F.col("season")) * F.when(F.col("status") == "F", 0.5).otherwise(1.0)
    return t.ev.where("season < 2000").withColumn("w", w).groupBy("status").agg(F.round(F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w")), 4).alias("effective"))
