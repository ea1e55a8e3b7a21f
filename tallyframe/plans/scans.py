"""Queries of sources, sinks and extensions: round trips through each format, cube, rollup and as-of joins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query, r6
from ..sources import tables as T


def scratch(t) -> str:
    """A new path in the folder that the cluster shares."""
    return os.path.join(t.spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir(), f"scan-{uuid.uuid4().hex}")


@query("src1_typed_csv", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def src1(t):
    T.write_csv(t.customer.withColumnRenamed("c_custkey", "﻿c_custkey"), path := scratch(t))
    return T.scan_csv(t.spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double", ["c_custkey", "c_nationkey", "c_acctbal"])


@query("src2_inferred_csv", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation")
def src2(t):
    T.write_csv(t.nation, path := scratch(t))
    return T.scan_csv_inferred(t.spark, path).select("n_nationkey", "n_name")


@query("src3_one_pass_profile", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty, round(min(l_discount), 6) AS lo, round(max(l_discount), 6) AS hi, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem")
def src3(t):
    return t.lineitem.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), r6(F.min("l_discount")).alias("lo"), r6(F.max("l_discount")).alias("hi"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query("src4_filtered_scan", "WITH {EV} SELECT season, count(*) AS n FROM ev WHERE season IN (1996, 1998) GROUP BY season")
def src4(t):
    return t.ev.where("season in (1996, 1998)").groupBy("season").agg(F.count("*").alias("n"))


@query("src5_prefix_scan", "WITH {EV} SELECT max(season) AS last, count(*) AS n FROM ev WHERE season <= 1997")
def src5(t):
    return T.prefix(t.ev, "season", 1997, ["season"]).agg(F.max("season").alias("last"), F.count("*").alias("n"))


@query("src6_prediction_artifact", "SELECT event_id AS row_index, CAST(event_type = 'purchase' AS INTEGER) AS y, round(value / 200, 6) AS p FROM events")
def src6(t):
    rows = t.events.select(F.col("event_id").alias("row_index"), (F.col("event_type") == "purchase").cast("int").alias("y"), r6(F.col("value") / 200).alias("p"))
    path = scratch(t)
    T.write_artifact(rows, path, "base", 1)
    T.write_artifact(rows.withColumn("p", F.lit(0.5)), path, "base", 2)
    return T.scan_artifact(t.spark, path, "base", 1).select("row_index", "y", "p")


@query("src7_markdown_table", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def src7(t):
    lines = t.nation.select(F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit(" |")).alias("value"))
    head = t.spark.createDataFrame([("# Nations",), ("| name | region |",), ("|---|---|",)], "value string")
    head.unionByName(lines).write.text(path := scratch(t))
    return T.scan_markdown(t.spark, path, ["name", "region"])


@query("snk1_csv_sink", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def snk1(t):
    T.write_csv(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path := scratch(t))
    return T.scan_csv(t.spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("snk2_columnar_artifact", "SELECT 'base' AS stage, CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n FROM orders GROUP BY 2")
def snk2(t):
    rows = t.orders.select(F.lit("base").alias("stage"), F.year("o_orderdate").alias("season"), "o_orderkey")
    rows.repartition("season").write.partitionBy("stage", "season").parquet(path := scratch(t))
    return t.spark.read.parquet(path).groupBy("stage", "season").agg(F.count("*").alias("n"))


@query("snk3_json_report", """SELECT '{"k":' || c_nationkey || ',"n":' || count(*) || ',"x":null}' AS json FROM customer GROUP BY c_nationkey""")
def snk3(t):
    rows = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")).withColumn("x", F.lit(float("nan")))
    return T.json_report(rows)


@query("snk4_write_once", "SELECT r_regionkey, r_name FROM region")
def snk4(t):
    T.write_once(t.region.select("r_regionkey", "r_name"), path := scratch(t))
    return t.spark.read.parquet(path)


@query("ext_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("ext_rollup", "WITH {EV} SELECT season, status, count(*) AS n FROM ev GROUP BY ROLLUP (season, status)")
def rollup(t):
    return t.ev.rollup("season", "status").agg(F.count("*").alias("n"))


@query("ext_asof_join", "WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'purchase'), j AS (SELECT v.event_id, max(p.ts) AS at FROM v JOIN p ON p.user_id = v.user_id AND p.ts <= v.ts GROUP BY v.event_id) SELECT v.event_id, round(p.value, 6) AS last_value FROM v LEFT JOIN j USING (event_id) LEFT JOIN p ON p.user_id = v.user_id AND p.ts = j.at")
def asof(t):
    # One sort by user and time carries the last purchase forward; no range join.
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w)
    return t.events.withColumn("last_value", r6(last)).where("event_type <> 'purchase'").select("event_id", "last_value")


@query("ext_unpivot", "SELECT l_orderkey, l_linenumber, l_partkey, unnest(['disc', 'tax']) AS name, unnest([l_discount, l_tax]) AS v FROM lineitem")
def unpivot(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"))
    return rows.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["disc", "tax"], "name", "v")
