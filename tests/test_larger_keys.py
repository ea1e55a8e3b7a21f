"""Queries whose SQL orders rows by computed places, on keys beyond those of the small tables, and on rows with nulls."""

import datetime

from support import FOLDER, differences, duck

from tallyframe import catalog


def copy_with(spark, tmp_path, name, rows):
    """A folder with the table, extended by rows, and a connection that reads it."""
    table = spark.read.parquet(f"{FOLDER}/{name}.parquet")
    path = f"{tmp_path}/{name}.parquet"
    table.unionByName(spark.createDataFrame(rows, table.schema)).coalesce(1).write.parquet(path)
    con = duck()
    con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return str(tmp_path), con


def same(spark, folder, con, query):
    assert differences(catalog.queries()[query](spark, folder), con, catalog.oracles()[query]) == ([], [])


def test_first_priority_of_orders_without_date_or_priority(spark, tmp_path):
    day = datetime.datetime(2000, 1, 1)
    rows = [(900001, 77777, "O", 1.0, None, "1-URGENT"), (900002, 77777, "O", 2.0, day, None), (900003, 77777, "O", 3.0, day + datetime.timedelta(1), "5-LOW"), (900004, 77778, "O", 4.0, None, "2-HIGH")]
    same(spark, *copy_with(spark, tmp_path, "orders", rows), "agg2_named")


def test_starter_of_parts_above_a_hundred_thousand(spark, tmp_path):
    at = lambda key, part, entity, line, day: (key, part, entity, line, 1.0, 2.0, 0.1, 0.1, "R", "F", datetime.datetime(1996, 1, day))
    rows = [at(900001, 119_999, 5, 1, 1), at(900001, 3, 6, 2, 2), at(900001, 119_999, 5, 1, 3), *[(*at(900001, 1, e, 7, 4)[:10], datetime.datetime(1997, 1, 1)) for e in (5, 6)]]
    same(spark, *copy_with(spark, tmp_path, "lineitem", rows), "eb19_reconstructed_role")


def test_quantiles_of_repeated_values_settle_in_one_round(spark, monkeypatch):
    """Large groups of few values, as copies make them, and of distinct ones: the scans of a round are not repeated."""
    import numpy as np
    from pyspark.sql import functions as F

    from tallyframe.operators import quantiles as Q

    calls, stored = [], Q.stored
    monkeypatch.setattr(Q, "stored", lambda df: calls.append(1) or stored(df))
    df = spark.range(60_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") % 50).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9))).cast("double").alias("v"))
    rows = df.collect()
    qs = [0.1, 0.25, 0.5, 0.9]
    got = {r.k: r.quantiles for r in Q.exact_quantiles(df, ["k"], "v", qs, 3000).collect()}
    for k in (0, 1):
        assert np.allclose(got[k], np.quantile([r.v for r in rows if r.k == k], qs))
    assert len(calls) <= 3  # sizes, first intervals, one round


def plan_of(spark, query):
    return catalog.queries()[query](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_boundary_posterior_names_its_best_hypothesis_once(spark):
    from pyspark.sql import functions as F

    from tallyframe.operators import states as E

    counts = lambda: F.struct(F.lit(3).alias("n"), F.lit(1).alias("s"))
    games = F.struct(F.lit(2.0).alias("mean"), F.lit(1.0).alias("sd"), F.lit(0.5).alias("rate"))
    assert str(E.season_boundary(counts(), counts(), F.array(counts()), games)).lower().count("array_max") == 1


def test_sketches_are_held_against_sums(spark):
    assert "distinct part" not in plan_of(spark, "skt1_before_season")
