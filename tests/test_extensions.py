"""Decayed windows against brute force over many ranges, error bounds of sketches, paths of odd JSON."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import decay as D
from tallyframe.operators import semistructured as V
from tallyframe.operators import sketches as K


@pytest.mark.parametrize("ranges", [1, 13])
def test_decayed_sums_equal_brute_force(spark, ranges):
    rnd = random.Random(ranges)
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 5}", float(rnd.randrange(500)), i, rnd.choice([None, float("nan"), 1.0, -2.5, 4.0])) for i in range(300)]
    rows += [("hot", None, 900, 1.0), ("once", 3.0, 901, 1.0)]
    df = spark.createDataFrame(rows, "k string, t double, id long, x double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = {r["id"]: (r["weight"], r["total"]) for r in D.decayed_before(df, ["k"], "t", ["id"], "x", 40.0).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    known = [r for r in rows if r[1] is not None]
    assert got.keys() == {r[2] for r in known}
    for k, t, i, _ in known:
        past = [(0.5 ** ((t - s) / 40.0), x) for q, s, j, x in known if q == k and (s, j) < (t, i) and x is not None and x == x]
        assert got[i] == (pytest.approx(sum(w for w, _ in past), abs=1e-9), pytest.approx(sum(w * x for w, x in past), abs=1e-9))
    assert D.decayed_before(df.where("false"), ["k"], "t", ["id"], "x", 40.0).count() == 0


def test_merged_sketches_keep_their_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("s"), (F.col("id") * 37 % 20_011).alias("c"), F.pow(F.rand(5), 3).alias("v"))
    df = df.unionByName(df.limit(0)).cache()
    states = K.season_sketches(df, ["k"], "s", "c", "v")
    asked = spark.createDataFrame([(k, s) for k in range(4) for s in range(8)], "k long, s long")
    got = K.read_out(K.before_season(states, asked, ["k"], "s"), [0.1, 0.5, 0.9]).collect()
    assert {(r["k"], r["s"]) for r in got} == {(k, s) for k in range(3) for s in range(1, 8)}
    rows = df.toPandas()
    for r in got:
        part = rows[(rows.k == r["k"]) & (rows.s < r["s"])]
        assert r["n"] == len(part)
        assert abs(r["approx_distinct"] - part.c.nunique()) <= K.DISTINCT_ERROR * part.c.nunique() + 1
        for q, x in zip((0.1, 0.5, 0.9), r["quantiles"], strict=True):
            assert (part.v < x).mean() <= q + K.RANK_ERROR and (part.v <= x).mean() >= q - K.RANK_ERROR
    whole = K.read_out(K.merged(states, []), [0.5]).first()
    assert whole["n"] == 60_000 and abs(whole["approx_distinct"] - 20_011) <= K.DISTINCT_ERROR * 20_011
    df.unpersist()


def test_odd_json(spark):
    texts = ['{"a": 1}', '{"a": "x", "b": [1, {"c": null}]}', "[]", "{", "", None, "7", '{"a": {"d": {"e": {"f": 1}}}}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    found = {(r["path"], r["type"]): r["n"] for r in V.discovered_paths(df, "j", 3).collect()}
    assert found[("$", "OBJECT")] == 3 and found[("$", "MALFORMED")] == 2 and found[("$", "ARRAY")] == 1 and found[("$", "BIGINT")] == 1
    assert found[("$.a", "BIGINT")] == found[("$.a", "STRING")] == found[("$.a", "OBJECT")] == 1
    assert found[("$.b[*]", "BIGINT")] == found[("$.b[*]", "OBJECT")] == 1 and found[("$.b[*].c", "VOID")] == 1
    assert ("$.a.d.e", "OBJECT") in found and ("$.a.d.e.f", "BIGINT") not in found
    rows = V.parsed(df, "j", "v").select(V.field("v", "$.a", "bigint").alias("a"), F.col("v").isNull().alias("none")).collect()
    assert [r["a"] for r in rows] == [1, None, None, None, None, None, None, None]
    assert [r["none"] for r in rows] == [False, False, False, True, True, True, False, False]
