"""Exact isotonic fits: distinct predictions by the hundred thousand, ranges that merge, against one pass over all."""

import numpy as np
import pandas as pd
import pytest

from tallyframe.operators import isotonic as I


def brute(p, y):
    """Least squares by the maximum of minima of means."""
    g = pd.DataFrame({"p": p, "y": y}).groupby("p").y.agg(["sum", "count"])
    s, n = np.append(0, g["sum"].cumsum()), np.append(0, g["count"].cumsum())
    k = len(g)
    mean = np.array([[(s[j + 1] - s[i]) / (n[j + 1] - n[i]) if j >= i else np.inf for j in range(k)] for i in range(k)])
    return dict(zip(g.index, [max(mean[i, x:].min() for i in range(x + 1)) for x in range(k)], strict=True))


@pytest.mark.parametrize("trend", [1.0, 0.0, -1.0])
def test_equals_the_minmax_formula(spark, trend):
    rng = np.random.default_rng(int(trend) + 5)
    p = rng.integers(0, 60, 400) / 7
    y = (rng.random(400) < 0.5 + trend * (p - 4) / 10).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y})).repartition(6)
    got = {r["p"]: r["value"] for r in I.isotonic_fit(df, "y", "p").collect()}
    want = brute(p, y)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


@pytest.mark.parametrize("kind", ["noisy", "falling", "rising"])
def test_many_distinct_predictions_over_ranges(spark, kind):
    n = 100_000
    rng = np.random.default_rng(1)
    p = rng.permutation(n) / n
    y = {"noisy": (rng.random(n) < p).astype(float), "falling": 1 - p, "rising": p}[kind]
    want = I.pool([], ((a, a, b, 1.0) for a, b in sorted(zip(p.tolist(), y.tolist(), strict=True))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        got = I.isotonic_blocks(spark.createDataFrame(pd.DataFrame({"p": p, "y": y})), "y", "p").orderBy("low").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r["low"], r["high"], r["n"]) for r in got] == [(a, b, int(m)) for a, b, _, m in want]
    assert np.allclose([r["value"] for r in got], [s / m for *_, s, m in want], rtol=0, atol=1e-12)


def test_missing_and_empty(spark):
    df = spark.createDataFrame([(0.5, 1.0), (None, 1.0), (0.7, None), (float("nan"), 0.0)], "p double, y double")
    assert [tuple(r) for r in I.isotonic_blocks(df, "y", "p").collect()] == [(0.5, 0.5, 1.0, 1)]
    assert [r["p"] for r in I.isotonic_fit(df, "y", "p").orderBy("p").collect()] == [0.5]
    assert I.isotonic_fit(df.where("false"), "y", "p").count() == 0
