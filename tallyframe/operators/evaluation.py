"""Scores, calibration, weights and gates. Sums are taken by Spark; only k x k sums reach the driver."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import logit
from .stored import stored


def squared(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def skill(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, rate, brier, reference r(1 - r), score = max(0, 1e5 (1 - brier / reference)) and log loss, by keys."""
    yy, pp = F.col(y), F.col(p)
    q = F.least(F.greatest(pp, F.lit(1e-7)), F.lit(1 - 1e-7))
    sums = (df.groupBy(*keys) if keys else df).agg(
        F.count("*").alias("n"), F.avg(yy).alias("rate"), F.avg(squared(pp, yy)).alias("brier"), (-F.avg(yy * F.ln(q) + (1 - yy) * F.ln(1 - q))).alias("log_loss")
    )
    ref = F.col("rate") * (1 - F.col("rate"))
    score = F.when(ref > 0, F.greatest(F.lit(0.0), 1e5 * (1 - F.col("brier") / F.when(ref > 0, ref))))
    return sums.withColumn("score", score)


def multiclass_log_loss(df: DataFrame, p_true: Column, keys: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*keys) if keys else df).agg((-F.avg(F.ln(F.greatest(p_true, F.lit(1e-7))))).alias("log_loss"))


def auc(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by the rank sum with averaged ties; null for one class.

    Rows are counted by distinct score first, so the ordered window holds scores, not rows.
    """
    counts = df.groupBy(*keys, p).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    below = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = (ranked.groupBy(*keys) if keys else ranked).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("np"), F.sum("n").alias("all"))
    neg = F.col("all") - F.col("np")
    return sums.select(*keys, F.when((F.col("np") > 0) & (neg > 0), (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * neg)).alias("auc"))


def segments(df: DataFrame, masks: dict[str, Column], y: str, p: str) -> DataFrame:
    """skill() for each named mask, in one pass; a row may lie in several."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(m, F.lit(False)), F.lit(n)) for n, m in masks.items()]))
    return skill(df.select(F.explode(names).alias("segment"), y, p), y, p, ["segment"])


def cluster_bootstrap(df: DataFrame, cluster: str, y: str, base: str, candidate: str, replicates: int = 2000, seed: int = 7) -> dict[str, float]:
    """Mean change of the squared error and its 95 % interval by resampling clusters.

    Spark sums by cluster; resampling works on these sums. Weights are Poisson, drawn in the tasks from seed and cluster,
    so no cluster leaves its task.
    """
    delta = squared(F.col(candidate), F.col(y)) - squared(F.col(base), F.col(y))
    sums = df.groupBy(cluster).agg(F.sum(delta).alias("d"), F.count("*").alias("n")).withColumn("h", F.xxhash64(F.col(cluster), F.lit(seed)))

    def replicate(batches):
        import pandas as pd

        total = np.zeros((replicates + 1, 2))
        for pdf in batches:
            for d, n, h in zip(pdf["d"], pdf["n"], pdf["h"], strict=True):
                w = np.append(1, np.random.default_rng(int(h) & (2**63 - 1)).poisson(1.0, replicates))
                total += w[:, None] * np.array([d, n], dtype=float)
        yield pd.DataFrame({"r": np.arange(replicates + 1), "d": total[:, 0], "n": total[:, 1]})

    got = sums.select("d", "n", "h").mapInPandas(replicate, "r int, d double, n double").groupBy("r").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    rows = {r["r"]: r["d"] / r["n"] for r in got.collect() if r["n"]}
    draws = np.array([v for r, v in rows.items() if r > 0])
    low, high = np.percentile(draws, [2.5, 97.5])
    return {"delta": rows[0], "low": float(low), "high": float(high), "se": float(draws.std(ddof=1)), "significant": bool(high < 0)}


def gate(primary: dict, secondary: dict) -> bool:
    """Adopt if the primary change is significant and the secondary one not significantly worse."""
    return bool(primary["significant"] and not secondary["low"] > 0)


def simplex(k: int, steps: int) -> list[tuple[float, ...]]:
    """All weights with k parts in steps of 1 / steps."""
    cuts = combinations(range(steps + k - 1), k - 1)
    return [tuple((b - a - 1) / steps for a, b in zip((-1, *c), (*c, steps + k - 1), strict=True)) for c in cuts]


def grid_search(gram: DataFrame, models: Sequence[str], y: str, steps: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of every convex blend of the models, from the products of `gram` alone: no row is scored again."""
    weights = gram.sparkSession.createDataFrame(simplex(len(models), steps), ", ".join(f"w_{m} double" for m in models))
    name = lambda a, b: f"g_{a}_{b}" if f"g_{a}_{b}" in gram.columns else f"g_{b}_{a}"
    mse = F.col(f"g_{y}_{y}")
    for a in models:
        mse -= 2 * F.col(f"w_{a}") * F.col(name(a, y))
        for b in models:
            mse += F.col(f"w_{a}") * F.col(f"w_{b}") * F.col(name(a, b))
    return gram.crossJoin(F.broadcast(weights)).select(*keys, *[f"w_{m}" for m in models], mse.alias("mse"))


def two_model_weight(df: DataFrame, y: str, h: str, l: str) -> DataFrame:  # noqa: E741
    """Weight of l against h that minimises the squared error, within [0, 1]."""
    d = F.col(l) - F.col(h)
    w = F.sum((F.col(y) - F.col(h)) * d) / F.sum(d * d)
    return df.agg(F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)).alias("w"))


def convex_weights(gram_row: dict, models: Sequence[str], y: str) -> dict[str, float]:
    """Convex weights with the least squared error, exactly, by active sets on the k x k sums.

    The best single model starts as the support. The support's own best weights are taken; where one would be negative, the
    way there stops at the first that vanishes, which leaves the support. They are optimal once no other model's slope is
    below the support's common one; else the model with the lowest slope enters.
    """
    g = lambda a, b: gram_row.get(f"g_{a}_{b}", gram_row.get(f"g_{b}_{a}"))
    q = np.array([[g(a, b) for b in models] for a in models], dtype=float)
    c = np.array([g(a, y) for a in models], dtype=float)
    k, tiny = len(models), 1e-12 * max(1.0, np.abs(q).max())
    w = np.zeros(k)
    w[np.argmin(np.diag(q) - 2 * c)] = 1.0
    support = list(np.flatnonzero(w))
    for _ in range(3**k + k):  # no support comes twice but by rounding
        while True:
            m = len(support)
            lhs = np.block([[q[np.ix_(support, support)], np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]])
            best = np.linalg.lstsq(lhs, np.append(c[support], 1.0), rcond=None)[0][:m]
            now = w[support]
            if (best >= -1e-12).all():
                w[:] = 0.0
                w[support] = np.maximum(best, 0.0)
                break
            falls = best < -1e-12
            step = (now[falls] / (now[falls] - best[falls])).min()
            moved = now + step * (best - now)
            w[support] = np.where(moved > 1e-12, moved, 0.0)
            support = [i for i in support if w[i] > 0]
        slope = q @ w - c
        level = float(slope @ w / w.sum())
        support = list(np.flatnonzero(w > 0))
        enters = int(np.argmin(np.where(w > 0, np.inf, slope)))
        if w[enters] > 0 or slope[enters] >= level - tiny:
            break
        support.append(enters)
    return dict(zip(models, (w / w.sum()).tolist(), strict=True))


def affine_calibrator(df: DataFrame, y: str, p: str) -> DataFrame:
    """intercept, slope of least squares of y on p, the slope within [0, 3]."""
    slope = F.least(F.greatest(F.regr_slope(y, p), F.lit(0.0)), F.lit(3.0))
    return df.agg((F.avg(y) - slope * F.avg(p)).alias("intercept"), slope.alias("slope"))


def intercept_calibrator(df: DataFrame, y: str, p: str, rounds: int = 60) -> float:
    """The shift of the logits that makes the mean prediction equal the rate: Newton steps held within a bracket.

    Each step is one aggregate over the sums by distinct prediction.
    """
    sums = stored(df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(logit(F.col(p)).alias("z")).agg(F.count("*").alias("n"), F.sum(y).alias("s")))
    total = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    shift, low, high = 0.0, -40.0, 40.0
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.col("z") + shift)))
        at = sums.agg(F.sum(F.col("n") * q).alias("s"), F.sum(F.col("n") * q * (1 - q)).alias("slope")).first()
        gap = total["s"] - at["s"]
        low, high = (shift, high) if gap > 0 else (low, shift)
        step = shift + gap / at["slope"] if at["slope"] else (low + high) / 2
        after = step if low < step < high else (low + high) / 2
        if abs(after - shift) < 1e-13 * max(1.0, abs(shift)) or gap == 0:
            break
        shift = after
    return shift


def analytic_gain(df: DataFrame, y: str, p: str, c: str, g: float) -> DataFrame:
    """Gain of score from adding g * c to the prediction: 1e5 (2 g <r, c> - g^2 <c, c>) / (n r(1 - r))."""
    r = F.avg(y) * (1 - F.avg(y))
    return df.agg((1e5 * (2 * g * F.avg((F.col(y) - F.col(p)) * F.col(c)) - g * g * F.avg(F.col(c) * F.col(c))) / r).alias("gain"))


def coordinate_search(gains: np.ndarray, cross: np.ndarray, steps: Sequence[float], sweeps: int = 10) -> tuple[np.ndarray, float]:
    """Weights, one coordinate at a time, with the best (least, mean) gain over transitions.

    gains[t, i] is the linear and cross[t, i, j] the quadratic part of the gain of transition t.
    """
    w = np.zeros(gains.shape[1])
    value = lambda x: (lambda g: (g.min(), g.mean()))(gains @ x - np.einsum("i,tij,j->t", x, cross, x))
    best = value(w)
    for _ in range(sweeps):
        before = best
        for i in range(len(w)):
            for s in steps:
                trial = w.copy()
                trial[i] = s
                if (v := value(trial)) > best:
                    w, best = trial, v
        if best == before:
            break
    return w, float(best[0])


def ridge(gram_row: dict, features: Sequence[str], y: str, penalty: float) -> dict[str, float]:
    """Least squares with a ridge, solved from the k x k sums."""
    g = lambda a, b: gram_row.get(f"g_{a}_{b}", gram_row.get(f"g_{b}_{a}"))
    q = np.array([[g(a, b) for b in features] for a in features]) + penalty * np.eye(len(features))
    return dict(zip(features, np.linalg.solve(q, np.array([g(a, y) for a in features])).tolist(), strict=True))


def split_half_ceiling(df: DataFrame, half: Column, keys: Sequence[str], y: str, k: float) -> DataFrame:
    """skill() on half 1 of shrunk group rates learned on half 0."""
    df = df.withColumn("_half", half)
    learn, score = df.where("_half = 0"), df.where("_half = 1")
    whole = learn.agg(F.avg(y).alias("_p"))
    rates = learn.groupBy(*keys).agg(F.sum(y).alias("_s"), F.count("*").alias("_n"))
    rows = score.join(rates, list(keys), "left").crossJoin(F.broadcast(whole))
    p = (F.coalesce("_s", F.lit(0)) + k * F.col("_p")) / (F.coalesce("_n", F.lit(0)) + k)
    return skill(rows.withColumn("_q", p), y, "_q")


def artifact_screen(df: DataFrame, y: str, names: Sequence[str]) -> DataFrame:
    """name, usable: finite values within [0, 1] on all rows that are not the target itself. One pass."""
    checks = [F.struct(F.lit(n).alias("name"), (F.bool_and(F.coalesce(F.col(n).between(0, 1), F.lit(False))) & ~F.bool_and(F.col(n).eqNullSafe(F.col(y)))).alias("usable")) for n in names]
    return df.agg(F.array(*checks).alias("c")).select(F.explode("c").alias("x")).select("x.*")


def invariance_gap(a: DataFrame, b: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """n, gap: keys that either of two runs has, and the largest difference of their values; null if a run lacks a key."""
    both = a.withColumn("_in_a", F.lit(True)).alias("a").join(b.withColumn("_in_b", F.lit(True)).alias("b"), list(key), "full")
    gaps = [F.max(F.abs(F.col(f"a.{v}") - F.col(f"b.{v}"))) for v in values]
    whole = F.bool_and(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull())
    return both.agg(F.count("*").alias("n"), F.when(whole, F.greatest(*gaps, F.lit(0.0))).alias("gap"))
