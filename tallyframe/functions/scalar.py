"""Scalar expressions: columns in, columns out. Missing values follow SQL unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column, kind: str = "double") -> Column:
    """A cast that turns bad values, and NaN, into null."""
    out = x.try_cast(kind)
    return F.when(~F.isnan(out), out) if kind in ("double", "float") else out


def true(p: Column) -> Column:
    """A predicate whose unknown value counts as false."""
    return F.coalesce(p, F.lit(False))


def safe_divide(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b where b > 0, else default."""
    return F.when(b > 0, a / b).otherwise(F.lit(default).cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q) - F.log1p(-q)


def expit(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear through the points (xs ascending), constant beyond the ends."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 2, -1, -1):
        slope = (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i])
        out = F.when(x < xs[i + 1], ys[i] + (x - xs[i]) * slope).otherwise(out)
    return F.when(x.isNull(), None).when(x <= xs[0], float(ys[0])).otherwise(out)


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def shrink(s: Column, n: Column, k, prior) -> Column:
    """Empirical-Bayes rate: (s + k * prior) / (n + k). k must be positive."""
    if isinstance(k, (int, float)):
        if k <= 0:
            raise ValueError("k must be positive")
        k = F.lit(float(k))
    return (s + k * prior) / (n + k)


def reliability(n: Column, k: float) -> Column:
    return n / (n + k)


def posterior_sd(rate: Column, n: Column, k: float) -> Column:
    return F.sqrt(rate * (1 - rate) / (n + k + 1))


def right_closed_bin(x: Column, edges: Sequence[float]) -> Column:
    """i if edges[i] < x <= edges[i + 1]; -1 if outside or missing."""
    out = F.lit(-1)
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), i).otherwise(out)
    return out


def digitize(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are at most x."""
    return sum(((x >= e).cast("int") for e in edges), F.lit(0))


def fixed_bin(x: Column, low: float, high: float, step: float) -> Column:
    """Bin of fixed width after clipping; -1 if missing."""
    return F.coalesce(F.floor((clip(x, low, high) - low) / step + 1e-9).cast("int"), F.lit(-1))


def log_count_bin(n: Column) -> Column:
    """floor(log2(max(n, 0) + 1)); -1 if missing."""
    return F.when(n.isNull(), -1).otherwise(F.floor(F.log2(F.greatest(n, F.lit(0)) + 1)).cast("int"))


def ladder(x: Column, steps: Sequence[tuple[float, str]], rest: str, missing: str = "missing") -> Column:
    """The name of the first step whose bound is above x."""
    out = F.lit(rest)
    for bound, name in reversed(steps):
        out = F.when(x < bound, name).otherwise(out)
    return F.when(x.isNull(), missing).otherwise(out)


def decile(x: Column) -> Column:
    """Tenth of a rate, 1.0 in the last; null if missing."""
    return F.least(F.floor(x * 10), F.lit(9)).cast("int")


def composite_key(*parts: Column, missing: str = "__missing__") -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(missing)) for p in parts])


def mixed_radix(digits: Sequence[tuple[Column, int]]) -> Column:
    """One integer from digits (value, base), the first the most significant."""
    code = digits[0][0]
    for value, base in digits[1:]:
        code = code * base + value
    return code


def one_hot_products(rate: Column, cells: dict[str, Column]) -> list[Column]:
    """rate in its own cell, 0 elsewhere, a column for each cell."""
    return [F.when(true(is_cell), rate).otherwise(0.0).alias(name) for name, is_cell in cells.items()]


def entropy_term(p: Column) -> Column:
    return -p * F.ln(F.greatest(p, F.lit(1e-12)))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor, by Euclid's steps; 64-bit integers need at most 92."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] != 0, s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, 0).otherwise(F.abs(a * b) / F.when(g == 0, 1).otherwise(g)).cast("long")


def best_fraction(x: Column, most: int) -> Column:
    """Struct (num, den) of the fraction closest to x with a denominator up to most; ties go to the smaller denominator."""
    tries = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda d: F.struct(F.abs(F.rint(x * d) / d - x).alias("err"), d.alias("den"), F.rint(x * d).cast("int").alias("num")))
    best = F.array_min(F.filter(tries, lambda t: t["err"].isNotNull()))
    return F.when(x.isNotNull(), F.struct(best["num"].alias("num"), best["den"].alias("den")))


def parse_date(x: Column) -> Column:
    """Dates written as MM/dd/yyyy or yyyy-MM-dd; null if neither."""
    return F.coalesce(F.try_to_timestamp(x, F.lit("MM/dd/yyyy")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))).cast("date")


def signed_buckets(tokens: Column, bits: int) -> Column:
    """Array of (bucket, sign) of tokens: 2^bits buckets, sign from another part of the md5."""
    part = lambda t, at, n: F.conv(F.substring(F.md5(t), at, n), 16, 10).cast("long")
    return F.transform(tokens, lambda t: F.struct((part(t, 1, 8) % (1 << bits)).cast("int").alias("bucket"), F.when(part(t, 9, 1) >= 8, 1).otherwise(-1).alias("sign")))


def md5_fold(key: Column, folds: int) -> Column:
    """Fold of a key by its md5, the same in any engine."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % folds).cast("int")
