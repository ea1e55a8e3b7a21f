"""Row-level operators: views, filters, keys, encodings learned from a training part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .windows import global_number


def select_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    """Columns whose names start with one of the prefixes; an error if there are none."""
    names = [c for c in df.columns if c.startswith(prefixes)]
    if not names:
        raise ValueError(f"no column starts with {prefixes}")
    return df.select(*names)


def with_blocks(df: DataFrame, *blocks: dict[str, Column]) -> DataFrame:
    """Blocks of derived columns side by side, in one projection."""
    return df.select("*", *[c.alias(name) for block in blocks for name, c in block.items()])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that must be there."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*names)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def temporal_split(df: DataFrame, season: str, valid: int) -> tuple[DataFrame, DataFrame]:
    """Rows before the season and rows of it; an empty side is an error."""
    sizes = df.agg(F.count_if(F.col(season) < valid).alias("train"), F.count_if(F.col(season) == valid).alias("valid")).first()
    if not sizes["train"] or not sizes["valid"]:
        raise ValueError(f"an empty side at {season} {valid}: {sizes.asDict()}")
    return df.where(F.col(season) < valid), df.where(F.col(season) == valid)


def history_window(df: DataFrame, season: str, before: int, width: int | None = None) -> DataFrame:
    """Rows of the `width` seasons before a season, of all earlier ones if width is None."""
    kept = df.where(F.col(season) < before)
    return kept if width is None else kept.where(F.col(season) >= before - width)


def exclude_regime(df: DataFrame, regime: Column, season: str, start: int) -> DataFrame:
    """Without the rows of a regime before a season."""
    return df.where(~F.coalesce(regime & (F.col(season) < start), F.lit(False)))


def outcome_label(valid: Column, success: Column, failures: Sequence[tuple[str, Column]], rest: str, context: Column | None = None) -> Column:
    """invalid, hit, the first failure that holds, or rest; with a context after a colon."""
    label = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(success, "hit")
    for name, holds in failures:
        label = label.when(holds, name)
    label = label.otherwise(rest)
    return label if context is None else F.concat_ws(":", label, F.coalesce(context, F.lit("__missing__")))


def symmetric_pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def role_swap(first: Column, a: str, b: str) -> tuple[Column, Column]:
    """(a, b) where first holds, else (b, a)."""
    return F.when(first, F.col(a)).otherwise(F.col(b)), F.when(first, F.col(b)).otherwise(F.col(a))


def pressure(a: str, b: str, top_a: int, top_b: int) -> Column:
    """1 if only a is at its top, 2 if only b is, 3 if both are, else 0."""
    at_a, at_b = F.col(a) == top_a, F.col(b) == top_b
    return F.when(at_a & (F.col(b) < top_b), 1).when((F.col(a) < top_a) & at_b, 2).when(at_a & at_b, 3).otherwise(0)


def ordinal_encode(df: DataFrame, train: DataFrame, column: str, out: str, unknown: int = 0) -> DataFrame:
    """Codes from 1 in the sort order of the training categories; unseen ones get `unknown`."""
    codes = train.select(column).where(F.col(column).isNotNull()).distinct()
    codes = global_number(codes, [column], out).withColumn(out, (F.col(out) + 1).cast("int"))
    return df.join(codes, column, "left").withColumn(out, F.coalesce(out, F.lit(unknown)))


def keep_top_categories(df: DataFrame, train: DataFrame, column: str, n: int, out: str, other: str = "OTHER") -> DataFrame:
    """The n most frequent training categories (ties to the smaller) stay, the rest become `other`."""
    top = train.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(n).select(column, F.lit(True).alias("_top"))
    return df.join(top, column, "left").withColumn(out, F.when(F.col("_top"), F.col(column)).otherwise(other)).drop("_top")


def normalise_label(x: Column, aliases: dict[str, str], allowed: Sequence[str], other: str) -> Column:
    named = x
    for old, new in aliases.items():
        named = F.when(x == old, new).otherwise(named)
    return F.when(named.isin(*allowed), named).otherwise(other)


def robust_scale(df: DataFrame, column: str, out: str, bound: float = 6.0) -> DataFrame:
    """(x - median) / (IQR / 1.349), with the deviation or 1 where the IQR is 0, clipped."""
    x = F.col(column)
    quartiles = exact_quantiles(df, [], column, (0.25, 0.5, 0.75)).select(F.col("quantiles").alias("_q"))
    stats = df.agg(F.stddev_pop(x).alias("_sd")).join(quartiles, how="left")
    iqr = F.col("_q")[2] - F.col("_q")[0]
    scale = F.when(iqr > 0, iqr / 1.349).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    z = F.least(F.greatest((x - F.col("_q")[1]) / scale, F.lit(-bound)), F.lit(bound))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, F.when(x.isNotNull(), z)).drop("_q", "_sd")


def standardise(df: DataFrame, source: DataFrame, column: str, out: str) -> DataFrame:
    """Missing values become the source's median, then z-scores by the source's mean and deviation."""
    x = F.col(column)
    middle = exact_quantiles(source, [], column, (0.5,)).select(F.col("quantiles")[0].alias("_m"))
    stats = source.agg(F.avg(x).alias("_mu"), F.stddev_pop(x).alias("_sd")).join(middle, how="left")
    z = (F.coalesce(x, F.col("_m")) - F.col("_mu")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return df.crossJoin(F.broadcast(stats)).withColumn(out, z).drop("_m", "_mu", "_sd")
