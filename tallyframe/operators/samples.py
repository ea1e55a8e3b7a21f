"""Orders, samples and splits that any rerun repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_order(df: DataFrame, keys: Sequence[str], order: Sequence, out: str) -> DataFrame:
    """Place of each row in its group; the order must be total, as a distributed sort keeps no ties in place."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def arg_best(df: DataFrame, keys: Sequence[str], value: str, *criteria: Column) -> DataFrame:
    """The value whose criteria are lexicographically largest in each group."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(criteria)])).alias(value))


def every_kth(df: DataFrame, ordinal: str, k: int) -> DataFrame:
    return df.where(F.col(ordinal) % k == 0)


def hash_sample(df: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    """n rows by the md5 of seed and id; a bounded top, not a sort of all rows."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string"))), id).limit(n)


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """About n rows of each group, evenly spaced, the first and last among them; all rows of small groups."""
    group = Window.partitionBy(*keys)
    placed = df.withColumns({"_i": F.row_number().over(group.orderBy(*order)) - 1, "_n": F.count("*").over(group)})
    step = lambda i: F.floor(i * (n - 1) / F.when(F.col("_n") > 1, F.col("_n") - 1))
    return placed.where((F.col("_n") <= n) | (F.col("_i") == 0) | (step(F.col("_i")) > step(F.col("_i") - 1))).drop("_i", "_n")
