"""Ordered operators. Every order is total: callers pass the columns that make it so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored


def sessionise(df: DataFrame, season: str, order: Sequence[str], keys: Sequence[str], falling: Sequence[str], out: str = "session") -> DataFrame:
    """Number sessions in order: one starts where a key changes or a value that should grow falls.

    A new season always starts one. Rows are numbered within ranges of the order (see deal_ranges). Whether a range's first
    row starts a session is decided by the last row of the range before, in a table of one row for each range.
    """
    watched = [*dict.fromkeys([season, *keys, *falling])]
    row = F.struct(*watched)

    def starts(now: Column, prior: Column) -> Column:
        found = prior.isNull()
        for k in (season, *keys):
            found |= ~now[k].eqNullSafe(prior[k])
        for v in falling:
            found |= F.coalesce(now[v] < prior[v], F.lit(False))
        return found.cast("long")

    order = [season, *order]
    w = Window.partitionBy("_range").orderBy(*order)
    marked = deal_ranges(df, order).withColumn("_row", row).withColumn("_starts", F.when(F.row_number().over(w) == 1, 0).otherwise(starts(F.col("_row"), F.lag("_row").over(w))))
    local = stored(marked.withColumn("_local", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    place = F.struct(*order)
    ranges = local.groupBy("_range").agg(F.min_by("_row", place).alias("_first"), F.max_by("_row", place).alias("_last"), F.max("_local").alias("_n"))
    ranges = ranges.withColumn("_opens", starts(F.col("_first"), F.lag("_last").over(Window.orderBy("_range"))))
    before = F.sum(F.col("_n") + F.col("_opens")).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return local.join(ranges.select("_range", before.alias("_before")), "_range").withColumn(out, F.col("_local") + F.col("_before") - 1).drop("_starts", "_local", "_before", "_range", "_row")


def running_index(keys: Sequence[str], order: Sequence[str]) -> Column:
    """Place in the group, from 0."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def before(x: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Sum over the group's earlier rows; 0 at the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(x).over(w), F.lit(0))


def recovered_event(n: str, count: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The 0/1 event of a row, read from the running counter of the next row; null where the counters don't tell."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.lead(count).over(w) - F.col(count)
    return F.when((F.lead(n).over(w) == F.col(n) + 1) & step.isin(0, 1), step)


def rolling_sum(x: Column, keys: Sequence[str], order: Sequence[str], h: int) -> Column:
    """Sum over the h rows before; null unless there are h with a value."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-h, -1)
    return F.when(F.count(x).over(w) == h, F.sum(x).over(w))


def best_rank(order: Sequence, *keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def deal_ranges(df: DataFrame, order: Sequence[str], out: str = "_range") -> DataFrame:
    """df with the number of the range in which each row lies in a total order. Null values come first.

    The ranges are the partitions of a range shuffle, as many as spark.sql.shuffle.partitions or fewer. Use the result once
    and store what comes of it: another evaluation may cut elsewhere.
    """
    return df.repartitionByRange(*order).withColumn(out, F.spark_partition_id())


def global_number(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Number all rows from 0 in a total order without a single task that holds them.

    Places inside a range of the order are shifted by the rows of the ranges before, a table of one row for each range.
    """
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    dealt = stored(deal_ranges(df, order).withColumn("_place", place))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return dealt.join(sizes.select("_range", before.alias("_before")), "_range").withColumn(out, F.col("_place") + F.col("_before") - 1).drop("_range", "_place", "_before")


def first_seen_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Groups numbered from 0 in the order of their first rows."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(f"_o{i}") for i, c in enumerate(order)])
    numbers = global_number(first, [f"_o{i}" for i in range(len(order))], out).select(*keys, out)
    return df.join(numbers, list(keys))


def boundaries(df: DataFrame, season: str, order: Sequence[str], id: str) -> DataFrame:
    """First and last id and the rows of each season."""
    return df.groupBy(season).agg(F.min_by(id, F.struct(*order)).alias("first"), F.max_by(id, F.struct(*order)).alias("last"), F.count("*").alias("n"))
