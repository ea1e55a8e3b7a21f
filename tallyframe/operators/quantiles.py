"""Exact quantiles of groups of any size, linearly interpolated.

Groups of up to `leaf` rows use the built-in aggregate, whose buffer holds a group's values. Where a group is larger,
the ranks in question are narrowed down first: a sketch proposes two cut points close around each rank, rows are counted
between them and at them, and only the intervals that hold a rank are cut again, now evenly, until each has few rows or a
single value. One round settles a group of a billion rows, and no task holds or sorts a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Rows of a group for the built-in aggregate, even cuts of later rounds, accuracy of the sketch, how far the first cuts lie
#: from a rank as a share of the rows, and most intervals sent to all tasks.
LEAF, CUTS, ACCURACY, MARGIN, FEW = 1_000_000, 127, 10_000, 3e-4, 100_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], column: str, qs: Sequence[float], leaf: int = LEAF) -> DataFrame:
    """keys, quantiles (array in the order of qs) of the column's known values; a row for each group that has any."""
    keys = list(keys)
    group = [*keys, "_all"]
    rows = df.select(*keys, F.lit(0).alias("_all"), F.col(column).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_hi"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= leaf:
        return rows.groupBy(*group).agg(F.percentile("_x", F.array(*map(F.lit, map(float, qs)))).alias("quantiles")).drop("_all")
    sizes = stored(sizes)
    place = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    ranks = F.array_distinct(F.array(*[f(place(q)).cast("long") for q in qs for f in (F.floor, F.ceil)]))
    # Intervals (lo, hi] with the rows below them and inside.
    open_ = sizes.select(*group, F.explode(ranks).alias("_rank"), F.lit(float("-inf")).alias("_lo"), "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_m"), (F.col("_min") == F.col("_hi")).alias("_same"))
    open_ = stored(open_)
    shares = sorted({min(max(float(q) + d, 0.0), 1.0) for q in qs for d in (-MARGIN, MARGIN)})
    while True:  # every round cuts each open interval at a value inside it
        wide = open_.where((F.col("_m") > leaf) & ~F.col("_same"))
        if not wide.limit(1).count():
            break
        intervals = wide.select(*group, "_lo", "_hi", "_below").distinct()
        inside = within(rows, intervals, group, True)  # of groups beyond the leaf size, so there are few
        cuts = inside.groupBy(*group, "_hi").agg(F.percentile_approx("_x", F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias("_cuts"), F.max(F.when(F.col("_x") < F.col("_hi"), F.col("_x"))).alias("_next"))
        # A cut below each cut sets its own value apart, however many rows have it.
        below = F.transform("_cuts", lambda c: F.when(c == 0, F.lit(-5e-324)).otherwise(c - F.abs(c) * 2.0**-52))
        cuts = cuts.select(*group, "_hi", F.array_sort(F.array_distinct(F.concat("_cuts", below, F.array("_next")))).alias("_cuts"))
        upper = F.coalesce(F.array_min(F.filter("_cuts", lambda c: c >= F.col("_x"))), F.col("_hi"))
        counted = inside.join(F.broadcast(cuts), [*group, "_hi"]).select(*group, "_hi", "_below", "_x", F.least(upper, "_hi").alias("_up")).groupBy(*group, "_hi", "_below", "_up").agg(F.count("*").alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
        w = Window.partitionBy(*group, "_hi").orderBy("_up")
        counted = counted.select(
            *group, "_hi", F.lag("_up").over(w).alias("_new_lo"), F.col("_up").alias("_new_hi"), F.col("_c").alias("_new_m"), (F.col("_a") == F.col("_b")).alias("_new_same"),
            (F.col("_below") + F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_new_below"),
        )
        hit = (F.col("_rank") >= F.col("_new_below")) & (F.col("_rank") < F.col("_new_below") + F.col("_new_m"))
        narrowed = wide.join(counted, [*group, "_hi"]).where(hit).select(
            *group, "_rank", F.coalesce("_new_lo", "_lo").alias("_lo"), F.col("_new_hi").alias("_hi"), F.col("_new_below").alias("_below"), F.col("_new_m").alias("_m"), F.col("_new_same").alias("_same")
        )
        open_ = stored(open_.where((F.col("_m") <= leaf) | F.col("_same")).unionByName(narrowed))
    values = within(rows, open_.select(*group, "_lo", "_hi", "_below").distinct(), group, open_.count() <= FEW).groupBy(*group, "_hi", "_below", "_x").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group, "_hi").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ends = values.withColumn("_upto", F.col("_below") + F.sum("_c").over(w)).select(*group, "_hi", "_x", "_upto", "_c")
    found = open_.join(ends, [*group, "_hi"]).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    known = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at")).join(sizes, group)
    at = lambda r: F.element_at("_at", r.cast("long"))

    def between(q: float) -> Column:
        low, high = at(F.floor(place(q))), at(F.ceil(place(q)))
        return low + (place(q) - F.floor(place(q))) * (high - low)

    return known.select(*keys, F.array(*[between(q) for q in qs]).alias("quantiles"))


def within(rows: DataFrame, intervals: DataFrame, group: Sequence[str], few: bool) -> DataFrame:
    """Rows that lie in an interval of their group, of which there are a few; with `few` all intervals go to all tasks."""
    lists = intervals.groupBy(*group).agg(F.collect_list(F.struct("_lo", "_hi", "_below")).alias("_list"))
    held = F.filter("_list", lambda i: (F.col("_x") > i["_lo"]) & (F.col("_x") <= i["_hi"]))
    return rows.join(F.broadcast(lists) if few else lists, list(group)).select(*group, "_x", F.get(held, F.lit(0)).alias("_i")).where("_i is not null").select(*group, "_x", "_i._lo", "_i._hi", "_i._below")
