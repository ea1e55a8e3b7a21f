"""Joins of two streams with state on both sides, and removal of repeated rows, with late data.

State is held no longer than the watermark asks: rows later than `late` behind the newest of their stream are dropped, a left
row that can't find a partner any more is emitted alone, and a repeated row is known for as long as its copies may arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_repeats(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The first row of each key; repeats are recognised for `late` after the first, in whatever batch they come."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def followed_by(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str, how: str = "leftOuter") -> DataFrame:
    """Left rows with each right row of their key that follows at the same time or up to `within` after it.

    With leftOuter, a left row without any is emitted, with nulls, once the watermark has passed its time by `within`. The
    sides have different column names but for the key.
    """
    x = left.withWatermark(left_time, late)
    y = right.withColumnRenamed(key, "_key").withWatermark(right_time, late)
    near = (F.col(key) == F.col("_key")) & (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    return x.join(y, near, how).drop("_key")
