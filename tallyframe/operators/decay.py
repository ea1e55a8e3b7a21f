"""Exponentially weighted windows: the decayed count and sum of all earlier rows of a key, for keys of any length.

From row to row the state (weight, sum) is decayed by the time that passed and the row is added: an affine map. Such maps
compose, so the rows are dealt into ranges of (key, time), each task runs through its own, and a key that goes on from one
range to the next takes over one state, decayed to each of its rows. No window holds a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored


def decayed_before(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], value: str, half_life: float) -> DataFrame:
    """df with `weight` and `total`: the decayed number and sum of the key's earlier values, 0 at the first row.

    time: a number; a value weighs 0.5 ** (passed / half_life). Rows are in order of time, then `order`, which makes it
    total. Null values count nothing; a null key is a key; rows of a null time take no part.
    """
    sort = [*keys, time, *order]
    rows = df.where(F.col(time).isNotNull()).withColumns({"_t": F.col(time).cast("double"), "_x": F.col(value).cast("double"), "_key": F.to_json(F.struct(*keys))})
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    schema = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes) + ", _part int, weight double, total double"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, own, at, w, s = TaskContext.get().partitionId(), None, 0.0, 0.0, 0.0
        for pdf in batches:
            before = []
            for key, t, x in zip(pdf["_key"], pdf["_t"].tolist(), pdf["_x"].tolist(), strict=True):
                if key != own:
                    own, w, s = key, 0.0, 0.0
                else:
                    fade = 0.5 ** ((t - at) / half_life)
                    w, s = w * fade, s * fade
                before.append((w, s))
                at = t
                if x == x:  # known
                    w, s = w + 1.0, s + x
            yield pdf.assign(_part=part, weight=[b[0] for b in before], total=[b[1] for b in before])

    local = stored(dealt.mapInPandas(walk, schema))
    # One row for each task: its first key and the state behind its last row.
    known = F.when(F.col("_x").isNotNull() & ~F.isnan("_x"), F.col("_x"))
    after = F.struct("_key", "_t", (F.col("weight") + F.when(known.isNotNull(), 1.0).otherwise(0.0)).alias("w"), (F.col("total") + F.coalesce(known, F.lit(0.0))).alias("s"))
    place = F.struct(*sort)
    edges = local.groupBy("_part").agg(F.min_by("_key", place).alias("first"), F.max_by(after, place).alias("end")).orderBy("_part").collect()
    carried, state = [], None
    for e in edges:
        key, t, w, s = e["end"]
        if state and state[0] == e["first"]:
            carried.append((e["_part"], *state))
            if key == state[0]:
                fade = 0.5 ** ((t - state[1]) / half_life)
                w, s = w + state[2] * fade, s + state[3] * fade
        state = (key, t, w, s)
    if not carried:
        return local.drop("_t", "_x", "_key", "_part")
    over = df.sparkSession.createDataFrame(carried, "_part int, _key string, _at double, _w double, _s double")  # a row a task at most
    fade = F.coalesce(F.pow(F.lit(0.5), (F.col("_t") - F.col("_at")) / half_life), F.lit(0.0))
    both = local.join(F.broadcast(over), ["_part", "_key"], "left")
    whole = both.withColumns({"weight": F.col("weight") + fade * F.coalesce("_w", F.lit(0.0)), "total": F.col("total") + fade * F.coalesce("_s", F.lit(0.0))})
    return whole.select(*df.columns, "weight", "total")
