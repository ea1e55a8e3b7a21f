"""Streams over events: windows with late data, sessions and running counters per entity."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, glob: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def windowed_sums(events: DataFrame, time: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Count and sum by tumbling window; rows later than `late` behind the newest are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("s")).select(F.col("w.start").alias("start"), *keys, "n", "s")


def sliding_counts(events: DataFrame, time: str, width: str, step: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key that end after a gap."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_counters(events: DataFrame, key: str, id: str, target: str) -> DataFrame:
    """key, id, n, s: rows and targets of the key before each row, in order of the id inside a batch; state lives in Spark."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(id)
        y = rows[target].to_numpy()
        yield pd.DataFrame({key: k[0], id: rows[id], "n": n + pd.RangeIndex(len(rows)).to_numpy(), "s": s + y.cumsum() - y})
        state.update((n + len(rows), int(s + y.sum())))

    kind = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {id} {kind[id]}, n long, s long", "n long, s long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, spark: SparkSession, mode: str, sink: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all there is and return its output as a table of the shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    path = os.path.join(shared, f"stream-{uuid.uuid4().hex}")
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    else:
        write = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")
        q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
