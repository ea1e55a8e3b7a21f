"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that a Python worker holds at once. Bounds memory, not results.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; smaller settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(name)).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor loses no lineage.

    The folder is the session's spark.checkpoint.dir. Only where that is unset (tests, one machine)
    a temporary folder is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "tallyframe-checkpoints"))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed, with its own size as the planner's estimate; for what a loop joins again in each round.

    A checkpoint hands on the estimate of the plan it cuts off, which for a join is the product of both sides'. Over rounds that
    number's length multiplies, until the driver does nothing but multiply it. What is kept in storage is measured instead.
    """
    kept = df.persist()
    kept.count()
    done = checkpointed(kept)
    kept.unpersist()
    return done


def release(spark: SparkSession) -> None:
    """Drop the shuffle files and checkpoints of results out of use, which Spark keeps until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
