"""Results that are used more than once are written to the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, materialised by a checkpoint: it is computed once, and a lost executor costs none of it.

    The folder is the session's spark.checkpoint.dir. Where that is unset, one machine takes a temporary folder; a cluster
    must name a folder that all its machines share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "tallyframe-checkpoints"))
    return df.checkpoint()
