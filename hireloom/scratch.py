"""Cutting lineage of iterative work with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df from files in the session's checkpoint folder; where a session on one machine names
    none (tests), a temporary folder is set as it, and elsewhere this is an error."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or f"file://{tempfile.mkdtemp(prefix='hireloom-')}")
    return df.checkpoint(eager=True)
