"""Intermediate results that many parts of a plan ask for, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and read from the checkpoint folder. It survives lost executors, and what is planned on it
    is planned without its past: where a heavy plan is used in several places, planning takes longer than running.

    The folder is the session's spark.checkpoint.dir; only a local session without one gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if not (context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)
