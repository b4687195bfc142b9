"""The folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile

from .errors import FlowError


def shared_top(spark) -> str:
    """``spark.checkpoint.dir``; a folder of this machine where that is unset and all of Spark runs here, as in tests."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not top and not context.master.startswith("local"):
        raise FlowError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
    return (top or os.path.join(tempfile.gettempdir(), "weirflow-scratch")).rstrip("/")


def checkpointed(df):
    """The DataFrame's rows, written below the shared folder: what is numbered or split once stays so when tasks run again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_top(df.sparkSession))
    return df.checkpoint()
