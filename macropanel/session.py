"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the call site of every column expression makes long plans slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "macropanel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, val in SESSION_CONF.items():
        builder = builder.config(key, val)
    for key, val in conf.items():
        builder = builder.config(key.replace("__", "."), val)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from there.

    The folder is the one the cluster names in `spark.checkpoint.dir`, so that a lost
    executor does not lose the data. A session within one process (`local[...]`, as in tests)
    may go without and gets a new temporary folder; on a cluster a missing setting is an error.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, set as `cut_lineage` says."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="macropanel-checkpoints-"))
    return context.getCheckpointDir()
