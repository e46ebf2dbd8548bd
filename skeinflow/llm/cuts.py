"""Cutting lineage: what is used more than once is written once, to the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; without it, a folder of its own does in local mode (tests), and a cluster raises an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skeinflow-"))


def cut(df: DataFrame) -> DataFrame:
    """df as computed now: later reads come from the shared folder and survive the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
