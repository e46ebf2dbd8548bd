"""Writing what is read more than once: to the folder in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir. In local mode a folder of its own does where none is set; on a cluster one that isn't shared won't."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="skeinflow-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared(spark)}/parts-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as computed now, in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def dropped(df: DataFrame) -> None:
    """Removes what `settled` has written; df can't be read any more."""
    spark = df.sparkSession
    written = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if written.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(written.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of frames made and settled within go as soon as these are settled."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def partitioning_kept(spark: SparkSession):
    """Frames settled within are known to lie as their last exchange has put them, which an adaptive plan doesn't tell."""
    return _set(spark, "spark.sql.adaptive.enabled", "false")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its scan has fewer tasks than there are cores (a table of one small file); otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as computed now, in a folder of its own under spark.checkpoint.dir, in a subfolder for each value of `by`: a filter on these reads its own only."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
