"""Verdicts for a stream of records: each micro-batch meets the cache as it stands, and its new verdicts are put in, one row a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.judge import settle
from ..sources.tables import read_cache, upsert_cache


def judge_stream(records: DataFrame, score: Callable[[DataFrame], DataFrame], cache_path: str, out_path: str, checkpoint: str, text: str = "text", **limits) -> StreamingQuery:
    """Runs over all that is there. Batch n goes to out_path/batch=n and overwrites what a failed try left; a key is never scored again once it is cached."""

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        judged, new = settle(batch, read_cache(spark, cache_path), score, text, **limits)
        judged.write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        upsert_cache(new, cache_path)

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
