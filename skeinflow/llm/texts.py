"""What the text operators share: reading tables and mapping texts in bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; with the byte bound it keeps a worker's memory flat whatever the texts' length.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20

#: The six ASCII white-space characters that the word rules split on; bytes.split() splits on exactly these.
SPACES = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, by rows and bytes, in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def map_texts(df: DataFrame, rows_of: Callable[..., dict[str, list]], schema: str, keep: list[str], text: str = "text") -> DataFrame:
    """Adds to the columns `keep` of df those that `rows_of(texts)` computes from the texts (bytes), by name.

    Only `keep` and the text column are read, so extra columns never clash with the added ones.
    """
    small_batches(df.sparkSession)
    types = {c: df.schema[c].dataType.simpleString() for c in keep}
    out = ", ".join([*(f"`{c}` {t}" for c, t in types.items()), schema])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows_of(utf8(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(made[n]) if made[n] is None or not isinstance(made[n], pa.Array) else made[n] for n in names)], names=[*keep, *names])

    return df.select(*keep, F.col(text).cast("string").alias("_text_")).mapInArrow(run, out)
