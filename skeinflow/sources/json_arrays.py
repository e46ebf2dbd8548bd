"""JSON arrays of records in files of any size: read by many tasks, and written as one array a part.

A file is cut at closing braces by Spark's text source, whose splits are byte ranges, so one file is many tasks. Whether a split
begins within a string, and how deep, only what comes before it tells: a first pass finds, for either case, how each
split changes them, those few numbers are put in a row by file, and a second pass cuts the records. A record that crosses
splits is put together from its pieces. Nothing but pieces and numbers of splits is moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPED = re.compile(r"\\.", re.S)


def change(text: str, quoted: bool) -> tuple[bool, int]:
    """Whether a string is open after the text, and by how much braces and brackets outside strings deepen."""
    parts = _ESCAPED.sub("", text).split('"')
    outside = parts[quoted::2]
    depth = sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in outside)
    return quoted ^ (len(parts) % 2 == 0), depth


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): what stands between closing braces, in order within a split, which `start` tells apart."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _splits(pieces: DataFrame) -> DataFrame:
    """(file, start, quoted, depth): how each split begins."""

    def run(batches):
        found: dict[tuple, list] = {}
        for file, start, value in _rows(batches):
            s = found.setdefault((file, start), [[False, 0], [True, 0]])
            for case in s:
                case[0], more = change(value + "}", case[0])
                case[1] += more
        cells = [(f, s, *out, *inside) for (f, s), (out, inside) in found.items()]
        names = ["file", "start", "q0", "d0", "q1", "d1"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, c)) for c in cells], schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("q0", pa.bool_()), ("d0", pa.int64()), ("q1", pa.bool_()), ("d1", pa.int64())]))

    def chained(t: pa.Table) -> pa.Table:
        quoted, depth, out = False, 0, []
        for r in t.sort_by("start").to_pylist():
            out.append({"file": r["file"], "start": r["start"], "quoted": quoted, "depth": depth})
            quoted, depth = (r["q1"], depth + r["d1"]) if quoted else (r["q0"], depth + r["d0"])
        return pa.Table.from_pylist(out)

    ends = pieces.mapInArrow(run, "file string, start long, q0 boolean, d0 long, q1 boolean, d1 long")
    return ends.groupBy("file").applyInArrow(chained, "file string, start long, quoted boolean, depth long")  # a row for each split of a file


def _cut(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, start, opens, whole, text): whole records, and the pieces of those that cross splits (`opens`: the first one of such)."""

    def run(batches):
        def records():
            at = None
            for file, start, value, quoted_at, depth_at in _rows(batches):
                if (file, start) != at:
                    if at and held is not None:
                        yield *at, opens, False, "".join(held)
                    at, quoted, depth = (file, start), quoted_at, depth_at
                    # in the middle of a record: deeper than the array, or in a string
                    held, opens, base = ([], False, None) if depth > 1 or quoted else (None, True, None)
                text = value + "}"
                if held is None:
                    i = text.find("{")
                    quoted, more = change(text[:i] if i >= 0 else text, False)
                    depth += more
                    if i < 0:
                        continue
                    held, opens, base, text = [], True, depth, text[i:]
                held.append(text)
                quoted, more = change(text, quoted)
                depth += more
                if not quoted and depth <= (1 if base is None else base):
                    yield *at, opens, opens, "".join(held)
                    held = None
            if at and held is not None:
                yield *at, opens, False, "".join(held)

        kept: list = []
        size = 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))], names=["file", "start", "opens", "whole", "text"])
        for r in records():
            kept.append(r)
            size += len(r[-1])
            if size > 4 << 20 or len(kept) >= 10_000:
                yield make()
                kept, size = [], 0
        if kept:
            yield make()

    met = pieces.join(F.broadcast(splits), ["file", "start"])  # a row for each split
    return met.select("file", "start", "value", "quoted", "depth").mapInArrow(run, "file string, start long, opens boolean, whole boolean, text string")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of one or many files, each a JSON array of objects (a byte-order mark or not) or objects one after another.

    An empty file or array gives no rows. A record that isn't JSON has nulls only.
    """
    pieces = _pieces(spark, path)
    found = _cut(pieces, _splits(pieces))
    of = F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start", "opens"))
    crossing = found.where("NOT whole").withColumn("record", of)  # two for each split at most
    joined = crossing.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "").alias("text"))
    every = found.where("whole").select("text").unionByName(joined.select("text"))
    return every.select(F.from_json("text", schema).alias("r")).select("r.*")


def write_json_array(df: DataFrame, path: str) -> None:
    """Each part is a file that holds one JSON array; a part is written row by row."""

    def run(batches):
        before, last = "[", None
        for b in batches:
            lines = b.column(0).to_pylist()
            if last is not None:
                lines.insert(0, last)
            if lines:
                out = [("[" if before == "[" and i == 0 else "") + x + "," for i, x in enumerate(lines[:-1])]
                if out:
                    before = ","
                last = lines[-1]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([("[" if before == "[" else "") + last + "]"], pa.string())], names=["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)
