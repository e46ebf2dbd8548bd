"""Scans and sinks of records, caches and artifacts. Records have one explicit schema; nothing is inferred."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_arrays import read_json_array, write_json_array

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
RECORD = T.StructType([*_text("id", "text"), T.StructField("labels", T.ArrayType(T.StringType())), *_text("example_type", "platform", "explicitness", "severity"), T.StructField("slang_used", T.ArrayType(T.StringType())), T.StructField("synthetic", T.BooleanType())])
JUDGED = T.StructType([*RECORD.fields, T.StructField("judge_verdict", T.StringType()), T.StructField("judge_codes", T.ArrayType(T.StringType()))])
CACHE = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("codes", T.ArrayType(T.StringType()))])


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A JSON array (byte-order mark or not; one file is read by many tasks), JSON lines (*.jsonl) or Parquet. Null label lists read as empty."""
    if path.rstrip("/").endswith(".json"):
        df = read_json_array(spark, path, schema)
    elif path.rstrip("/").endswith(".jsonl"):
        df = spark.read.schema(schema).json(path)
    else:
        df = spark.read.schema(schema).parquet(path)
    empty = F.array().cast("array<string>")
    return df.withColumns({c: F.coalesce(c, empty) for c in ("labels", "slang_used") if c in df.columns})


def with_aliases(df: DataFrame) -> DataFrame:
    """The platform as `persona` and the type as `event_type` too."""
    return df.withColumns({"persona": F.col("platform"), "event_type": F.col("example_type")})


def read_first(spark: SparkSession, *paths: str) -> tuple[DataFrame, str]:
    """Records of the first path that is there (the clean file, else the raw one), and which it was."""
    for path in paths:
        if exists(spark, path):
            return read_records(spark, path), path
    raise FileNotFoundError(f"none of these is there: {', '.join(paths)}")


def read_folds(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Both files as one frame with a fold; all that are missing are named."""
    missing = [p for p in (train, test) if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")
    return read_records(spark, train).withColumn("fold", F.lit("train")).unionByName(read_records(spark, test).withColumn("fold", F.lit("test")))


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def latest(spark: SparkSession, log: str) -> tuple[int, dict | list | None]:
    """The last version of a log of JSON files, and its content; 0 and None if there is none yet."""
    fs, at = _fs(spark, log)
    if not fs.exists(at):
        return 0, None
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    version = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
    return (version, json.loads(spark.read.text(f"{log}/{version:012d}.json", wholetext=True).first()[0])) if version else (0, None)


def commit(spark: SparkSession, log: str, version: int, content: dict | list) -> bool:
    """Adds a version to the log in one step: written under another name, then renamed. False if another writer has taken the version."""
    own = f"{log}/.{uuid.uuid4().hex}"
    write_artifact(spark, content, own)
    jvm, fs = spark._jvm, spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    source = fs.Path(own)
    context = fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()) if source.toUri().getScheme() else fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, fs.Path(f"{log}/{version:012d}.json"), options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        context.delete(source, False)
        return False
    return True


def _parts(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """One row a key: that of the last part which has it."""
    each = [spark.read.schema(CACHE).parquet(f"{path}/{p}") for p in parts]
    if len(each) == 1:
        return each[0]
    every = reduce(DataFrame.unionByName, (d.withColumn("_at", F.lit(i)) for i, d in enumerate(each)))
    return every.groupBy("cache_key").agg(F.max_by("codes", "_at").alias("codes"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The verdict cache, one row a key; empty if there is none yet. One that can't be read is an error, not an empty one."""
    if not exists(spark, path):
        return spark.createDataFrame([], CACHE)
    _, parts = latest(spark, f"{path}/_log")
    return _parts(spark, path, parts) if parts else spark.createDataFrame([], CACHE)  # a part that no version names yet isn't there


def upsert_cache(rows: DataFrame, path: str, most_parts: int = 16) -> None:
    """New verdicts; a key that is there already takes the new one.

    The batch is written as a part, then a version of the log that names it is put in place in one step: a batch that is killed
    in between leaves a part that nobody reads, and of two writers the later takes the other's version in and tries again. Beyond
    `most_parts` the parts are merged by key into one.
    """
    spark = rows.sparkSession
    part = f"parts/{uuid.uuid4().hex}"
    rows.groupBy("cache_key").agg(F.min("codes").alias("codes")).write.parquet(f"{path}/{part}")
    while True:
        version, parts = latest(spark, f"{path}/_log")
        named = [*(parts or []), part]
        if len(named) > most_parts:
            merged = f"parts/{uuid.uuid4().hex}"
            _parts(spark, path, named).write.parquet(f"{path}/{merged}")
            named = [merged]
        if commit(spark, f"{path}/_log", version + 1, named):
            return


def write_records(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet, or any format of Spark's; `json-array` writes a JSON array for each part."""
    if form == "json-array":
        return write_json_array(df, path)
    df.write.mode("overwrite").format(form).save(path)


def write_clean(judged: DataFrame, path: str) -> None:
    judged.where("verdict = 'ACCEPT'").withColumnsRenamed({"verdict": "judge_verdict", "codes": "judge_codes"}).write.mode("overwrite").parquet(path)


def write_folds(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("fold").parquet(path)


def artifact(df: DataFrame, places: int | None = None, most: int = 10_000) -> list[dict]:
    """A small frame as plain rows for a JSON file. Too many rows raise instead of filling the driver."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"an artifact of more than {most} rows")
    return [{k: round(v, places) if places is not None and isinstance(v, float) else v for k, v in r.items()} for r in rows]


def write_artifact(spark: SparkSession, content: dict | list | str, path: str) -> None:
    """JSON (or text as it is) to any path that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray((content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, indent=2)).encode()))
    finally:
        out.close()


def read_artifacts(spark: SparkSession, paths: dict[str, str]) -> dict[str, dict]:
    """JSON files by name; all that are missing are named in one error."""
    missing = [p for p in paths.values() if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")
    return {k: json.loads(spark.read.text(p, wholetext=True).first()[0].lstrip("﻿")) for k, p in paths.items()}


def small_outputs(spark: SparkSession, paths: list[str], least_bytes: int = 20_000) -> list[str]:
    """Paths that are missing or smaller than they should be."""
    size = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(p)).getLength()
    return [p for p in paths if not exists(spark, p) or size(p) < least_bytes]
