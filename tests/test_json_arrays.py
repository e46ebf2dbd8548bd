"""JSON arrays read by many tasks against reading a file whole, and written back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.sources import json_arrays
from skeinflow.sources import tables as io

SCHEMA = "id long, text string, labels array<string>, deep struct<a: string, b: struct<c: long>>"


def made(n, seed=1):
    rng = random.Random(seed)
    odd = ["}", "{", '"', "\\", "],[", '\\"}', "é", "שלום", "\n", "plain ", "}{", "\\\\", "[{"]
    return [{"id": i, "text": "".join(rng.choice(odd) for _ in range(rng.randint(0, 40))), "labels": rng.choice([[], ["x"], ["}", '"{']]), "deep": rng.choice([None, {"a": "{\\", "b": {"c": i}}, {"a": "", "b": None}])} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize(("indent", "mark"), [(None, ""), (2, "﻿")])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits, indent, mark):
    records = made(150)
    (tmp_path / "r.json").write_text(mark + json.dumps(records, ensure_ascii=False, indent=indent), encoding="utf-8")
    path = f"file://{tmp_path}/r.json"
    pieces = json_arrays._pieces(spark, path)
    assert pieces.select("start").distinct().count() > 10 and pieces.rdd.getNumPartitions() > 4
    got = json_arrays.read_json_array(spark, path, spark.createDataFrame([], SCHEMA).schema)
    assert rows(got) == rows(spark.createDataFrame(records, SCHEMA)) == rows(spark.read.schema(SCHEMA).option("multiLine", True).json(path))


def test_records_longer_than_splits_and_odd_files(spark, tmp_path, small_splits):
    schema = spark.createDataFrame([], SCHEMA).schema
    long = [{"id": i, "text": "{ } \" \\ " * (400 * (i % 2)) + str(i), "labels": [], "deep": None} for i in range(7)]
    (tmp_path / "long.json").write_text(json.dumps(long))
    (tmp_path / "none.json").write_text("")
    (tmp_path / "empty.json").write_text("[ ]\n")
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in long))
    read = lambda name: rows(json_arrays.read_json_array(spark, f"file://{tmp_path}/{name}", schema))
    assert read("long.json") == read("lines.json") == rows(spark.createDataFrame(long, SCHEMA))
    assert read("none.json") == read("empty.json") == [] and len(read("*.json")) == 14


def test_arrays_are_written_and_read_back(spark, tmp_path):
    d = spark.createDataFrame(made(60, 3), SCHEMA).repartition(3)
    io.write_records(d, f"file://{tmp_path}/out.json", "json-array")
    files = [json.loads(p.read_text()) for p in (tmp_path / "out.json").glob("part-*") if p.stat().st_size]
    assert len(files) == 3 and sum(map(len, files)) == 60
    assert rows(json_arrays.read_json_array(spark, f"file://{tmp_path}/out.json", d.schema)) == rows(d)
    io.write_records(d.where(F.lit(False)), f"file://{tmp_path}/none.json", "json-array")
    assert json_arrays.read_json_array(spark, f"file://{tmp_path}/none.json", d.schema).count() == 0
