"""Records made of the driver's tables: what stands for labels, platform, type and severity, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: labels quality, toxic, long, non_english; platform is lang, type is source."""
    known = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").join(known, "doc_id", "left")
    sets = F.array_compact(F.array(F.when(F.col("n_chars") > 2000, "long"), F.when(F.col("lang") != "en", "non_english"), F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    return d.select(F.col("doc_id").alias("id"), "text", sets.alias("labels"), F.col("lang").alias("platform"), F.col("source").alias("example_type"), "n_chars")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: labels are the return flags of their lines; severity is the priority, platform and explicitness the status."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("labels"))
    o = table(spark, sf_dir, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<string>")
    return o.select(F.col("o_orderkey").alias("id"), F.coalesce("labels", none).alias("labels"), F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("explicitness"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users: labels are the kinds of their events."""
    by = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("labels"))
    return by.select(F.concat_ws(":", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("id"), "labels")


CLASSES = ["long", "non_english", "quality", "toxic"]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, y, proba) with a seeded stand-in for a classifier that is right more often than not."""
    label = F.explode(F.array(*map(F.lit, CLASSES))).alias("label")
    long = docs(spark, sf_dir).select("id", "labels", label)
    y = F.array_contains("labels", F.col("label")).cast("int")
    return long.select("id", "label", y.alias("y"), (hash_uniform(F.lit("score"), F.col("label"), F.col("id")) * 0.65 + y * 0.35).alias("proba"))


DOCS_SQL = """docs AS (
  SELECT d.doc_id AS id, d.text, d.lang AS platform, d.source AS example_type, d.n_chars,
    list_filter([CASE WHEN d.n_chars > 2000 THEN 'long' END, CASE WHEN d.lang <> 'en' THEN 'non_english' END,
      CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS labels
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
ORDERS_SQL = """recs AS (
  SELECT o.o_orderkey AS id, coalesce(f.labels, []) AS labels, o.o_orderpriority AS severity, o.o_orderstatus AS explicitness
  FROM orders o LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS labels FROM lineitem GROUP BY l_orderkey) f ON o.o_orderkey = f.l_orderkey)"""
EVENTS_SQL = """days AS (
  SELECT user_id || ':' || CAST(ts AS DATE) AS id, list_sort(list(DISTINCT event_type)) AS labels FROM events GROUP BY user_id, CAST(ts AS DATE))"""
UNIFORM = "(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
SCORES_SQL = (
    DOCS_SQL
    + """, long AS (SELECT id, label, CAST(list_contains(labels, label) AS INTEGER) AS y FROM docs, (SELECT unnest(['long', 'non_english', 'quality', 'toxic']) AS label)),
scores AS (SELECT id, label, y, """
    + UNIFORM.format("'score:' || label || ':' || id")
    + """ * 0.65::DOUBLE + y * 0.35::DOUBLE AS proba FROM long)"""
)
