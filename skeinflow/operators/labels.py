"""Statistics of label sets: records are rows with an id and an array of distinct labels; null counts as empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_count


def exploded(records: DataFrame, *others: str, id: str = "id", labels: str = "labels") -> DataFrame:
    """One row for each record and label."""
    return records.select(id, *others, F.explode(labels).alias("label"))


def marginals(records: DataFrame) -> DataFrame:
    """Records by label, most first, ties by name."""
    return records.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def sparse_labels(records: DataFrame, most: int = 6) -> DataFrame:
    return marginals(records).where(F.col("n") <= most)


def pairs_within(records: DataFrame) -> DataFrame:
    """Ordered pairs of labels in the same record, equal ones too: the pairs of a record stay within its row, nothing is joined."""
    return records.select(F.explode("labels").alias("a"), "labels").select("a", F.explode("labels").alias("b"))


def classes(records: DataFrame) -> DataFrame:
    return records.select(F.explode("labels").alias("label")).distinct()


def cooccurrence(records: DataFrame) -> DataFrame:
    """Records that hold both labels, for every pair of classes, zero where they never meet; the diagonal holds the marginals."""
    counted = pairs_within(records).groupBy("a", "b").agg(F.count("*").alias("n"))
    diagonal = counted.where("a = b").select("a")
    dense = diagonal.withColumn("b", F.explode(diagonal.agg(F.collect_set("a")).scalar()))  # classes by classes, not rows
    return dense.join(counted, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def phi(records: DataFrame) -> DataFrame:
    """Correlation of every two labels' indicators, from counts alone; null where one of them never varies."""
    joint = cooccurrence(records)
    single = joint.where("a = b").select(F.col("a").alias("label"), F.col("n").alias("m"))
    total = records.agg(F.count("*").alias("total"))
    met = joint.join(single.select(F.col("label").alias("a"), F.col("m").alias("n_a")), "a").join(single.select(F.col("label").alias("b"), F.col("m").alias("n_b")), "b").withColumn("total", total.scalar())
    x = {c: F.col(c).cast("double") for c in ("n", "n_a", "n_b", "total")}
    spread = F.sqrt(x["n_a"] * (x["total"] - x["n_a"]) * x["n_b"] * (x["total"] - x["n_b"]))
    return met.select("a", "b", F.try_divide(x["total"] * x["n"] - x["n_a"] * x["n_b"], spread).alias("phi"))


def cardinality_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy(label_count(F.col("labels")).alias("n_labels")).agg(F.count("*").alias("n")).orderBy("n_labels")


def mean_cardinality(records: DataFrame) -> DataFrame:
    return records.agg(F.avg(label_count(F.col("labels"))).alias("mean_cardinality"))


def by_category(records: DataFrame, category: str, values: list[str] | None = None) -> DataFrame:
    """Records by category and label, dense: all classes against `values`, or else against the values that occur."""
    counted = exploded(records, category).where(F.col(category).isNotNull()).groupBy(category, "label").agg(F.count("*").alias("n"))
    bank = F.array(*map(F.lit, values)) if values else records.where(F.col(category).isNotNull()).agg(F.collect_set(category)).scalar()
    dense = classes(records).withColumn(category, F.explode(bank))  # categories by classes, not rows
    return dense.join(counted, [category, "label"], "left").select(category, "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def indicators(records: DataFrame, names: list[str], *others: str) -> DataFrame:
    """One 0/1 column for each of the named classes; other labels are left out."""
    return records.select("id", *others, *(F.coalesce(F.array_contains("labels", n), F.lit(False)).cast("int").alias(n) for n in names))


#: Fixed value: the class of records without labels.
NEGATIVE = "__NEG__"


def with_negative(records: DataFrame, name: str = NEGATIVE) -> DataFrame:
    """An empty label set becomes a class of its own, for stratifying only."""
    return records.withColumn("labels", F.when(label_count(F.col("labels")) == 0, F.array(F.lit(name))).otherwise(F.col("labels")))


def without_synthetic(labelled: DataFrame, column: str = "label") -> DataFrame:
    return labelled.where(~F.col(column).startswith("__"))
