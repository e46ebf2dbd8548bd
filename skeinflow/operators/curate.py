"""Curation: first of equal texts, caps by opening words, quotas by type, and seeded choice.

Rows have no order of their own, so each operator takes the column that says which came first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_words, normal_key
from ..sources.shared import settled


def dedup_first(df: DataFrame, text: str = "text", seq: str = "id") -> DataFrame:
    """The first row of each normalised text; rows without `seq` come last, and of rows of equal `seq` one stays.

    The first row is aggregated before the shuffle, so a text that is everywhere isn't gathered.
    """
    place = F.struct(F.col(seq).isNull(), F.col(seq), F.xxhash64(*df.columns))
    keyed = df.select(F.sha2(normal_key(F.col(text)), 256).alias("_norm"), place.alias("_place"), F.struct(*df.columns).alias("_row"))
    return keyed.groupBy("_norm").agg(F.min_by("_row", "_place").alias("_row")).select("_row.*")


def capped(df: DataFrame, by, cap: int, seq: str = "id", name: str = "_rank") -> DataFrame:
    """At most `cap` rows of each group, the first ones. Spark keeps only that many of a group in each task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(seq))).where(F.col(name) <= cap).drop(name)


def prefix_cap(df: DataFrame, cap: int, text: str = "text", seq: str = "id", n_words: int = 3) -> DataFrame:
    return capped(df, first_words(F.col(text), n_words), cap, seq)


def first_good(df: DataFrame, score: str, target: int, least: float = 0.5, text: str = "text", seq: str = "id") -> DataFrame:
    """The first `target` rows of new texts that score `least` or more: what a loop gets that takes rows until it has enough. Spark keeps only that many in each task."""
    return dedup_first(df.where(F.col(score) >= least), text, seq).orderBy(seq).limit(target)


def type_quota(df: DataFrame, quota: int, kind: str, seq: str = "id") -> DataFrame:
    return capped(df, F.col(kind), quota, seq)


def curate(df: DataFrame, quotas: dict[str, int], cap: int, kind: str = "example_type", text: str = "text", seq: str = "id") -> DataFrame:
    """Types in order: each type's texts must be new, keep the cap over all types so far, and stop at the type's quota.

    Each type's rows are settled, and of the types before only keys and counts are read again, so plans don't grow with the number of types.
    """
    keyed = df.withColumns({"_norm": F.sha2(normal_key(F.col(text)), 256), "_prefix": first_words(F.col(text))})
    taken: list[DataFrame] = []
    for name, quota in quotas.items():
        new = dedup_first(keyed.where(F.col(kind) == name), text, seq)
        taken.append(settled(admitted(new, taken, quota, cap, seq)))
    return reduce(DataFrame.unionByName, taken).drop("_norm", "_prefix")


def admitted(new: DataFrame, taken: list[DataFrame], quota: int | None, cap: int, seq: str) -> DataFrame:
    """The first `quota` rows (or all) of `new` (of different _norm) whose _norm isn't taken and whose _prefix keeps the cap, taken rows included.

    Joins are by sorting: what was taken grows with the quotas, and a broadcast of it would go through the driver.
    """
    before = reduce(DataFrame.unionByName, (t.select("_norm", "_prefix") for t in taken)) if taken else None
    if taken:
        new = new.join(before.select("_norm").hint("merge"), "_norm", "left_anti")
    # the bare limit lets Spark keep no more than the cap of a prefix in each task
    ranked = new.withColumn("_at", F.row_number().over(Window.partitionBy("_prefix").orderBy(seq))).where(F.col("_at") <= cap)
    if taken:  # at most the cap of a prefix meets its count
        ranked = ranked.join(before.groupBy("_prefix").agg(F.count("*").alias("_used")).hint("merge"), "_prefix", "left")
    used = F.coalesce(F.col("_used"), F.lit(0)) if taken else F.lit(0)
    within = ranked.where(F.col("_at") + used <= cap).drop("_at", "_used")
    return within if quota is None else first_rows(within, quota, seq)


def first_rows(df: DataFrame, n: int, seq: str, gathered: int = 100_000) -> DataFrame:
    """The first n rows by `seq` (of different values): up to `gathered` by one task, more by their places within ranges."""
    if n <= gathered:
        return df.orderBy(seq).limit(n)
    return numbered(df, seq, "%d", "_place").where(F.col("_place").cast("long") < n).drop("_place")


def numbered(df: DataFrame, seq: str = "id", form: str = "syn_%04d", name: str = "row_id") -> DataFrame:
    """Ids in order of `seq` without one task that sees all rows: places within ranges, added to the rows of the ranges before."""
    drawn = settled(df.repartitionByRange(F.col(seq)).withColumn("_range", F.spark_partition_id()))  # ranges are drawn by sampling: once
    ranged = drawn.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(seq)))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(before, F.col("_range") == F.col("_r")).withColumn(name, F.format_string(form, F.col("_before") + F.col("_at") - 1)).drop("_range", "_at", "_r", "_before")
