"""Profiles: category counts, crosstabs, length statistics and token frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_count, word_count


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of several columns in one pass; nulls are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")
    return df.select(pairs).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows by the values of two columns, dense, in long form."""
    counted = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    dense = counted.select(a).distinct().withColumn(b, F.explode(counted.agg(F.collect_set(b)).scalar()))  # values by values, not rows
    return dense.join(counted, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    return df.groupBy(a).pivot(b, values).count().na.fill(0)


def length_by_group(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Exact median, quartiles and deviation of word counts by group."""
    n = word_count(F.col(text))
    return df.where(F.col(group).isNotNull()).select(group, n.alias("_n")).groupBy(group).agg(
        F.count("*").alias("n"), F.percentile("_n", 0.5).alias("median_words"), F.percentile("_n", 0.25).alias("q25_words"), F.percentile("_n", 0.75).alias("q75_words"), F.round(F.stddev_samp("_n"), 6).alias("std_words"),
    )


def length_flags(df: DataFrame, group: str, text: str = "text", least_median: float = 8, least_std: float = 3) -> DataFrame:
    """Groups whose texts are short or all alike in length; one row alone has no deviation and isn't flagged for it."""
    by = length_by_group(df, group, text)
    return by.select(group, (F.col("median_words") < least_median).alias("short"), F.coalesce(F.col("std_words") < least_std, F.lit(False)).alias("uniform"))


def describe(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(measure, count, mean, std, min, q25, q50, q75, max), a row for each."""
    session = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), c.cast("double").alias("x")) for k, c in measures.items()))).alias("m")).select("m.*")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = session.groupBy("measure").agg(F.count("x").alias("count"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("min"), q.alias("q"), F.max("x").alias("max"))
    return out.select("measure", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def text_lengths(text: str = "text") -> dict[str, Column]:
    return {"word_count": word_count(F.col(text)), "char_count": char_count(F.col(text))}


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def top_tokens(df: DataFrame, tokens: Column, k: int = 20) -> DataFrame:
    """The k most frequent tokens; ties by token."""
    return token_counts(df, tokens).orderBy(F.desc("n"), "token").limit(k)


def coverage(df: DataFrame, tokens: Column) -> DataFrame:
    """Share of rows with a token."""
    return df.agg(F.avg(F.when(F.size(tokens) > 0, 1.0).otherwise(0.0)).alias("coverage"))
