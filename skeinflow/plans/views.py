"""Operators from SQL: each bound query as a temporary view."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from .queries import QUERIES


def register(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> list[str]:
    """Registers the named queries (or all) over the tables in sf_dir; views run when they are read."""
    done = list(names) if names is not None else list(QUERIES)
    for name in done:
        QUERIES[name](spark, sf_dir).createOrReplaceTempView(name)
    return done
