"""Records made until each type has its quota, in waves that a rerun takes up where the last one stopped.

What a loop does that makes one record after another is done for ranges of attempts: a wave is sized by what is still lacking and by the
share of attempts that were accepted so far; its records pass the gate, must be of a new text and keep the cap of their opening words,
those of all waves and types before included, and the first of them that are still wanted stay. An attempt is a function of type and
number alone, so the rows are those of the loop whatever the waves' sizes. A type ends with its quota or after `most` times as many attempts.

Each wave is written before a version of the progress log names it, which is put in place in one step. A rerun reads the last
version, makes only what is missing, and overwrites a wave that was written but not named.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_words, normal_key
from ..operators.curate import admitted, dedup_first, numbered
from .shared import settled
from .tables import commit, latest

MOST = 8


def first_admitted(rows: DataFrame, taken: list[DataFrame], quota: int, cap: int, seq: str) -> DataFrame:
    """As a loop over rows in order of `seq` takes them: new texts within the cap, up to the quota.

    A text that comes again with other opening words (in other letters) has another chance if its first one is beyond the cap:
    such first ones are taken out until none of them has a later one. Joins are by sorting, as in `admitted`.
    """
    twice = rows.groupBy("_norm").agg(F.min("_prefix").alias("p"), F.max("_prefix").alias("q")).where("p <> q").select("_norm")
    again = settled(rows.join(twice.hint("merge"), "_norm", "left_semi").groupBy("_norm", "_prefix").agg(F.min(seq).alias(seq)))
    if not again.isEmpty():  # of equal texts of equal opening words only the first has a chance
        rows = settled(rows.join(twice.hint("merge"), "_norm", "left_anti").unionByName(rows.join(again.select(seq).hint("merge"), seq, "left_semi")))
    while not again.isEmpty():
        first = dedup_first(rows, "text", seq)
        beyond = first.join(admitted(first, taken, None, cap, seq).select(seq).hint("merge"), seq, "left_anti").select(seq, "_norm")
        gone = settled(beyond.join(again.groupBy("_norm").agg(F.max(seq).alias("_last")).hint("merge"), "_norm").where(F.col(seq) < F.col("_last")).select(seq))
        if gone.isEmpty():
            break
        rows = settled(rows.join(gone.hint("merge"), seq, "left_anti"))
    return admitted(dedup_first(rows, "text", seq), taken, quota, cap, seq)


def generate(spark: SparkSession, out: str, quotas: dict[str, int], make: Callable[[DataFrame], DataFrame], gate: Column, cap: int, most: int = MOST, form: str = "syn_%04d") -> DataFrame:
    """(id, example_type, attempt, and what `make` adds). make(rows of example_type and attempt) gives rows with a `text`."""
    _, waves = latest(spark, f"{out}/_log")
    waves = waves or []
    read = lambda w: spark.read.parquet(f"{out}/waves/{w['wave']}")
    for kind, quota in quotas.items():
        mine = [w for w in waves if w["kind"] == kind]
        got, done = sum(w["kept"] for w in mine), max((w["to"] for w in mine), default=0)
        while got < quota and done < most * quota:
            rate = max(got / done, 1 / most) if done else 1.0
            upto = min(done + max(1, math.ceil(1.1 * (quota - got) / rate)), most * quota)
            made = make(spark.range(done, upto).select(F.lit(kind).alias("example_type"), F.col("id").alias("attempt"))).where(gate)
            keyed = settled(made.withColumns({"_norm": F.sha2(normal_key(F.col("text")), 256), "_prefix": first_words(F.col("text"))}))
            path = f"{out}/waves/{len(waves)}"
            first_admitted(keyed, [read(w) for w in waves], quota - got, cap, "attempt").write.mode("overwrite").parquet(path)
            kept = spark.read.parquet(path).count()
            waves.append({"wave": len(waves), "kind": kind, "from": done, "to": upto, "kept": kept})
            if not commit(spark, f"{out}/_log", len(waves), waves):
                raise RuntimeError(f"another run is generating into {out}")
            got, done = got + kept, upto
    place = F.lit(0)
    for i, kind in enumerate(quotas):
        place = F.when(F.col("example_type") == kind, i).otherwise(place)
    rows = reduce(DataFrame.unionByName, map(read, waves)).drop("_norm", "_prefix")
    return numbered(rows.withColumn("_seq", F.format_string("%06d-%018d", place, F.col("attempt"))), "_seq", form, "id").drop("_seq")
