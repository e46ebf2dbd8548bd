"""Seeded synthetic records: scenario plans and rows from word banks, in any number, made where they are needed.

Every choice is a function of the seed and the row's number, so rows can be made again anywhere and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.text import hash_uniform, matched_terms, pick, weighted_pick

#: Share of each type, its severities, explicitness, slang levels, and the chance of a military context.
TYPES = {
    "positive_clear": (0.35, ["medium", "strong", "strong"], ["explicit", "behavioral", "behavioral"], ["low", "medium", "high"], 0.75),
    "implicit": (0.25, ["mild", "medium"], ["implicit"], ["medium", "high"], 0.70),
    "hard_negative": (0.25, ["mild", "medium"], ["explicit", "behavioral"], ["low", "medium", "high"], 1.0),
    "ambiguous": (0.15, ["mild"], ["implicit"], ["medium", "high"], 0.60),
}


def _by_type(kind: Column, of) -> Column:
    out = None
    for name in TYPES:
        out = F.when(kind == name, of(name)) if out is None else out.when(kind == name, of(name))
    return out


def label_set(*seed: Column) -> Column:
    bank = F.array(*(F.array(*map(F.lit, s)) for s in lex.LABEL_SETS))
    return F.element_at(bank, weighted_pick(lex.LABEL_SETS, lex.LABEL_SET_WEIGHTS, *seed) + 1)


def scenarios(spark: SparkSession, n: int, seed: str = "plan-1") -> DataFrame:
    """n scenarios in seeded order: types by their shares exactly, everything else by seeded choice."""
    rows = spark.range(n).withColumnRenamed("id", "row")
    at, edge, kind = F.col("row") / F.lit(float(max(1, n))), 0.0, None
    for name, (share, *_) in TYPES.items():
        edge += share
        kind = F.when(at < edge - 1e-12, name) if kind is None else kind.when(at < edge - 1e-12, name)
    rows = rows.withColumn("example_type", kind.otherwise(list(TYPES)[-1]))
    key = lambda salt: (F.lit(seed), F.lit(salt), F.col("row"))
    none = F.array().cast("array<string>")
    empty = (F.col("example_type") == "hard_negative") | (F.col("example_type") == "ambiguous") & (hash_uniform(*key("has")) <= 0.4)
    return rows.select(
        "row", "example_type", F.when(empty, none).otherwise(label_set(*key("labels"))).alias("labels"), pick(lex.PLATFORMS, *key("platform")).alias("platform"),
        _by_type(F.col("example_type"), lambda t: pick(TYPES[t][2], *key("explicitness"))).alias("explicitness"), _by_type(F.col("example_type"), lambda t: pick(TYPES[t][1], *key("severity"))).alias("severity"),
        _by_type(F.col("example_type"), lambda t: pick(TYPES[t][3], *key("slang"))).alias("slang_level"), _by_type(F.col("example_type"), lambda t: hash_uniform(*key("context")) < TYPES[t][4]).alias("military_context"),
    )


def sampled(bank: list[str], k: int, *seed: Column) -> Column:
    """k of the bank without replacement, in seeded order."""
    ordered = F.array_sort(F.transform(F.array(*map(F.lit, bank)), lambda x: F.struct(F.md5(F.concat_ws(":", *(s.cast("string") for s in seed), x)).alias("o"), x.alias("x"))))
    return F.transform(F.slice(ordered, 1, k), lambda s: s["x"])


def composed(plan: DataFrame, openers: list[str], behaviours: dict[str, list[str]], tails: list[str], seed: str = "text-1") -> DataFrame:
    """Records from scenarios: an opener, one behaviour for each of the first two labels (or any), and a tail."""
    key = lambda salt: (F.lit(seed), F.lit(salt), F.col("row"))
    banks = F.create_map(*(x for k, v in behaviours.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    every = [x for v in behaviours.values() for x in v]

    def said(label: Column) -> Column:
        bank = F.coalesce(F.try_element_at(banks, label), F.array(*map(F.lit, every)))
        return F.element_at(bank, (F.floor(hash_uniform(*key("said"), label) * F.size(bank)) + 1).cast("int"))

    middle = F.when(F.size("labels") > 0, F.transform(F.slice("labels", 1, 2), said)).otherwise(F.array(pick(every, *key("any"))))
    text = F.concat(pick(openers, *key("opener")), F.lit(" "), F.array_join(middle, ", "), F.lit(", "), pick(tails, *key("tail")), F.lit("."))
    made = plan.withColumn("text", text).withColumn("slang_used", matched_terms(F.col("text"), lex.SLANG)).withColumn("synthetic", F.lit(True))
    return made.withColumn("id", F.format_string("syn_%04d", "row"))


def canned(bank: list[str], prompt: Column) -> Column:
    """The stand-in for a remote text source: one of the bank, by the prompt's hash."""
    return F.element_at(F.array(*map(F.lit, bank)), (F.pmod(F.xxhash64(prompt), F.lit(len(bank))) + 1).cast("int"))
