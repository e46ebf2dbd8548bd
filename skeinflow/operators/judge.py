"""Verdicts: the prefilter, scored rubrics, the verdict cache, metrics and the feedback table.

A verdict is a code list; REJECT if it isn't empty. Rubrics are untrusted JSON text. Scoring is for texts that neither
the prefilter nor the cache settles, each distinct text once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import RUBRIC
from ..functions.text import cache_key, prefilter_code
from ..sources.shared import settled

LEAST_SCORE = 4
HIGH_RATE = 0.35
#: What each dominant code leads to: action, change of temperature, bound, what to add to the prompt.
ACTIONS = {
    "UNNATURAL_ROBOTIC": ("increase_temperature", 0.1, 1.0, None),
    "TRANSLATIONESE": ("decrease_temperature_and_inject_constraint", -0.05, 0.1, "Avoid literal calques; use natural, colloquial phrasing."),
    "CLINICAL_LEAK": ("strengthen_format_constraints", 0.0, None, "Forbid naming disorders and clinical diagnoses. Do NOT raise temperature."),
}


def prefiltered(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """Adds pre_code (null: passes) and verdict key."""
    return df.withColumns({"pre_code": prefilter_code(F.col(text), **limits), "cache_key": cache_key(F.col(text))})


def rubric_object(raw: Column) -> Column:
    """The text from the first { to the last }, without code fences; empty if there is none."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), "```(?:json)?", "")
    return F.regexp_extract(bare, r"\{[\s\S]*\}", 0)


def ends_once(found: Column) -> Column:
    """Does the object that opens the text end with the text? Lenient parsers leave what follows it aside."""
    braces = F.regexp_replace(F.regexp_replace(found, r'"(?:[^"\\]|\\.)*"', ""), "[^{}]", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends"))
    step = lambda a, c: F.struct((a["depth"] + F.when(c == "{", 1).otherwise(-1)).alias("depth"), (a["ends"] + F.when((c == "}") & (a["depth"] == 1), 1).otherwise(0)).alias("ends"))
    read = F.aggregate(F.filter(F.split(braces, ""), lambda c: c != ""), start, step)
    return (found != "") & (read["ends"] == 1) & (read["depth"] == 0)


def rubric_codes(raw: Column, least: int = LEAST_SCORE, rubric: dict[str, str] = RUBRIC) -> Column:
    """Codes of a rubric in order: GIBBERISH_SHORT alone if it isn't JSON; low, missing or unreadable scores; strict flags."""
    found = rubric_object(raw)
    value = F.try_parse_json(found)
    codes = []
    for dimension, code in rubric.items():
        score = F.try_variant_get(value, f"$.scores.{dimension}", "int")
        codes.append(F.when(score.isNull() | (score < least), code))
    flag = lambda name: F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")) == "BOOLEAN", F.try_variant_get(value, f"$.{name}", "boolean"))
    codes += [F.when(flag("clinical_leak"), "CLINICAL_LEAK"), F.when(~flag("slang_natural"), "SLANG_MISUSE")]
    return F.when(~ends_once(found) | value.isNull(), F.array(F.lit("GIBBERISH_SHORT"))).otherwise(F.array_compact(F.array(*codes)))


def verdict(codes: Column) -> Column:
    return F.when(F.size(codes) > 0, "REJECT").otherwise("ACCEPT")


def rubric_verdicts(df: DataFrame, raw: str = "raw") -> DataFrame:
    out = df.withColumn("codes", rubric_codes(F.col(raw)))
    return out.withColumn("verdict", verdict(F.col("codes")))


def settle(df: DataFrame, cached: DataFrame, score: Callable[[DataFrame], DataFrame], text: str = "text", **limits) -> tuple[DataFrame, DataFrame]:
    """(df with codes and verdict, new rows for the cache). The prefilter comes before the cache, the cache before scoring.

    `score` takes rows (cache_key, text), one for each distinct key that is left, and returns (cache_key, codes). What it
    returns is written before it is used, so it runs once, and verdicts and cache rows are the same. The prefilter runs
    once for each row; of a text that it settles only the key goes on.
    """
    pre = prefiltered(df.select(F.col(text).alias("text")), "text", **limits)
    keys = settled(pre.groupBy("cache_key").agg(F.first("pre_code").alias("pre_code"), F.first(F.when(F.col("pre_code").isNull(), F.col("text"))).alias("text")))
    known = cached.select("cache_key", F.col("codes").alias("cached_codes"))
    rest = keys.where(F.col("pre_code").isNull()).select("cache_key", "text")
    new = settled(score(rest.join(known, "cache_key", "left_anti")).select("cache_key", "codes"))
    met = keys.select("cache_key", "pre_code").join(known, "cache_key", "left").join(new.withColumnRenamed("codes", "scored_codes"), "cache_key", "left")
    codes = F.when(F.col("pre_code").isNotNull(), F.array("pre_code")).otherwise(F.coalesce("cached_codes", "scored_codes"))
    settled_codes = met.select("cache_key", codes.alias("codes"))
    out = df.drop("codes", "verdict").withColumn("cache_key", cache_key(F.col(text))).join(settled_codes, "cache_key").withColumn("verdict", verdict(F.col("codes")))
    return out, new


def filter_metrics(judged: DataFrame, platform: str = "platform", labels: str = "labels") -> DataFrame:
    """(kind, name, n, share_of_total, rate): totals, codes, rejected by label and by platform. One pass: each row gives its own few pairs.

    share_of_total divides by all rows; rate by the rows of that label or platform.
    """
    rejected = F.col("verdict") == "REJECT"
    one = lambda kind, name, hit: F.struct(F.lit(kind).alias("kind"), name.alias("name"), hit.cast("long").alias("hit"))
    codes = F.transform(F.coalesce("codes", F.array().cast("array<string>")), lambda c: one("code", c, F.lit(1)))
    by_label = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda c: one("label", c, rejected))
    fixed = F.array(one("total", F.lit("generated"), F.lit(1)), one("total", F.lit("accepted"), ~rejected), one("total", F.lit("rejected"), rejected), one("platform", F.coalesce(F.col(platform), F.lit("unknown")), rejected))
    rows = judged.select(F.explode(F.concat(fixed, codes, by_label)).alias("p")).select("p.*").groupBy("kind", "name").agg(F.sum("hit").alias("n"), F.count("*").alias("of"))
    total = judged.agg(F.count("*").alias("total"))
    share = F.try_divide(F.col("n").cast("double"), F.col("total").cast("double"))
    return rows.withColumn("total", total.scalar()).select("kind", "name", "n", F.round(share, 6).alias("share_of_total"), F.round(F.col("n") / F.col("of"), 6).alias("rate"))


def dominant_code(judged: DataFrame, seq: str = "id") -> DataFrame:
    """The most frequent code; on ties the one that came first."""
    counted = judged.select(seq, F.posexplode("codes").alias("at", "code")).groupBy("code").agg(F.count("*").alias("n"), F.min(F.struct(seq, "at")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(1).select("code", "n")


def feedback(judged: DataFrame, temperature: float, seq: str = "id") -> DataFrame:
    """One row: rejection_rate, dominant_code, action, recommended_temperature, prompt_injection."""
    total = judged.agg(F.coalesce(F.try_divide(F.count_if(F.col("verdict") == "REJECT").cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("rate"))
    one = total.withColumn("code", dominant_code(judged, seq).select("code").scalar())
    high = F.col("code").isNotNull() & (F.col("rate") > HIGH_RATE)
    action, to, add = F.lit("none"), F.lit(float(temperature)), F.lit(None).cast("string")
    for code, (name, change, bound, more) in ACTIONS.items():
        hit = high & (F.col("code") == code)
        new = temperature + change
        new = min(new, bound) if change > 0 else max(new, bound) if change < 0 else temperature
        action, to, add = F.when(hit, name).otherwise(action), F.when(hit, round(new, 2)).otherwise(to), F.when(hit, F.lit(more)).otherwise(add)
    return one.select(F.round("rate", 6).alias("rejection_rate"), F.col("code").alias("dominant_code"), action.alias("action"), to.alias("recommended_temperature"), add.alias("prompt_injection"))
