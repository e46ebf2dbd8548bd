"""Prompt texts as columns: sections that are empty for a row leave no gap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def readable(label: Column) -> Column:
    return F.replace(label, F.lit("_"), F.lit(" "))


def section(title: str, body: Column) -> Column:
    """A titled section; null where the body is null or empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), body))


def sections(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def generation_prompt(labels: Column, platform: Column, severity: Column, explicitness: Column, examples: Column | None = None) -> Column:
    """What a text source is asked for: the labels to show, the register, and up to three examples."""
    shown = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("- "), readable(x))), "\n")
    form = F.format_string("Write one short first-person message for %s. Severity: %s. Expression: %s.", platform, severity, explicitness)
    few = F.array_join(F.slice(examples, 1, 3), "\n---\n") if examples is not None else F.lit(None).cast("string")
    return sections(section("Task", form), section("Show these without naming them", shown), section("Examples", few), section("Format", F.lit("Output only the message.")))


def judge_prompt(text: Column, labels: Column, platform: Column) -> Column:
    """What a judge is asked for: a JSON object of five scores and two flags."""
    wanted = '{"reasoning": "...", "scores": {"naturalness": 1-5, "idiomaticity": 1-5, "register_fit": 1-5, "label_grounding": 1-5, "coherence": 1-5}, "clinical_leak": true|false, "slang_natural": true|false}'
    return sections(section("Text", text), section("Platform", platform), section("Labels", F.array_join(labels, ", ")), section("Answer with", F.lit(wanted)))
