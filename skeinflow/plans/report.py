"""Reports: the tables behind each chart, and a short Markdown summary of one-row artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import labels, profile
from ..operators.labels import without_synthetic

#: The tables of a profile, by name: what the charts of a report show.
TABLES = {
    "label_marginals": "Records by label.",
    "label_cooccurrence": "Records that hold both labels.",
    "label_correlation": "Correlation of label indicators.",
    "label_cardinality": "Records by number of labels.",
    "length_by_platform": "Word counts by platform.",
    "platform_x_type": "Records by platform and type.",
    "severity_x_label": "Records by severity and label.",
    "explicitness_x_label": "Records by explicitness and label.",
    "slang_top20": "The most frequent slang terms.",
}


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """All tables of a profile over records; nothing runs until one is read."""
    return {
        "label_marginals": labels.marginals(records),
        "label_cooccurrence": labels.cooccurrence(records),
        "label_correlation": labels.phi(records),
        "label_cardinality": labels.cardinality_histogram(records),
        "length_by_platform": profile.length_by_group(records, "platform"),
        "platform_x_type": profile.crosstab(records, "platform", "example_type"),
        "severity_x_label": labels.by_category(records, "severity", ["mild", "medium", "strong"]),
        "explicitness_x_label": labels.by_category(records, "explicitness"),
        "slang_top20": profile.top_tokens(records, F.col("slang_used")),
    }


def extremes(marginals: DataFrame) -> DataFrame:
    """One row: the rarest and the most frequent label with their counts, synthetic labels aside."""
    real = without_synthetic(marginals)
    return real.agg(F.min_by("label", F.struct("n", F.col("label"))).alias("rarest_label"), F.min("n").alias("rarest_n"), F.max_by("label", F.struct("n", F.col("label"))).alias("top_label"), F.max("n").alias("top_n"), F.count("*").alias("n_labels"))


def summary(counts: dict, edges: dict, manifest: dict, mean_cardinality: float, codes: dict | None = None, results: list[dict] | None = None) -> str:
    """Markdown of the curated set: how much was kept and why not, its labels, its split by label, and the models' results."""
    kept = 100 * counts["accepted"] / max(counts["generated"], 1)
    lines = [
        "# Curated dataset",
        "",
        f"- Records: {counts['accepted']} of {counts['generated']} kept ({kept:.1f} %)",
        f"- Labels: {edges['n_labels']}, {mean_cardinality:.2f} a record on average",
        f"- Rarest: {edges['rarest_label'] or 'N/A'} ({edges['rarest_n'] or 0}); most frequent: {edges['top_label'] or 'N/A'} ({edges['top_n'] or 0})",
        f"- Split: {manifest['n_train']} train, {manifest['n_test']} test (seed {manifest['seed']}), divergence {manifest['js']:.4f}",
    ]
    if "stratifier" in manifest:
        lines.append(f"- Stratified by {manifest['stratifier']} (version {manifest['version']}); records without labels count as {manifest['neg_class_used_for_stratification']}")
    if codes:
        lines += ["", "## Why records were rejected", "", "| Code | Records |", "| --- | --- |", *(f"| {k} | {n} |" for k, n in sorted(codes.items(), key=lambda x: (-x[1], x[0])))]
    if manifest.get("per_label_ratios"):
        lines += ["", "## Labels by fold", "", "| Label | Total | Train | Test | Train share |", "| --- | --- | --- | --- | --- |"]
        lines += [f"| {k} | {r['total']} | {r['train']} | {r['test']} | {r['train_share']:.2f} |" for k, r in manifest["per_label_ratios"].items()]
    if results:
        names = sorted({r["metric"] for r in results})
        value = {(r["model"], r["metric"]): r["value"] for r in results}
        lines += ["", "## Models", "", f"| Model | {' | '.join(names)} |", "| --- " * (len(names) + 1) + "|"]
        lines += [f"| {m} | {' | '.join(f'{value[m, n]:.4f}' for n in names)} |" for m in dict.fromkeys(r["model"] for r in results)]
    return "\n".join(lines) + "\n"


def captions() -> str:
    return "\n".join(["| Table | Shows |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in TABLES.items())]) + "\n"
