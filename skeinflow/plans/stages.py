"""The stage registry: filter, profile, split, evaluate, report over a records path, each rerunnable on its own.

    python -m skeinflow.plans.stages --input records.parquet --out folder --stages filter,profile,split,evaluate,report
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, judge, labels, model, split
from ..sources import tables as io
from ..sources.shared import settled
from . import report

#: The share of the train fold that thresholds are tuned on, and the seed that draws it.
VALIDATION, VALIDATION_SEED = 0.15, 7
LIMITS = {"target": "[A-Za-z]", "foreign": r"[^\x00-\x7F]"}


def accept_all(rows: DataFrame) -> DataFrame:
    """The stand-in scorer: texts that reach it have no codes."""
    return rows.select("cache_key", F.array().cast("array<string>").alias("codes"))


def filter_stage(spark: SparkSession, source: str, out: str, score=accept_all, **limits) -> None:
    records = io.read_records(spark, source)
    judged, new = judge.settle(records, io.read_cache(spark, f"{out}/cache"), score, **limits)
    io.write_records(judged, f"{out}/judged")
    io.upsert_cache(new, f"{out}/cache")
    done = spark.read.parquet(f"{out}/judged")
    io.write_clean(done, f"{out}/clean")
    io.write_artifact(spark, io.artifact(judge.filter_metrics(done), 6), f"{out}/quality_metrics.json")
    io.write_artifact(spark, io.artifact(judge.feedback(done, 0.75)), f"{out}/feedback.json")


def profile_stage(spark: SparkSession, source: str, out: str) -> None:
    records, _ = io.read_first(spark, f"{out}/clean", source)
    for name, table in report.tables(records).items():
        io.write_artifact(spark, io.artifact(table, 6), f"{out}/tables/{name}.json")


def split_stage(spark: SparkSession, source: str, out: str, check: bool = True) -> None:
    records, _ = io.read_first(spark, f"{out}/clean", source)
    folded = split.stratified_split(records, greedy=True)
    if check:  # before anything is written
        split.check_gates(folded)
    io.write_folds(records.join(folded.select("id", "fold"), "id"), f"{out}/folds")
    io.write_artifact(spark, split.full_manifest(folded), f"{out}/split_manifest.json")


def evaluate_stage(spark: SparkSession, source: str, out: str, max_iter: int = 1000, load: Callable | None = None) -> None:
    """Fitted on the train fold less a validation part of it, thresholds tuned on that part; metrics of train, validation and
    test fold, and of the zero-shot model that `load` gives (without it the seeded stand-in) on the test fold, none if it can't be loaded."""
    rows = spark.read.parquet(f"{out}/folds")
    carved = split.random_split(rows.where("fold = 'train'"), VALIDATION, VALIDATION_SEED, True)
    held = carved.where("fold = 'test'").select("id")
    train = rows.where("fold = 'train'").join(held, "id", "left_anti")
    names = [r[0] for r in labels.classes(train).orderBy("label").collect()]
    n = train.count()
    known = settled(features.vocabulary(train, n))  # unseen texts are transformed by what the fitted ones have
    weights = features.tfidf(rows, fitted=known, n_rows=n)
    vocab = io_index(known)
    scores = settled(model.one_vs_rest(model.cells(weights, vocab, rows), rows, names, max(1, vocab.count()), max_iter=max_iter, fit_on=train))
    tuned = settled(model.threshold_search(scores.join(held, "id")).select("label", "threshold"))
    test = rows.where("fold = 'test'")
    found = {f"tfidf_{part}": model.metrics(scores.join(ids.select("id"), "id"), tuned) for part, ids in (("train", train), ("val", held), ("test", test))}
    if zero_shot := zero_shot_metrics(test, names, load):
        found["zeroshot_test"] = zero_shot
    io.write_artifact(spark, io.artifact(model.comparison(found), 6), f"{out}/eval_results.json")


def zero_shot_metrics(test: DataFrame, names: list[str], load: Callable | None) -> DataFrame | None:
    found = settled(model.zero_shot(test, names, load=load).where("score IS NOT NULL").select("id", "label", F.col("score").alias("proba")))
    y = test.select("id", F.col("labels").alias("_labels"))
    scored = found.join(y, "id").select("id", "label", F.array_contains("_labels", F.col("label")).cast("int").alias("y"), "proba")
    return None if found.isEmpty() else model.metrics(scored)


def io_index(weights: DataFrame) -> DataFrame:
    """(term, at): terms numbered from 0 in order."""
    from ..operators.curate import numbered

    return numbered(weights.select("term").distinct(), "term", "%d", "at").withColumn("at", F.col("at").cast("int"))


def report_stage(spark: SparkSession, source: str, out: str) -> None:
    found = io.read_artifacts(spark, {k: f"{out}/{k}.json" for k in ("quality_metrics", "split_manifest")})
    totals = {r["name"]: r["n"] for r in found["quality_metrics"] if r["kind"] == "total"}
    records, _ = io.read_first(spark, f"{out}/clean", source)
    edges = report.extremes(labels.marginals(records)).first().asDict()
    codes = {r["name"]: r["n"] for r in found["quality_metrics"] if r["kind"] == "code"}
    results = io.read_artifacts(spark, {"eval": f"{out}/eval_results.json"})["eval"] if io.exists(spark, f"{out}/eval_results.json") else []
    text = report.summary(totals, edges, found["split_manifest"], labels.mean_cardinality(records).first()[0] or 0.0, codes, results)
    io.write_artifact(spark, text, f"{out}/summary.md")


STAGES = {"filter": filter_stage, "profile": profile_stage, "split": split_stage, "evaluate": evaluate_stage, "report": report_stage}


def run(spark: SparkSession, source: str, out: str, names: list[str] | None = None, **limits) -> None:
    for name in names or list(STAGES):
        STAGES[name](spark, source, out, **(limits if name == "filter" else {}))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--stages", default=",".join(STAGES))
    said = parser.parse_args()
    run(SparkSession.builder.getOrCreate(), said.input, said.out, said.stages.split(","))


if __name__ == "__main__":
    main()
