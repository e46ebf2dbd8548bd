"""The corpus pipeline: five stages over `documents`, each of which works on all that the one before it kept.

Quality classifier (documents that it rejects go), SimHash near-dedup (groups of a similarity of 0.8 or more of five-word shingles; of
each the document of least id stays), personal data (replaced by its kind in angle brackets), mixing sources to target weights (a document that
the mix takes no word of goes, one that it takes more than once stands once for each pass and part of a pass), and BPE
encoding. Each stage's result is written as Parquet to the folder that the cluster shares, and read again as the next
stage's documents. All but the last return the columns of documents; n_chars follows the text.

Null texts are kept as null by all stages but the last, for which they are empty. Rows repeat as the mix asks for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm import bpe, mixing, pii, pu_quality, simhash
from skeinflow.llm.cuts import shared_folder
from skeinflow.llm.texts import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the model is fitted on the training folds of these documents."""
    model = pu_quality.train(docs, table(spark, sf_dir, "labels"))
    return pu_quality.score(docs, model, COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of least id, and of its rows with that id the first by text. Rows without an id stay."""
    # fingerprints and components carry ids only; the texts are dealt once, for the join and the group alike
    found = simhash.similar_groups(docs, ["doc_id"])
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    rows = docs.join(stay, F.col("doc_id") == F.col("_stay"), "left_semi")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return one.select("doc_id", "row.*").select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind."""
    made = pii.redact(docs, [c for c in COLUMNS if c not in ("text", "n_chars")], name="text")
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes words of it, parts of a pass counted as one; documents of no words stay."""
    # the mix sees a key of each row, not its text; rows alike in all columns are one key, and their passes add up
    own = [F.struct(*COLUMNS), F.xxhash64(F.lit("mix"), *COLUMNS).alias("_h")]
    keyed = docs.select(own[0].alias("row"), F.xxhash64(*COLUMNS).alias("_g"), own[1])
    taken = mixing.mix(docs.select("doc_id", "text", "source", F.xxhash64(*COLUMNS).alias("_g"), own[1]), ["_g", "_h"])
    passes = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))).cast("int")
    times = taken.groupBy(F.col("_g").alias("g"), F.col("_h").alias("h")).agg(F.sum(passes).cast("int").alias("times")).where("times > 0")
    rows = keyed.groupBy("_g", "_h").agg(F.first("row").alias("row"))
    met = rows.join(times, (F.col("_g") == F.col("g")) & (F.col("_h") == F.col("h")))
    return met.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("_")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text that they decode to."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix", mix), ("encode", encode)]

#: SQL cannot express the classifier, the fingerprints, the span model or the encoder; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. The last one's result is returned unwritten."""
    docs = table(spark, sf_dir, "documents")
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
