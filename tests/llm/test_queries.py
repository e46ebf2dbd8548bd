"""The registered queries at the smallest size: SQL where there is some, and the pipeline against a brute-force version."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skeinflow.llm import mixing, pii, pu_quality, queries, simhash
from skeinflow.llm.quality_rules import Words
from skeinflow.llm.texts import table

from .test_operators import brute_pii

NAMES = [f"op{n}_" for n in range(1, 14)]


def test_all_are_registered():
    found = entry.queries()
    assert all(sum(q.startswith(n) for q in found) == 1 for n in NAMES) and "pipeline" in found
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_in_sql(spark, sf, tmp_path, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries.QUERIES[name](spark, sf).write.parquet(out := str(tmp_path / "out"))
    frames = [c.sql(q).df() for q in (queries.ORACLE_SQL[name], f"SELECT * FROM '{out}/*.parquet'")]
    a, b = (sorted(map(repr, f[sorted(f.columns)].itertuples(index=False, name=None))) for f in frames)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_one_row_for_each_of_the_table(spark, sf, name):
    base, key = ("pages", "page_id") if name.startswith("op6_") else ("documents", "doc_id")
    got = queries.QUERIES[name](spark, sf)
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in table(spark, sf, base).select(key).collect())


def test_pipeline_stage_by_stage(spark, sf):
    docs, stages = table(spark, sf, "documents"), dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    before = rows(docs)
    model = pu_quality.train(docs, table(spark, sf, "labels"))
    kept = [r for r in before if model.scores(np.array([pu_quality.measure((r[1] or "").encode(), Words())]))[0] >= 0.3]
    one = stages["quality"](spark, docs, sf)
    assert one.columns == corpus_pipeline.COLUMNS and rows(one) == kept

    made = {r[0]: simhash.wide_fingerprint((r[1] or "").encode()) for r in kept}
    as_int, radius = {i: int.from_bytes(p, "little") for i, (p, _, _) in made.items()}, simhash.radius_of(0.8)
    near = lambda a, b: (as_int[a] ^ as_int[b]).bit_count() <= radius

    def grouped(linked):
        root = {i: i for i in made}
        changed = True
        while changed:
            changed = False
            for a in made:
                for b in made:
                    if root[a] != root[b] and linked(a, b):
                        root[a] = root[b] = min(root[a], root[b])
                        changed = True
        return root

    loose = grouped(lambda a, b: near(a, b) and (as_int[a] == as_int[b] or len(set(made[a][1]) & set(made[b][1])) > 1))
    root = grouped(lambda a, b: near(a, b) and loose[a] == loose[b] and (as_int[a] == as_int[b] or simhash.similar(made[a][2], made[b][2], 0.8)))
    kept = [r for r in kept if root[r[0]] == r[0]]
    two = stages["near_dedup"](spark, spark.createDataFrame(rows(one), docs.schema), sf)
    assert rows(two) == kept

    three = stages["personal_data"](spark, spark.createDataFrame(kept, docs.schema), sf)
    weights = pii.fitted()
    clean = sorted(((r[0], t, r[2], r[3], len(t)) for r in kept for t in [pii.redacted(r[1], weights)]), key=repr)
    assert rows(three) == clean and not any(any(brute_pii(r[1]).values()) for r in clean)

    given = spark.createDataFrame(clean, docs.schema)
    taken = {r.doc_id: r for r in mixing.mix(given, ["doc_id"]).collect()}
    times = lambda r: 1 if not taken[r[0]].size else math.ceil(taken[r[0]].taken / taken[r[0]].size)
    mixed = sorted((r for r in clean for _ in range(times(r))), key=repr)
    assert rows(stages["mix"](spark, given, sf)) == mixed

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = sorted((r[0], hashlib.sha256(" ".join(map(str, library.encode(r[1], add_special_tokens=False).ids)).encode()).hexdigest()) for r in mixed)
    five = stages["encode"](spark, spark.createDataFrame(mixed, docs.schema), sf)
    assert sorted((r.doc_id, r.ids_sha256) for r in five.collect()) == want
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()) == want


def odd_rows(spark, docs):
    """Nulls in every column, empty and very long texts, repeated rows, columns with names that operators use."""
    long = "the long river ran down to the old stone house " * 30_000
    rows = [(1, None, None, None, None), (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5), (2, "", "en", None, 0), (3, long, "en", "a", len(long)), (4, "same words here", None, "b", 15), (4, "same words here", None, "b", 15)]
    d = spark.createDataFrame(rows, docs.schema)
    return d.selectExpr("*", *(f"1 AS {c}" for c in ("score", "predicted", "size", "taken", "fp", "print", "least", "row", "times", "ids", "_by", "_h", "_g", "key", "spans")))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, sf, name):
    docs, stage = table(spark, sf, "documents"), dict(corpus_pipeline.STAGES)[name]
    d = odd_rows(spark, docs)
    assert stage(spark, d.where("doc_id < 0"), sf).count() == 0
    got = stage(spark, d, sf)
    found = sorted((r.doc_id or -1 for r in got.collect()))
    if name != "encode":
        assert got.columns == corpus_pipeline.COLUMNS
    if name in ("personal_data", "encode"):
        assert found == [-1, -1, 1, 2, 3, 4, 4]
    if name == "near_dedup":  # 1 and 2 are empty alike; rows without an id stay
        assert found == [-1, -1, 1, 3, 4]
    if name == "mix":  # no words, no sources to weigh: these stay
        assert {1, 2} <= set(found)
    if name == "personal_data":
        assert {r.doc_id: r.text for r in got.collect() if r.doc_id}[1] is None
