"""Quota-driven generation against a loop, reruns of both, the cache's versions, and the index of a large lexicon."""

import random

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import curate
from skeinflow.operators.lexicon import lexicon_matches
from skeinflow.sources import generate as gen
from skeinflow.sources import tables as io

BANK = ["Such a day it was", "such a day it was", "Such a  day it was", "One more night again", "One more night alone", "One more night gone", "no", "Not much to say here", "Here we go again now", "SUCH a day it was", "Long ago there was rain", "Long ago there was snow"]
QUOTAS, CAP = {"p": 4, "q": 5, "r": 50}, 2


def text_of(kind, i):
    return BANK[random.Random(f"{kind}{i}").randrange(len(BANK))]


def looped(quotas, cap):
    """One attempt after another."""
    seen, used, out = set(), {}, []
    for kind, quota in quotas.items():
        got = tries = 0
        while got < quota and tries < 8 * quota:
            t, tries = text_of(kind, tries), tries + 1
            norm, prefix = " ".join(t.split()).lower(), " ".join(t.split()[:3])
            if len(t) < 5 or norm in seen or used.get(prefix, 0) >= cap:
                continue
            seen.add(norm)
            used[prefix] = used.get(prefix, 0) + 1
            out.append((f"syn_{len(out):04d}", kind, tries - 1, t))
            got += 1
    return out


def run(spark, out, calls=None):
    @F.udf("string")
    def text(kind, i):
        return text_of(kind, i)

    def make(rows):
        if calls is not None:
            calls.append(sorted((r.example_type, r.attempt) for r in rows.collect()))
        return rows.withColumn("text", text("example_type", "attempt"))

    made = gen.generate(spark, out, QUOTAS, make, F.length("text") >= 5, CAP)
    return sorted(map(tuple, made.select("id", "example_type", "attempt", "text").collect()))


def test_waves_give_what_a_loop_gives(spark, tmp_path):
    got = run(spark, f"file://{tmp_path}/out")
    assert got == looped(QUOTAS, CAP) and {k for _, k, *_ in got} >= {"p", "q"}


def test_a_stopped_run_is_taken_up_where_it_stopped(spark, tmp_path, monkeypatch):
    out, whole, calls, kept = f"file://{tmp_path}/out", run(spark, f"file://{tmp_path}/whole"), [], gen.commit
    n = []

    def stops(*a):
        n.append(1)
        if len(n) == 3:
            raise OSError("stopped between the wave and its version")
        return kept(*a)

    monkeypatch.setattr(gen, "commit", stops)
    with pytest.raises(OSError, match="stopped"):
        run(spark, out, first := [])
    monkeypatch.setattr(gen, "commit", kept)
    assert run(spark, out, calls) == whole
    done = {a for wave in first[:2] for a in wave}
    assert len(first) == 3 and not done & {a for wave in calls for a in wave} and calls[0] == first[2]
    assert run(spark, out, again := []) == whole and [w for w in again if w and w[0][0] != "r"] == []


def test_what_was_taken_is_not_broadcast(spark, tmp_path, monkeypatch):
    """Broadcasts pass through the driver, and what was taken grows with the quotas."""
    plans, real = [], gen.first_admitted

    def watched(*a):
        plans.append((out := real(*a))._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(gen, "first_admitted", watched)
    assert run(spark, f"file://{tmp_path}/out") == looped(QUOTAS, CAP)
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_curate_takes_many_types(spark):
    rng = random.Random(3)
    rows = [(i, f"t{rng.randrange(10)}", f"{rng.choice('abc')} {rng.choice('de')} word {rng.randrange(40)}") for i in range(600)]
    quotas = {f"t{k}": 6 + k for k in range(10)}
    seen, used, want = set(), {}, []
    for kind, quota in quotas.items():
        got = 0
        for i, k, t in rows:
            p = " ".join(t.split()[:3])
            if k == kind and got < quota and t not in seen and used.get(p, 0) < 8:
                seen.add(t), want.append(i)
                used[p] = used.get(p, 0) + 1
                got += 1
    d = spark.createDataFrame(rows, "id long, example_type string, text string")
    assert sorted(r.id for r in curate.curate(d, quotas, 8).collect()) == sorted(want)


def test_dedup_of_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "a"), (None, "a"), (None, "c"), (None, "c"), (4, None), (5, "")], "id long, text string")
    assert sorted(curate.dedup_first(d).collect(), key=repr) == sorted([(1, "b"), (2, "a"), (None, "c"), (4, None)], key=repr)


# the cache


def cached(spark, path):
    rows = io.read_cache(spark, path).collect()
    assert len({r.cache_key for r in rows}) == len(rows)
    return {r.cache_key: r.codes for r in rows}


def batch(spark, **rows):
    return spark.createDataFrame([(k, v) for k, v in rows.items()], io.CACHE)


def test_upsert_leaves_one_row_a_key(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cache"
    assert cached(spark, path) == {}
    io.upsert_cache(batch(spark, a=["X"], b=[]), path)
    io.upsert_cache(batch(spark, b=["Y"], c=None), path)
    assert cached(spark, path) == {"a": ["X"], "b": ["Y"], "c": None}
    real = io.commit
    monkeypatch.setattr(io, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed between write and swap")))
    with pytest.raises(OSError, match="killed"):
        io.upsert_cache(batch(spark, a=["lost"], z=[]), path)
    monkeypatch.setattr(io, "commit", real)
    assert cached(spark, path) == {"a": ["X"], "b": ["Y"], "c": None}
    io.upsert_cache(batch(spark, a=["kept"], z=[]), path)  # the retry
    assert cached(spark, path) == {"a": ["kept"], "b": ["Y"], "c": None, "z": []}


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path, real, once = f"file://{tmp_path}/cache", io.commit, []

    def overtaken(spark_, log, version, content):
        if not once:  # another batch gets in between reading the log and renaming
            once.append(1)
            io.upsert_cache(batch(spark, b=["other"], c=[]), path)
        return real(spark_, log, version, content)

    monkeypatch.setattr(io, "commit", overtaken)
    io.upsert_cache(batch(spark, a=[], b=["mine"]), path)
    assert cached(spark, path) == {"a": [], "b": ["mine"], "c": []} and io.latest(spark, f"{path}/_log")[0] == 2


def test_parts_are_merged(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    for i in range(7):
        io.upsert_cache(batch(spark, **{"k": [str(i)], f"k{i}": []}), path, most_parts=3)
        assert len(io.latest(spark, f"{path}/_log")[1]) <= 3
    assert cached(spark, path) == {"k": ["6"], **{f"k{i}": [] for i in range(7)}}


# the lexicon


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_lexicon_matches(spark, monkeypatch, sent):
    monkeypatch.setattr("skeinflow.operators.lexicon.SENT", sent)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 120))) for _ in range(40)] + [None, "", "aaaa", "aaaa"]
    terms = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["a", "aa", "aa", "", None, "é", "zz"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("*", "1 AS term", "2 AS _key")
    got = {(r.id, r.term): r.places for r in lexicon_matches(d, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(i, t): n for i, x in enumerate(texts) if x for t in set(terms) if t for n in [sum(x.startswith(t, k) for k in range(len(x)))] if n}
    assert lexicon_matches(d, spark.createDataFrame([], "term string")).count() == 0


def test_a_large_lexicon_meets_no_nested_loop(spark):
    terms = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(";")).alias("term"))
    d = spark.range(200).select("id", F.concat_ws(" ", *(F.concat(F.lit("w"), (F.col("id") * 499 + k).cast("string"), F.lit(";")) for k in range(50))).alias("text"))
    found = lexicon_matches(d, terms)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.groupBy("id").count().where("count = 50").count() == 200


@pytest.mark.parametrize("piece", [3, 256])
def test_terms_that_begin_alike_are_met_by_equality(spark, monkeypatch, piece):
    """No place is compared with each of the terms of its beginning; pieces of long runs lose no match at their ends."""
    monkeypatch.setattr("skeinflow.operators.lexicon.PIECE", piece, raising=False)
    rng = random.Random(5)
    terms = sorted({"abcdefgh" + "".join(rng.choice("xy\U0001F600-]") for _ in range(rng.randint(0, 9))) for _ in range(400)})
    texts = ["".join(rng.choice([*terms, "abcdefgh", "x", " ", "\n"]) for _ in range(60)) for _ in range(8)]
    found = lexicon_matches(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert "StartsWith" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.id, r.term): r.places for r in found.collect()}
    assert got == {(i, t): n for i, x in enumerate(texts) for t in terms for n in [sum(x.startswith(t, k) for k in range(len(x)))] if n}
