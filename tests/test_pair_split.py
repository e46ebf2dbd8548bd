"""Stratification by pairs of labels, where shares of labels alone pass."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import split


def shares(rows):
    of, test = Counter(), Counter()
    for labels, fold in rows:
        for p in combinations(sorted(set(labels)), 2):
            of[p] += 1
            test[p] += fold == "test"
    return {p: 1 - test[p] / n for p, n in of.items() if n >= 20}


def records(spark, n=700, seed=4):
    """Sets of many labels, nearly all different, in which some pairs stand together rarely."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = {f"l{k}" for k in range(9) if rng.random() < 0.3}
        if i % 35 == 0:
            s |= {"rare1", f"l{i % 9}"}
        if i % 29 == 0:
            s |= {"rare1", "rare2"}
        rows.append((i, sorted(s)))
    return spark.createDataFrame(rows, "id long, labels array<string>")


@pytest.mark.parametrize("literal", [4096, 3])
def test_pairs_keep_their_share(spark, literal):
    r = records(spark)
    got = split.greedy_split(r, literal=literal)
    rows = [(x.labels, x.fold) for x in got.collect()]
    assert len(rows) == 700 and len(shares(rows)) >= 36
    assert all(0.65 <= s <= 0.85 for s in shares(rows).values()), {p: s for p, s in shares(rows).items() if not 0.65 <= s <= 0.85}
    by = {x.label: x.train_share for x in split.fold_counts(got).collect()}
    assert all(0.65 <= s <= 0.85 for s in by.values())
    assert {tuple(x) for x in split.pair_counts(got).where("total >= 20").select("a", "b").collect()} == set(shares(rows))


def test_labels_alone_pass_while_pairs_do_not(spark):
    """Thirty pairs of one `x` and one `y` label, in rows that common labels put in any order."""
    rng = random.Random(6)
    rows = [(i, sorted([f"a{k}" for k in range(8) if rng.random() < 0.5] + [f"x{i % 6}", f"y{i % 5}"])) for i in range(690)]
    r = spark.createDataFrame(rows, "id long, labels array<string>")
    outside = {}
    for pairs in (False, True):
        got = split.greedy_split(r, pairs=pairs)
        assert all(0.65 <= x.train_share <= 0.85 for x in split.fold_counts(got).collect())
        of = shares([([x for x in s.labels if x[0] in "xy"], s.fold) for s in got.collect()])
        assert len(of) == 30
        outside[pairs] = sum(not 0.65 <= s <= 0.85 for s in of.values())
    assert outside[False] > 0 == outside[True]


def test_split_is_a_function_of_seed_and_ids(spark):
    r = records(spark, 200).unionByName(spark.createDataFrame([(1000, None), (1001, []), (1002, ["l1", None, "l1"])], "id long, labels array<string>"))
    one, two = split.greedy_split(r), split.greedy_split(r.repartition(7).orderBy(F.desc("id")))
    assert one.count() == 203 and one.exceptAll(two).count() == 0
    assert split.greedy_split(r.limit(0)).count() == 0
