"""Quantiles by counts of ranges against sorting, and densities against the kernel over all values."""

import math
import random

import numpy as np
import pytest

from skeinflow.operators import distribution

AT = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def measures(spark):
    rng = random.Random(9)
    rows = [("wide", rng.lognormvariate(0, 8)) for _ in range(900)] + [("ties", float(rng.randrange(3))) for _ in range(400)] + [("one", 5.0)] + [("same", 2.5)] * 300
    rows += [(None, -rng.random()) for _ in range(50)] + [("wide", None), ("wide", math.nan), ("none", None), ("two", 1.0), ("two", 2.0)]
    return spark.createDataFrame(rows, "kind string, x double").repartition(5).selectExpr("*", "1 AS g", "2 AS n", "3 AS lo"), rows


@pytest.mark.parametrize(("ranges", "few"), [(1024, 4096), (8, 3)])
def test_quantiles_are_those_of_sorting(spark, ranges, few):
    d, rows = measures(spark)
    got = {(r.kind, r.p): r.value for r in distribution.quantiles(d, "kind", "x", AT, ranges, few).collect()}
    kinds = {k for k, _ in rows} - {"none"}
    assert set(got) == {(k, p) for k in kinds for p in AT}
    for k in kinds:
        want = np.quantile([x for g, x in rows if g == k and x is not None and x == x], AT)
        assert all(abs(got[k, p] - w) <= 1e-9 * max(1.0, abs(w)) for p, w in zip(AT, want)), k
    assert distribution.quantiles(d.limit(0), "kind", "x", AT).count() == 0


def test_densities(spark):
    d, rows = measures(spark)
    got = {}
    for r in distribution.densities(d.where("kind IN ('ties', 'same', 'two') OR kind IS NULL"), "kind", "x", points=40, bins=4096).collect():
        got.setdefault(r.kind, []).append((r.i, r.at, r.density))
    assert set(got) == {"ties", "two", None}
    for k, found in got.items():
        x = np.array([v for g, v in rows if g == k])
        bw = x.std(ddof=1) * len(x) ** -0.2
        at = np.linspace(x.min() - 2 * bw, x.max() + 2 * bw, 40)
        want = np.exp(-0.5 * ((at[:, None] - x) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))
        found = np.array(sorted(found))
        assert np.abs(found[:, 1] - at).max() < 1e-9 and np.abs(found[:, 2] - want).max() < 0.01 * want.max()
