"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk of Kiryo et al. (2017).

Trusted positives are texts labelled 1, unlabelled ones are any texts; both come from the training folds only. With the
class prior p the risk is

    p * mean(loss(z of positives)) + max(0, mean(loss(-z of unlabelled)) - p * mean(loss(-z of positives)))

with logistic loss, so that the sigmoid of z estimates the chance of label 1. Where the bracket turns negative, the
step goes against it, as in the paper. Where labelled rows have both labels, p is the share of 1 among those of the training
folds, which is the estimate of least variance; where only positives are known, p is estimated from them and the
unlabelled rows: the least ratio of the two samples' upper tails, each ratio with a bound for its chance error. z is linear in binned measures of the text alone: shares of characters, common
words, repetition, line ends. Neither labels, language, source nor id enter a score.

It is fitted on a sample of at most SAMPLE positives and SAMPLE unlabelled rows, those of least seeded hash of the id:
the ids are chosen first, so no text but theirs is read for it. All texts are then scored where they lie.

Null and empty texts measure zero and get a score like any other; long texts are measured whole. Ties of scores stay ties. A null id counts as the empty text and is held out.
Without positives every weight is zero and all scores are the prior (0.5 with no labels at all). Repeated rows score alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import _FACTORS, _LOW, Words, repeated_words
from .texts import SPACES, map_texts, table

#: Bound of the rows that are fitted on, of either kind.
SAMPLE = 20_000
FOLDS = 5
BINS = 12
THRESHOLD = 0.3

#: Shares of characters: their bytes.
_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&", b"|", b"!", b".", b",", b"<>{}[]=\\/_~^", b"?:;\"'()-", bytes(range(128, 256))]
_GROUP_OF = np.zeros((256, len(_GROUPS)))
for _g, _bytes in enumerate(_GROUPS):
    _GROUP_OF[list(_bytes), _g] = 1
_SPACE, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[list(SPACES)] = _CAPITAL[65:91] = True
N_MEASURES = len(_GROUPS) + 13


def measure(text: bytes, known: Words) -> list[float]:
    """Measures of a text, none of which needs to know its language."""
    letters = np.frombuffer(text, np.uint8)
    counts = np.bincount(letters, minlength=256)
    capital_words = int((_SPACE[letters[:-1]] & _CAPITAL[letters[1:]]).sum()) + text[:1].isupper()
    size = max(1, len(text))
    words = text.split()
    n = len(words)
    numbers = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    used = counts[counts > 0] / size
    distinct = len(np.unique(numbers)) if n else 0
    pairs = len(np.unique(numbers[:-1] * _FACTORS[0] + numbers[1:])) if n > 1 else 0
    whole = max(1, n)
    return [
        *(counts @ _GROUP_OF / size),
        math.log1p(n), size / whole, distinct / whole, math.log1p(distinct) / max(1.0, math.log1p(n)), pairs / max(1, n - 1),
        float((numbers[1:] == numbers[:-1]).sum()) / whole, repeated_words(numbers) / whole, float(((numbers & np.uint64(_LOW)) > 0).sum()) / whole,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), (len(lines) - len(set(lines))) / max(1, len(lines)),
        float(-(used * np.log2(used)).sum()) if len(used) else 0.0, capital_words / whole,
    ]


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Column of the bin of each measure, in one row of len(edges) * (BINS + 1) places."""
    return np.stack([np.searchsorted(e, x[:, i], side="right") + i * (BINS + 1) for i, e in enumerate(edges)], axis=1)


class Model:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[binned(x, self.edges)].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Weights that minimise the non-negative risk, by Adam over all rows."""
    start = math.log(prior / (1 - prior))
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((N_MEASURES, BINS)), np.zeros(N_MEASURES * (BINS + 1)), start)
    both = np.concatenate((positive, unlabelled))
    edges = np.quantile(both, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    p, u = binned(positive, edges), binned(unlabelled, edges)
    size = N_MEASURES * (BINS + 1)
    w = np.zeros(size + 1)
    w[-1] = start
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    loss = lambda z: np.logaddexp(0, -z)
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def slope(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        flat = np.bincount(rows.ravel(), np.repeat(by, rows.shape[1]), size) / len(rows)
        return np.append(flat, by.mean())

    for t in range(1, steps + 1):
        zp, zu = w[p].sum(1) + w[-1], w[u].sum(1) + w[-1]
        negative = loss(-zu).mean() - prior * loss(-zp).mean()
        of_negative = slope(u, chance(zu)) - prior * slope(p, chance(zp))
        g = prior * slope(p, chance(zp) - 1) + of_negative if negative >= 0 else -of_negative
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    return Model(edges, w[:-1], float(w[-1]))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1, seed: int = 1) -> float:
    """The share of positives among unlabelled rows: no tail of scores holds more of the positives than of the unlabelled rows, divided by it.

    Scores come from a classifier that is fitted on the other half of the rows. Of all tails that hold a tenth of the
    positives or more, the one with the least upper bound (Dvoretzky-Kiefer-Wolfowitz) is taken.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    random = np.random.default_rng(seed)
    order = [random.permutation(len(x)) for x in (positive, unlabelled)]
    found = []
    for half in (0, 1):
        ranker = fit(positive[order[0][half::2]], unlabelled[order[1][half::2]], 0.5)
        p, u = (np.sort(ranker.scores(x[o[1 - half :: 2]])) for x, o in zip((positive, unlabelled), order))
        cuts = np.quantile(p, np.linspace(0, 0.9, 37))
        of_p, of_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (p, u))
        error = sum(math.sqrt(math.log(4 / chance) / (2 * len(x))) for x in (p, u))
        best = int(np.argmin((of_u + error) / of_p))
        found.append(of_u[best] / of_p[best])
    return min(0.99, max(0.01, float(np.mean(found))))


def fold(by: str, folds: int = FOLDS) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(by).cast("string"), F.lit("")), "UTF-8")) % folds


def measured(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    known = Words()

    def rows_of(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"measures": pa.array([measure(t, known) for t in texts], pa.list_(pa.float64()))}

    return map_texts(df, rows_of, "measures array<double>", keep, text)


def train(df: DataFrame, labels: DataFrame, by: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` positives and as many unlabelled rows of the training folds."""
    known = labels.where((fold(by) != 0) & F.col(label).isin(0, 1))
    positives, of = known.agg(F.coalesce(F.sum(label), F.lit(0)), F.count("*")).first()
    prior = min(0.99, max(0.01, (positives + 1) / (of + 2))) if positives < of or not of else None  # none: only positives are known
    seeded = F.xxhash64(F.lit("pu-1"), F.col(by).cast("string"))
    ids = lambda rows: {r[0] for r in rows.select(by).distinct().orderBy(seeded, by).limit(sample).collect()}
    trusted, others = ids(known.where(F.col(label) == 1)), ids(df.where((fold(by) != 0) & F.col(by).isNotNull()))
    session = df.sparkSession
    chosen = session.createDataFrame([(i, i in trusted, i in others) for i in sorted(trusted | others)], f"_by {df.schema[by].dataType.simpleString()}, trusted boolean, unlabelled boolean")
    rows = df.select(F.col(by), F.col(text)).join(F.broadcast(chosen), F.col(by) == F.col("_by"))  # at most 2 * sample ids
    drawn = measured(rows.select("trusted", "unlabelled", text), ["trusted", "unlabelled"], text).dropDuplicates().toPandas() if trusted | others else None
    if drawn is None or drawn.empty:
        return fit(np.zeros((0, N_MEASURES)), np.zeros((0, N_MEASURES)), prior or 0.5)
    x = np.array(drawn["measures"].tolist()).reshape(len(drawn), N_MEASURES)
    order = np.lexsort(x.T)  # rows come in any order; sums must not depend on it
    x, t, u = x[order], drawn["trusted"].to_numpy(bool)[order], drawn["unlabelled"].to_numpy(bool)[order]
    return fit(x[t], x[u], prior or estimated_prior(x[t], x[u]))


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of df: `keep`, score (0 to 1: the chance of label 1), predicted (1 from `threshold` on)."""
    known = Words()

    def rows_of(texts: list[bytes]) -> dict[str, pa.Array]:
        s = model.scores(np.array([measure(t, known) for t in texts]).reshape(len(texts), N_MEASURES))
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return map_texts(df, rows_of, "score double, predicted int", keep, text)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model, ["doc_id"]).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")
