"""Toxicity by a weighted finite-state grammar over clauses, with a lexicon and a scale that are learned from labelled texts.

Five transducers read a clause's words as symbols and pass on what they make of them: threats (a word of harm after one
of intent), insults, targets (who is meant, before or after), negation and reported speech (a verb of saying, or
quotation marks). Each is a few states with weighted arcs; composed, they are one machine whose path through a clause sums
the arcs' weights and the lexicon's. A clause that is attacked in matches, with a weight of zero at least: a lone insult counts
less than one aimed at somebody, and one that is denied or reported counts least. A document's measures are of its matched
clauses only (their weight, number, share, and weight a word), and a logistic scale of these is the score.

The lexicon is a short written one of four languages, and stems (beginnings of words) that are learned: of all that
stand in three toxic texts or more, those whose likelihood ratio between the words of toxic and other texts (four uses a text at
most) is beyond what the number of candidates explains; of stems that begin one another the one of higher ratio stays. Their weight is the logarithm of how much
more often they are used in toxic texts. At most SAMPLE labelled ids are learned from, those of least seeded hash, each with
its least text; stems are counted in Spark, and at most STEMS of them reach the driver. Only texts are read for a score.

All texts are lower-cased and scanned whole by one automaton of the lexicon; only clauses with a hit are read word by word, so
time grows with length alone. Null and empty texts match nothing and score like any text without a match. Ties stay ties; repeated
rows score alike; a null id is scored and counts as held out. Without labels the written lexicon and a fixed scale are used. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuts import cut
from .pu_quality import fold
from .texts import map_texts, small_batches, table, utf8

#: Most labelled ids that are learned from, and most stems that are looked at by the driver.
SAMPLE = 20_000
STEMS = 4096
THRESHOLD = 0.5
LEAST, MOST_USES, SHORTEST, LONGEST = 3, 4, 3, 14
LEAST_WEIGHT = 2.0

#: The written lexicon: whole words, in English, German, French and Spanish.
INSULTS = """idiot idiots idiotic moron morons stupid imbecile loser losers scum trash garbage pathetic worthless disgusting clown clowns coward cowards vermin filthy bastard bastards dimwit
    dummkopf trottel abschaum versager arschloch widerlich wertlos erbärmlich drecksau blödmann imbécile crétin débile ordure abruti minable connard salaud
    idiota idiotas imbécil estúpido estúpida inútil basura asqueroso payaso escoria cabrón""".split()  # fmt: skip
HARM = "kill hurt beat destroy shoot stab burn murder strangle töten umbringen schlagen verprügeln tuer frapper détruire matar golpear destruir".split()
INTENT = "will gonna going shall must i'll we'll should deserve werde werden wird vais allons va voy vamos vas".split()
TARGETS = "you your yours you're yourself u they them their these those people everyone du dich dir dein deine euch ihr tu toi te ton vous votre tú ti usted ustedes vosotros tus".split()
NEGATIONS = "not never no none isn't aren't wasn't don't doesn't didn't won't nobody nicht kein keine nie niemals ne pas jamais aucun nunca jamás ni tampoco".split()
SAYING = "said says say saying called calls calling wrote writes claims claimed reported quoted sagte sagt nannte nennt schrieb dit disait appelé traité écrit dijo dice llamó escribió".split()
WRITTEN_WEIGHT = 3.0

SYMBOLS = ["word", "target", "not", "says", "quote", "intent", "harm", "insult"]
SYMBOL_OF = {w: s for s, words in (("target", TARGETS), ("not", NEGATIONS), ("says", SAYING), ("intent", INTENT)) for w in words} | dict.fromkeys('"“”„«»', "quote")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”„«»]")
_CLAUSE = re.compile(r"[.!?;:,\n]+")

#: Fixed weights of the grammar's arcs.
AIMED, AGAIN, THREATENED, DENIED, TOLD = 0.7, 0.3, 0.5, -2.5, -2.0
SCOPE = 4


class Transducer:
    """Deterministic: arcs[state, symbol] = (next state, symbol passed on, weight)."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def read(self, symbols: list[str]) -> tuple[list[str], list[float]]:
        state, out, weights = self.start, [], []
        for s in symbols:
            state, made, w = self.arcs[state, s]
            out.append(made)
            weights.append(w)
        return out, weights


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that passes to b what a passes on; weights add up. Only states that can be reached are built."""
    symbols = {s for _, s in a.arcs}
    start = (a.start, b.start)
    arcs, todo = {}, [start]
    while todo:
        p, q = state = todo.pop()
        if (state, next(iter(symbols))) in arcs:
            continue
        for s in symbols:
            p2, between, w1 = a.arcs[p, s]
            q2, made, w2 = b.arcs[q, between]
            arcs[state, s] = ((p2, q2), made, w1 + w2)
            todo.append((p2, q2))
    names = {state: i for i, state in enumerate(dict.fromkeys(k[0] for k in arcs))}
    return Transducer({(names[k], s): (names[n], made, w) for (k, s), (n, made, w) in arcs.items()}, names[start])


def threats() -> Transducer:
    """Harm up to SCOPE words after an intent becomes a threat; harm alone is a word."""
    arcs = {}
    for left in range(SCOPE + 1):
        for s in SYMBOLS:
            after = SCOPE if s == "intent" else max(0, left - 1)
            arcs[left, s] = (after, "threat", THREATENED) if s == "harm" and left else (after, "word" if s in ("harm", "intent") else s, 0.0)
    return Transducer(arcs)


def insults() -> Transducer:
    """Insults and threats become attacks; one after another in a clause weighs more."""
    arcs = {}
    for seen in (0, 1):
        for s in ("word", "target", "not", "says", "quote", "threat", "insult"):
            attack = s in ("threat", "insult")
            arcs[seen, s] = (1, "attack", AGAIN * seen) if attack else (seen, s, 0.0)
    return Transducer(arcs)


def targets() -> Transducer:
    """An attack up to SCOPE words after or before somebody who is meant weighs more."""
    arcs = {}
    for meant in range(SCOPE + 1):
        for struck in range(SCOPE + 1):
            less = (max(0, meant - 1), max(0, struck - 1))
            for s in ("word", "target", "not", "says", "quote", "attack"):
                if s == "target":
                    arcs[(meant, struck), s] = ((SCOPE, 0), "word", AIMED if struck else 0.0)
                elif s == "attack":
                    arcs[(meant, struck), s] = ((less[0], 0 if meant else SCOPE), "attack", AIMED if meant else 0.0)
                else:
                    arcs[(meant, struck), s] = (less, s, 0.0)
    return Transducer(arcs, (0, 0))


def negation() -> Transducer:
    """An attack up to SCOPE words after a negation is denied."""
    arcs = {}
    for left in range(SCOPE + 1):
        for s in ("word", "not", "says", "quote", "attack"):
            after = SCOPE if s == "not" else max(0, left - 1)
            arcs[left, s] = (after, "denied", DENIED) if s == "attack" and left else (after, "word" if s == "not" else s, 0.0)
    return Transducer(arcs)


def reports() -> Transducer:
    """An attack after a verb of saying, or between quotation marks, is told."""
    arcs = {}
    for said in (0, 1):
        for quoted in (0, 1):
            for s in ("word", "says", "quote", "attack", "denied"):
                after = (1 if s == "says" else said, 1 - quoted if s == "quote" else quoted)
                told = said or quoted
                arcs[(said, quoted), s] = (after, "told", TOLD) if s == "attack" and told else (after, s if s in ("attack", "denied") else "", 0.0)
    return Transducer(arcs, (0, 0))


def grammar() -> Transducer:
    made = threats()
    for machine in (insults(), targets(), negation(), reports()):
        made = compose(made, machine)
    return made


class Lexicon:
    """Finds insults and words of harm: written words as they are, learned stems at the start of a word."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.grammar = grammar()
        self.machine = ahocorasick.Automaton()
        entries = {w: ("insult", WRITTEN_WEIGHT, True) for w in INSULTS} | {w: ("harm", WRITTEN_WEIGHT, True) for w in HARM}
        for s, w in stems.items():
            entries[s] = ("insult", w, False)
        for key, (kind, w, whole) in entries.items():
            self.machine.add_word(key, (len(key), kind, w, whole))
        self.machine.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[str, float]]:
        """Symbol and weight by the place where the word begins; the longest entry counts."""
        found: dict[int, tuple[str, float]] = {}
        for end, (size, kind, w, whole) in self.machine.iter(text):
            start = end - size + 1
            if (start == 0 or not text[start - 1].isalnum()) and not (whole and text[end + 1 : end + 2].isalnum()):
                found[start] = (kind, w)  # ends rise, so a longer one from here comes later
        return found

    def clauses(self, text: str) -> Iterator[tuple[int, int, float, str]]:
        """(start, end, weight, what the last attack in it is) of each clause with an attack."""
        hits = self.hits(text)
        if not hits:
            return
        ends = [m.end() for m in _CLAUSE.finditer(text)]
        ends.append(len(text) + 1)
        done = -1
        for at in sorted(hits):
            if at < done:
                continue
            k = bisect_left(ends, at + 1)
            start, done = (ends[k - 1] if k else 0), ends[k]
            state, weight, what = self.grammar.start, 0.0, ""
            for m in _WORD.finditer(text, start, min(done, len(text))):
                symbol, w = hits.get(m.start()) or (SYMBOL_OF.get(m.group(), "word"), 0.0)
                state, made, more = self.grammar.arcs[state, symbol]
                weight += more + (w if made else 0.0)
                what = made or what
            if what:
                yield start, min(done, len(text)), max(0.0, weight), what


MEASURES = 7
_KINDS = {"attack": 0, "denied": 1, "told": 2}


def measure(text: str, lexicon: Lexicon) -> tuple[list[float], int]:
    """Measures of a text's matched clauses, and their number."""
    weights, kinds = [], [0, 0, 0]
    for _, _, w, what in lexicon.clauses(text.lower()):
        weights.append(w)
        kinds[_KINDS[what]] += 1
    total, words = sum(weights), len(text.split())
    n = len(weights)
    return [math.log1p(total), math.log((total + 0.05) / (words + 20)), math.log1p(n), max(weights, default=0.0), math.log1p(words), float(total > 0), kinds[0] / n if n else 0.0], n


class Model:
    """A lexicon, and the scale of the measures."""

    def __init__(self, lexicon: Lexicon, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.lexicon, self.mean, self.spread, self.weights = lexicon, mean, spread, weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def scale(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> Model:
    """Penalised logistic regression by Newton's method; a fixed scale if only one label is known."""
    if len(set(y.tolist())) < 2:
        return Model(lexicon, np.zeros(MEASURES), np.ones(MEASURES), np.array([1.0, 0, 0, 0, 0, 0, 0, -2.0]))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack(((x - mean) / spread, np.ones((len(x), 1))))
    w, ridge = np.zeros(z.shape[1]), np.diag([penalty] * (z.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return Model(lexicon, mean, spread, w)


def stems_of(text: str) -> Counter:
    """How many words of a text begin with each stem."""
    out: Counter = Counter()
    for w, n in Counter(re.findall(r"[^\W\d_]+", text.lower())).items():
        for k in range(SHORTEST, min(len(w), LONGEST) + 1):
            out[w[:k]] += n
    return out


def learned_stems(texts: DataFrame, text: str, label: str) -> dict[str, float]:
    """Stems and their weights, from rows of text and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {y: (Counter(), Counter()) for y in (0, 1)}
            for t, y in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                for s, n in stems_of(t.decode()).items():
                    found[y][0][s] += 1
                    found[y][1][s] += min(n, MOST_USES)
            keys = list({*found[0][0], *found[1][0]})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[s] for s in keys], pa.int64()) for c in (found[1][0], found[1][1], found[0][1]))], names=["stem", "docs", "a", "b"])

    counts = cut(texts.select(text, label).mapInArrow(run, "stem string, docs long, a long, b long").groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("docs", "a", "b"))).where(F.col("docs") >= LEAST))
    words = F.size(F.split(text, r"\s+"))
    a_all, b_all = texts.agg(*(F.coalesce(F.sum(F.when(F.col(label) == y, words)), F.lit(0)) for y in (1, 0))).first()
    if not a_all or not b_all:
        return {}
    least = 4 * math.log(max(1, counts.count())) + 8
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda k, m, of: k * F.log(F.greatest(k, F.lit(1e-9)) * float(a_all + b_all) / (m * float(of)))
    ratio = 2 * (part(a, a + b, a_all) + part(b, a + b, b_all))
    weight = F.log((a + 0.5) / float(a_all + 1) / ((b + 0.5) / float(b_all + 1)))
    rated = counts.select("stem", ratio.alias("ratio"), F.least(weight, F.lit(6.0)).alias("weight")).where((F.col("weight") >= LEAST_WEIGHT) & (F.col("ratio") > least))
    chosen: dict[str, float] = {}
    for r in rated.orderBy(F.desc(F.round("ratio", 6)), F.desc(F.length("stem")), "stem").limit(STEMS).collect():
        if not any(r.stem.startswith(c) or c.startswith(r.stem) for c in chosen):
            chosen[r.stem] = r.weight
    return chosen


def train(df: DataFrame, labels: DataFrame, by: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled ids of the training folds."""
    spark = df.sparkSession
    small_batches(spark)
    known = labels.where((fold(by) != 0) & F.col(label).isin(0, 1) & F.col(by).isNotNull()).groupBy(by).agg(F.max(label).cast("int").alias("label"))
    seeded = F.xxhash64(F.lit("toxic-1"), F.col(by).cast("string"))
    drawn = known.orderBy(seeded, by).limit(sample).collect()
    chosen = spark.createDataFrame([(r[0], r[1]) for r in drawn], f"_by {df.schema[by].dataType.simpleString()}, label int")
    met = df.select(F.col(by), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col(by) == F.col("_by"))  # at most `sample` ids
    rows = cut(met.groupBy("_by", "label").agg(F.min("text").alias("text")))
    lexicon = Lexicon(learned_stems(rows, "text", "label"))
    found = measured(rows, lexicon, ["label"]).toPandas()
    x = np.array(found["measures"].tolist()).reshape(len(found), MEASURES)
    order = np.lexsort((found["label"].to_numpy(), *x.T))  # rows come in any order; sums must not depend on it
    return scale(lexicon, x[order], found["label"].to_numpy(float)[order])


def measured(df: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    def rows_of(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"measures": pa.array([measure(t.decode(), lexicon)[0] for t in texts], pa.list_(pa.float64()))}

    return map_texts(df, rows_of, "measures array<double>", keep, text)


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of df: `keep`, score (0 to 1: the chance of label 1), predicted (1 from `threshold` on), and the number of clauses that matched."""

    def rows_of(texts: list[bytes]) -> dict[str, pa.Array]:
        found = [measure(t.decode(), model.lexicon) for t in texts]
        s = model.scores(np.array([m for m, _ in found]).reshape(len(texts), MEASURES))
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32)), "n_clauses": pa.array([n for _, n in found], pa.int64())}

    return map_texts(df, rows_of, "score double, predicted int, n_clauses long", keep, text)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model, ["doc_id"]).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted", "n_clauses")
