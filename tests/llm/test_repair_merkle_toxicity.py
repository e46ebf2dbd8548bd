"""Conversation repair, the manifest and toxicity: brute force on hand-made rows, hot groups, odd rows, held-out labels."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import conversations, merkle, toxicity
from skeinflow.llm.texts import table

# conversations


def best_edits(messages):
    """All edits by dynamic programming over the pattern's last initial: cost, audit and what is said."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    seen, faults = set(), []
    for r, x in messages:
        core = re.sub("[\x20\x09-\x0d]", "", x)
        faults.append("b" if not core else "d" if (r, x) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((r, x))

    def better(best, at, way):
        if at and (at not in best or way[:2] < best[at][:2]):
            best[at] = way

    def inserted(best):
        for _ in range(4):
            for q, (c, a, o) in list(best.items()):
                for r in ("user", "assistant"):
                    better(best, step.get((q, r[0])), (c + 3, a + "I", (*o, (r, ""))))
        return best

    best = inserted({"": (0, "", ())})
    for (r, x), f in zip(messages, faults):
        new = {}
        for q, (c, a, o) in best.items():
            w = (c + 4, a + "D", o)
            if q not in new or w[:2] < new[q][:2]:
                new[q] = w
            if f in ("", "t"):
                better(new, step.get((q, r[:1])), (c + 3 * (f == "t"), a + "K", (*o, (r, x))))
                for z in ("user", "assistant"):
                    better(new, step.get((q, z[0])), (c + 3 + 3 * (f == "t"), a + "R", (*o, (z, x))))
        best = inserted(new)
    cost, audit, said = min((best[q] for q in ("", "a") if q in best), key=lambda w: w[:2])
    return [faults.count(f) for f in "bdt"], cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest()


def brute_repair(rows, damage=True):
    by = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        by.setdefault(c, []).extend([(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1))
    out = []
    for c, m in by.items():
        m.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns = [t for t, _, _ in m if t is not None]
        odd = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(m, m[1:]))
        counts, cost, audit, digest = best_edits([x[1:] for x in m])
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, odd, cost, audit, digest))
    return sorted(out, key=repr)


def talk(seed=5):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", None, "tool", ""], ["hi.", "ok", "what?", "  ", "no!", None, "and é", "so it is."]
    rows = [(c, rng.choice([t, t, t, t, None, 2 * t]), rng.choice(roles), rng.choice([*texts, f"x{t}."])) for c in [*range(60), None] for t in range(rng.randint(1, 9))]
    rows += [(777, t // 2 if t % 9 else None, rng.choice(roles[:5]), rng.choice([f"x{t}.", f"y {t}", "ok", "", f"no {t}!"])) for t in range(400)]
    rows += [(7, 1, "user", "same.")] * 40
    rng.shuffle(rows)
    return rows


SAID = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [3, 40, 1024])
def test_repair_is_the_cheapest(spark, block):
    """One conversation holds most of the rows; with small blocks all lie in several, joined over the tasks."""
    rows = talk()
    d, copies = conversations.damaged(spark.createDataFrame(rows, SAID).repartition(5).selectExpr("*", "1 AS cost", "2 AS _n", "3 AS i"))
    assert sorted(map(tuple, conversations.repair(d, copies=copies, block=block).collect()), key=repr) == brute_repair(rows)


def test_search_alone():
    rng = random.Random(3)
    for _ in range(400):
        m = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", "c!", "d?"])) for _ in range(rng.randint(0, 8))]
        roles, texts = [r for r, _ in m], [x for _, x in m]
        faults = conversations.faults_of(roles, texts)
        [(cost, audit)] = conversations.search([r[:1] for r in roles], faults).values()
        said = "\n".join(f"{r}:{x}" for _, r, x in conversations.edited(audit, roles, texts))
        assert (cost, audit, hashlib.sha256(said.encode()).hexdigest()) == best_edits(m)[1:]


def test_repair_of_odd_tables(spark):
    none = conversations.repair(spark.createDataFrame([], SAID))
    assert none.count() == 0 and none.columns[-1] == "repaired_sha256"
    gone = spark.createDataFrame([(1, 0, "user", "x."), (2, None, None, None), (3, 0, "user", "long " * 200_000)], SAID)
    got = {r.conv_id: r for r in conversations.repair(gone, copies=F.when(F.col("conv_id") == 1, 0).otherwise(1)).collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[2].blank, got[2].cost, got[2].audit) == (1, 4, "D") and (got[3].truncated, got[3].cost, got[3].audit) == (1, 4, "D")
    named = conversations.repair(spark.createDataFrame([("a", 1, "user", "hi."), ("a", 2, "assistant", "yes.")], SAID.replace("conv_id long", "conv_id string")))
    assert [(r.conv_id, r.audit) for r in named.collect()] == [("a", "KK")]


def test_repair_takes_time_in_proportion():
    m = [("user" if i % 3 else "assistant", f"word {i}" + "." * (i % 2)) for i in range(4096)]
    faults = conversations.faults_of([r for r, _ in m], [x for _, x in m])
    began = time.process_time()
    for k in range(0, 4096, 1024):
        assert len(conversations.search([r[:1] for r, _ in m[k : k + 1024]], faults[k : k + 1024], 2, final=False)) >= 2
    assert time.process_time() - began < 10


# manifest


def brute_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text"""
    h = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        level, siblings = nodes, [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(level) > 1:
            for i, a in enumerate(at):
                siblings[i].append((a & 1, level[a ^ 1]) if a ^ 1 < len(level) else None)
            at = [a >> 1 for a in at]
            level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0], siblings

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, upper = tree([s for s, _ in trees])
    out = []
    for g, (subroot, paths), up in zip(groups, trees, upper):
        for r, path in zip(g, paths):
            path = path + up
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for s in path:
                now = h(now) if s is None else h(s[1], now) if s[0] else h(now, s[1])
            out.append((r[0], leaf(r), subroot, root, h(*(s[1] for s in path if s)), now, now == root))
    return sorted(out, key=repr)


LEAF = "doc_id long, source string, lang string, n_chars long, text string"

def altered():
    return {"n_chars": F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


@pytest.mark.parametrize(("levels", "top"), [(12, 8192), (2, 8), (1, 3), (2, 2)])
def test_manifest(spark, levels, top):
    """One group holds most rows; with small blocks and tops the tree is reduced in several rounds, over the groups too."""
    rng = random.Random(1)
    langs = ["en", "de", "fr", "ü", "", None]
    rows = [(i if i % 17 else None, f"s{i % 3}" if i % 5 else None, langs[min(5, int(rng.expovariate(0.7)))], i * 7 if i % 11 else None, f"text é {i % 9}" if i % 13 else None) for i in range(110)]
    rows += [(3, "s", "en", 4, "t")] * 5 + [(1000, "s", "en", 5, "long " * 100_000)]
    d = spark.createDataFrame(rows, LEAF).repartition(4).selectExpr("*", "1 AS leaf", "2 AS _pos", "3 AS _n")
    assert sorted(map(tuple, merkle.manifest(d, altered=altered(), levels=levels, top=top).drop("proof").collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_odd_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], LEAF)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(None, None, None, None, None)], LEAF)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == hashlib.sha256(b"-----").hexdigest() and one.verified and one.proof_sha256 == hashlib.sha256(b"").hexdigest()


# toxicity


def test_composed_grammar_is_its_machines_in_turn():
    machines = [toxicity.threats(), toxicity.insults(), toxicity.targets(), toxicity.negation(), toxicity.reports()]
    whole, rng = toxicity.grammar(), random.Random(2)
    for _ in range(500):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randint(0, 14))]
        said, weight = symbols, 0.0
        for m in machines:
            said, more = m.read(said)
            weight += sum(more)
        got, weights = whole.read(symbols)
        assert got == said and abs(sum(weights) - weight) < 1e-9


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("You are an idiot.", ["attack"]), ("It was an idiot", ["attack"]), ("You are not an idiot.", ["denied"]), ("He said you are an idiot", ["told"]),
        ('It reads "you idiot" there', ["told"]), ("I will kill you", ["attack"]), ("Frost can kill plants", []), ("The weather is fine. You too", []),
        ("Du bist ein Trottel! Et toi, abruti", ["attack", "attack"]), ("idiotically done", []), ("", []), ("trash" * 3, []),
    ],
)
def test_clauses(text, kinds):
    assert [w for *_, w in toxicity.Lexicon({}).clauses(text.lower())] == kinds


def test_weights_of_clauses():
    weight = lambda t: max((w for _, _, w, _ in toxicity.Lexicon({"gnarf": 2.0}).clauses(t)), default=0.0)
    assert weight("you are an idiot") > weight("it was an idiot") > weight("you said idiot") > weight("it was not an idiot") >= 0
    assert weight("such gnarfes") == 2.0 and weight("ungnarf") == 0.0 and weight("an idiot and a moron") > weight("an idiot")


def test_toxicity_learns_stems(spark):
    """Stems that are in no list are learned from the training folds; held-out texts and clean ones come out right."""
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdeilmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for i in range(900):
        w, toxic = prose(rng.randint(30, 200)), i % 6 == 0
        for _ in range(max(2, len(w) // 40) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zarkol", "quimbe"]) + rng.choice(["", "n", "rit", "oss"]))
        rows.append((i, " ".join(w) + ".", int(toxic)))
    rows += [(None, "x", 0), (5000, None, 0), (5001, "", 0), (5002, " ".join(prose(200_000)), 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS label", "3 AS stem")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] is not None], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert set(model.lexicon.stems) == {"zarkol", "quimbe"}
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert len(got) == len(rows) and all(got[i].predicted == t for i, _, t in rows)
    assert got[None].score == got[5001].score or got[None].n_clauses == got[5001].n_clauses == 0


def test_toxicity_of_odd_tables(spark, sf):
    docs, none = table(spark, sf, "documents"), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert toxicity.score(docs.where("doc_id < 0"), model, ["doc_id"]).count() == 0
    d = spark.createDataFrame([(1, "you idiot, you moron, you scum"), (1, "you idiot, you moron, you scum"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.predicted) for r in toxicity.score(d, model, ["doc_id"]).collect()) == [(1, 1), (1, 1), (2, 0)]


def test_toxicity_takes_time_in_proportion():
    lexicon = toxicity.Lexicon({"ach": 2.0})
    for t in ("you idiot " * 100_000, "achten " * 150_000, "a" * 1_000_000, "idiot." * 150_000):
        began = time.process_time()
        toxicity.measure(t, lexicon)
        assert time.process_time() - began < 6


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op13_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    right = (got.predicted == got.toxic).to_numpy()
    assert right[got.held_out].mean() > 0.9 and np.mean(got.predicted[got.toxic == 0]) < 0.02
