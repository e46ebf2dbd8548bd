"""Operators on small rows written by hand: edge cases, invariants, and errors."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import text as tx
from skeinflow.operators import curate, features, judge, labels, model, profile, split
from skeinflow.plans import report, stages
from skeinflow.plans.queries import QUERIES
from skeinflow.sources import synthetic
from skeinflow.sources import tables as io
from skeinflow.streaming.verdicts import judge_stream


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", column.alias("x")).orderBy("i").select("x").collect()]


def test_word_count_is_that_of_str_split(spark):
    texts = ["", " a  b\tc\n", "a b", "a b c", "a\x1cb", "😀 x", None, "   "]
    assert values(spark, texts, tx.word_count(F.col("text"))) == [len((t or "").split()) for t in texts]
    assert values(spark, ["😀", None], tx.char_count(F.col("text"))) == [1, 0]


def test_normalize_text(spark):
    texts = ['--- "abc""', "---abc", "  abc ", '"abc"', None, "---", '---"']
    assert values(spark, texts, tx.normalize_text(F.col("text"))) == ["abc", "abc", "abc", '"abc"', "", "", ""]


def test_prefilter(spark):
    nine, word = "אבגדהוזחט", "אב "
    texts = [nine + "a", nine[:8] + "a", "123", word * 4, word * 5, word * 5 + "abcdefgh", None]
    got = values(spark, texts, tx.prefilter_code(F.col("text")))
    assert got == ["GIBBERISH_SHORT", "MIXED_SCRIPT", "GIBBERISH_SHORT", "GIBBERISH_SHORT", None, "MIXED_SCRIPT", "GIBBERISH_SHORT"]


def test_gates(spark):
    good = "אני חוזר הביתה כל יום אחרי העבודה ושותה קפה"
    texts = [good, good + " PTSD", good + " ptsd", "קצר", good + " בתוך.", "אני הבית " + good, good + " וואלה. ", None]
    assert values(spark, texts, tx.accept_gate(F.col("text"))) == [True, False, False, False, False, False, False, False]
    assert values(spark, [good, good + " כל כל", good + " one two abc four five", good + " sure!"], tx.valid_gate(F.col("text"))) == [True, False, False, False]
    pair = spark.createDataFrame([(good, good), (good, "אב"), ("אב", good + good)], "raw string, polished string")
    assert [r[0] for r in pair.select(tx.polish_gate(F.col("raw"), F.col("polished"))).collect()] == [True, False, False]


def brute_valid(t):
    t = t or ""
    found = t.split()
    return (
        len(t) >= 30 and len(re.findall("[A-Za-z]", t)) >= 15 and not re.search("token|idiot|here is|output:", t.lower())
        and sum(bool(re.fullmatch("[A-Z][a-z]{11,}", w)) for w in found) <= 3 and not any(a == b and len(a) > 1 for a, b in zip(found, found[1:]))
    )


def test_words_are_told_from_white_space_at_every_character(spark):
    import re

    chars = [chr(c) for c in [*range(1, 0x250), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3010), 0xFEFF, 0x1F600]]
    d = spark.createDataFrame([(c, f"ab{c}ab", f"{c} ab{c}cd{c}") for c in chars], "c string, two string, some string")
    like = tx.words_like(F.col("two"), "^ab$")
    got = {r.c: (r.n, r.m, r.like, r.rep) for r in d.select("c", tx.word_count(F.col("two")).alias("n"), tx.word_count(F.col("some")).alias("m"), like.alias("like"), tx.repeated_neighbours(F.col("two")).alias("rep")).collect()}
    for c in chars:
        assert got[c] == (len(f"ab{c}ab".split()), len(f"{c} ab{c}cd{c}".split()), 2 * c.isspace(), c.isspace()), hex(ord(c))
    assert re.search(r"\[!-~\[", tx.WORD)  # printable ASCII first


def test_texts_of_one_file_are_judged_by_all_cores(spark, tmp_path):
    spark.createDataFrame([(i, "text") for i in range(50)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["valid_gate"](spark, str(tmp_path)).rdd.getNumPartitions() >= 4


def test_violin_counts_words_once(spark, sf):
    plan = QUERIES["length_violin"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "regexp" not in plan


def test_valid_gate_whole_has_a_row_for_long_and_uncounted_documents(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(900))
    texts = [long, long + " end end", long + " Output:", long + " Abcdefghijklmn" + "".join(f" Abcdefghijklm{c}" for c in "opq"), "short", "some plain words that are long enough", None]
    rows = [(i, t, None if i == 5 else len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.valid for r in QUERIES["valid_gate_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: brute_valid(t) for i, t in enumerate(texts)} and got[0] and not got[1] and got[5]


def test_quality_score_and_shapes(spark):
    assert values(spark, ["", "x" * 500, '"' + "ab " * 20], tx.quality_score(F.col("text"))) == [0.4, 0.4, 0.8]
    assert values(spark, ["השינה שלי", "הולך", "הילדים רצים", "למה זה", "ישן", ""], tx.phrase_shape(F.col("text"))) == ["clause", "verb", "clause", "clause", "verb", "verb"]
    assert values(spark, ['"a\n(b)\nc"', "(x", None], tx.strip_meta_lines(F.col("text"))) == ["a c", "", ""]


RUBRIC = {"naturalness": 5, "idiomaticity": 5, "register_fit": 5, "label_grounding": 5, "coherence": 5}


@pytest.mark.parametrize(
    ("raw", "codes"),
    [
        (json.dumps({"scores": RUBRIC, "clinical_leak": False, "slang_natural": True}), []),
        (json.dumps({"scores": RUBRIC | {"register_fit": 3}}), ["UNNATURAL_ROBOTIC"]),
        (json.dumps({"scores": {}}), ["LOW_NATURALNESS", "TRANSLATIONESE", "UNNATURAL_ROBOTIC", "LABEL_MISMATCH", "INCOHERENT"]),
        (json.dumps({"scores": RUBRIC, "clinical_leak": True, "slang_natural": False}), ["CLINICAL_LEAK", "SLANG_MISUSE"]),
        (json.dumps({"scores": RUBRIC | {"naturalness": 4.7}}), []),
        (json.dumps({"scores": RUBRIC | {"naturalness": "4"}}), []),
        (json.dumps({"scores": RUBRIC | {"naturalness": "4.7"}}), ["LOW_NATURALNESS"]),
        (json.dumps({"scores": RUBRIC, "clinical_leak": "true"}), []),
        ("```json\n" + json.dumps({"scores": RUBRIC}) + "\n```", []),
        ("nothing", ["GIBBERISH_SHORT"]),
        ("{bad}", ["GIBBERISH_SHORT"]),
        (json.dumps({"scores": RUBRIC}) + " tail }", ["GIBBERISH_SHORT"]),
        (None, ["GIBBERISH_SHORT"]),
    ],
)
def test_rubric(spark, raw, codes):
    assert spark.createDataFrame([(raw,)], "raw string").select(judge.rubric_codes(F.col("raw"))).first()[0] == codes


def records(spark, sets):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, labels array<string>")


def test_label_statistics(spark):
    r = records(spark, [["a"], ["a", "b"], ["b", "c"], [], None, ["a", "b", "c"]])
    m = {x.label: x.n for x in labels.marginals(r).collect()}
    assert m == {"a": 3, "b": 3, "c": 2}
    co = {(x.a, x.b): x.n for x in labels.cooccurrence(r).collect()}
    assert all(co[a, b] == co[b, a] for a, b in co) and all(co[k, k] == n for k, n in m.items()) and len(co) == 9
    hist = {x.n_labels: x.n for x in labels.cardinality_histogram(r).collect()}
    assert sum(k * n for k, n in hist.items()) == sum(m.values()) and hist[0] == 2
    constant = records(spark, [["a"], ["a", "b"]])
    assert {(x.a, x.b): x.phi for x in labels.phi(constant).collect()}["a", "b"] is None
    empty = records(spark, [[]]).where("id > 5")
    assert labels.cooccurrence(empty).count() == 0 and labels.phi(empty).count() == 0
    assert [x.labels for x in labels.with_negative(r).orderBy("id").collect()][3:5] == [["__NEG__"], ["__NEG__"]]


def test_profiles(spark):
    d = spark.createDataFrame([("a", "x y"), ("a", "x"), ("b", "x y z"), (None, "x")], "g string, text string")
    by = {r.g: r for r in profile.length_by_group(d, "g").collect()}
    assert by["a"].median_words == 1.5 and by["b"].std_words is None and set(by) == {"a", "b"}
    flags = {r.g: r for r in profile.length_flags(d, "g").collect()}
    assert flags["b"].short and not flags["b"].uniform
    assert profile.crosstab_wide(d.withColumn("t", F.length("text")), "g", "t", ["1", "3"]).count() == 3


def test_curation(spark):
    d = spark.createDataFrame([(0, "A b c d"), (1, "a  B c D"), (2, "A b c e"), (3, "A b c f"), (4, None), (5, "")], "id long, text string")
    assert sorted(r.id for r in curate.dedup_first(d).collect()) == [0, 2, 3, 4]
    assert sorted(r.id for r in curate.prefix_cap(d, 2).collect()) == [0, 1, 2, 4, 5]
    assert [r.row_id for r in curate.numbered(d).orderBy("id").collect()] == [f"syn_{i:04d}" for i in range(6)]
    typed = spark.createDataFrame([(0, "x one", "p"), (1, "x two", "p"), (2, "x two", "q"), (3, "x one a", "q"), (4, "x one b", "q")], "id long, text string, example_type string")
    assert sorted(r.id for r in curate.curate(typed, {"p": 1, "q": 2}, 5).collect()) == [0, 2, 3]


def test_split_is_a_partition_and_gated(spark):
    r = spark.range(400).select("id", F.when(F.col("id") % 4 == 0, F.array(F.lit("a"))).when(F.col("id") % 4 == 1, F.array(F.lit("a"), F.lit("b"))).when(F.col("id") == 2, F.array(F.lit("rare"))).when(F.col("id") == 6, F.array(F.lit("rare"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    s = split.stratified_split(r)
    assert s.count() == 400 and s.select("id").distinct().count() == 400
    with pytest.raises(RuntimeError, match="rare"):
        split.check_gates(s)
    g = split.stratified_split(r, greedy=True)
    assert {x.label: x.test for x in split.fold_counts(g).collect()}["rare"] == 1
    again = split.stratified_split(r.orderBy(F.desc("id")), greedy=True)
    assert g.exceptAll(again).count() == 0
    assert split.random_split(r.limit(1)).first().fold == "test"
    assert split.js_divergence(s).first().js < 0.05


def test_greedy_split_keeps_shares_where_label_sets_are_of_one_row(spark):
    # 300 rows, nearly each with a label set of its own, out of ten labels of which the last are rare
    rows = [(i, [f"l{k}" for k in range(10) if (i * 7919 + k * 104729) % (2 + k) == 0 or (i >> k) % 3 == 2] + (["once"] if i == 5 else []) + ([None, "l0", "l0"] if i == 9 else [])) for i in range(300)] + [(300 + i, None) for i in range(8)]
    r = spark.createDataFrame(rows, "id long, labels array<string>")
    g = split.stratified_split(r, greedy=True)
    assert sorted(x.id for x in g.collect()) == list(range(308))
    bare = g.where("labels is null or size(labels) = 0")
    assert bare.where("fold = 'test'").count() == int(bare.count() * 0.25 + 0.5)
    known = g.withColumn("labels", F.array_distinct(F.array_compact("labels")))
    shares = {x.label: (x.total, x.test) for x in split.fold_counts(known).collect()}
    assert shares.pop("once") == (1, 0) and len(shares) == 10
    assert all(0.15 <= test / total <= 0.35 for total, test in shares.values()), shares
    assert g.exceptAll(split.stratified_split(r.repartition(7), greedy=True)).count() == 0
    assert split.stratified_split(r.limit(0), greedy=True).count() == 0
    assert {x.fold for x in split.stratified_split(r.where("labels is null"), greedy=True).collect()} == {"test", "train"}


def test_published_counts_pass_the_gates(spark):
    # Rows by label in the two folds of a published split, 1495 and 499 rows.
    train = [319, 284, 209, 189, 135, 128, 110, 110]
    test = [106, 95, 69, 63, 45, 43, 37, 36]
    rows = [(f"{f}{i}", [f"l{k}" for k, n in enumerate(c) if i < n], f) for f, c, n in (("train", train, 1495), ("test", test, 499)) for i in range(n)]
    s = spark.createDataFrame(rows, "id string, labels array<string>, fold string")
    assert split.check_gates(s) < 1e-4


def test_tfidf_rows_have_length_one(spark):
    d = spark.createDataFrame([(0, "aa bb aa cc"), (1, "aa bb dd"), (2, "zz"), (3, None)], "id long, text string")
    w = features.tfidf(d, max_df=1.0)
    assert {r.term for r in w.collect()} == {"aa", "bb", "aa bb"}
    assert all(abs(r[1] - 1) < 1e-12 for r in w.groupBy("id").agg(F.sum(F.col("weight") ** 2)).collect())
    assert values(spark, ["a bb שלום! x1"], features.ngrams(features.tokens(F.col("text")), 3)) == [["bb", "שלום", "x1", "bb שלום", "שלום x1", "bb שלום x1"]]


@pytest.mark.parametrize("fitted", [False, True])
def test_tfidf_makes_tokens_and_counts_once(spark, monkeypatch, fitted):
    """Whatever the vocabulary's size: the rows of a record's terms are made once, for the vocabulary and the weights alike."""
    monkeypatch.setattr(features, "SENT", 0)
    monkeypatch.setattr(features, "PART", 8, raising=False)
    d = spark.createDataFrame([(i, f"aa bb aa cc{i % 3}" if i else None) for i in range(9)], "id long, text string")
    known = features.vocabulary(d, 9, max_df=1.0) if fitted else None
    w = features.tfidf(d, max_df=1.0, fitted=known)
    assert {(r.term, r.n) for r in w.groupBy("term").agg(F.count("*").alias("n")).collect()} == {("aa", 8), ("bb", 8), ("aa bb", 8), ("bb aa", 8), *((p + f"cc{k}", 2 + (k > 0)) for k in range(3) for p in ("", "aa "))}
    assert all(abs(r[1] - 1) < 1e-12 for r in w.groupBy("id").agg(F.sum(F.col("weight") ** 2)).collect())
    w.collect()
    plan = w._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("regexp_extract_all") == 1 and (fitted or "ReusedExchange" in final)


@pytest.mark.parametrize("fitted", [False, True])
def test_tfidf_sends_no_terms(spark, monkeypatch, fitted):
    """Rows by term would take some ten times the texts on disk; only packed keys travel. Ids may recur or be missing."""
    monkeypatch.setattr(features, "SENT", 0)
    monkeypatch.setattr(features, "PART", 64)
    rng = random.Random(3)
    rows = [(None if i % 11 == 0 else i // 2, " ".join(rng.choice(["aa", "bb", "שלום", "x1", "long_word", "-"]) for _ in range(rng.randint(0, 12))) if i % 7 else None) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, text string")
    counts, runs = {}, lambda w, n: [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    for id, text in rows:
        w = [x for x in (text or "").split() if x != "-"]
        for term in (t for n in (1, 2, 3) for t in runs(w, n)):
            counts[id, term] = counts.get((id, term), 0) + 1
    df = {}
    for _, term in counts:
        df[term] = df.get(term, 0) + 1
    known = {t: k for t, k in df.items() if 2 <= k <= 0.3 * 60}
    raw = {(id, t): (1 + math.log(tf)) * (math.log(61 / (1 + known[t])) + 1) for (id, t), tf in counts.items() if t in known}
    norm = {}
    for (id, _), w in raw.items():
        norm[id] = norm.get(id, 0) + w * w
    terms = spark.createDataFrame([*known.items(), ("never seen", 5)], "term string, df long") if fitted else None
    got = features.tfidf(d, most=3, max_df=0.3, fitted=terms, n_rows=60)
    found = {(r.id, r.term): r.weight for r in got.collect()}
    assert got.count() == len(raw) > 100 and found.keys() == raw.keys() and all(abs(found[k] - w / norm[k[0]] ** 0.5) < 1e-12 for k, w in raw.items())
    assert "hashpartitioning(term" not in got._jdf.queryExecution().executedPlan().toString()
    cells = features.tfidf_cells(d, most=3, max_df=0.3).collect()
    assert len(cells) == len({id for id, _ in rows}) and sum(len(r.at) for r in cells) == len(raw) and len({p for r in cells for p in r.at}) == len(known)
    assert all(r.at == sorted(set(r.at)) and sorted(r.weight) == pytest.approx(sorted(w for (id, _), w in found.items() if id == r.id)) for r in cells)


def test_metrics_and_models(spark):
    s = spark.createDataFrame([(0, "a", 1, 0.9), (1, "a", 0, 0.2), (2, "a", 1, 0.3), (0, "b", 0, 0.1), (1, "b", 0, 0.6), (2, "b", 0, 0.1)], "id long, label string, y int, proba double")
    m = model.metrics(s).first()
    assert (m.precision_micro, m.recall_micro, m.precision_macro) == (0.5, 0.5, 0.5)
    t = {r.label: r.threshold for r in model.threshold_search(s).collect()}
    assert t == {"a": 0.3, "b": 0.1}
    d = spark.createDataFrame([(i, "good day" if i % 2 else "bad night", ["g"] if i % 2 else []) for i in range(20)], "id long, text string, labels array<string>")
    w = features.tfidf(d, max_df=1.0)
    at = stages.io_index(w)
    p = model.one_vs_rest(model.cells(w, at), d, ["g", "none"], at.count(), max_iter=20)
    got = {(r.id, r.label): r.proba for r in p.collect()}
    assert all((got[i, "g"] > 0.5) == bool(i % 2) and got[i, "none"] == 0 for i in range(20))
    assert model.zero_shot(d, ["x"], scorer=lambda texts, label: [0.7] * len(texts)).where("predicted = 1").count() == 20


def test_rows_without_a_term_are_scored(spark, monkeypatch):
    d = spark.createDataFrame([(i, t, ["short"] if i % 2 else []) for i, t in enumerate(["good day", "bad night"] * 4 + [None, "", "zz"])], "id long, text string, labels array<string>")
    seen = []
    fit = model.one_vs_rest
    monkeypatch.setattr("skeinflow.plans.queries.docs", lambda *_: d)
    monkeypatch.setattr("skeinflow.plans.queries.CLASSES", ["short"])
    monkeypatch.setattr(model, "one_vs_rest", lambda f, *a, **b: seen.append(f) or fit(f, *a, **b))
    got = {r.id: r for r in QUERIES["ovr_logreg"](spark, "").collect()}
    assert sorted(got) == list(range(11)) and got[1].proba > 0.5 > got[0].proba
    places = {r.id: r.at for r in seen[0].collect()}
    assert len(places[0]) == 3 and places[8] == []  # two words and their bigram, in few rows


def test_evaluation_is_fitted_on_the_train_fold_only(spark, tmp_path):
    # test texts have words of their own, which tell their labels only to a model that has seen them
    rows = [(f"r{i}", f"plain text {'odd' if i % 2 else 'even'}", ["a"] if i % 2 else ["b"], "train") for i in range(20)]
    rows += [(f"t{i}", f"unseen {'left' if i % 2 else 'right'}", ["a"] if i % 2 else ["b"], "test") for i in range(20)] + [("u", "odd", ["a"], "test")]
    spark.createDataFrame(rows, "id string, text string, labels array<string>, fold string").write.parquet(f"file://{tmp_path}/folds")
    seen, fit = [], model.one_vs_rest
    with pytest.MonkeyPatch.context() as m:
        m.setattr(model, "one_vs_rest", lambda f, *a, **b: seen.extend([f, fit(f, *a, **b)]) or seen[-1])
        stages.evaluate_stage(spark, "", f"file://{tmp_path}")
    places = {r.id: r.at for r in seen[0].collect()}
    assert len(places) == 41 and places["t0"] == places["t1"] == [] != places["u"]
    proba = {(r.id, r.label): r.proba for r in seen[1].collect()}
    assert proba["t0", "a"] == proba["t1", "a"] and proba["u", "a"] > 0.5 > proba["r0", "a"]
    written = json.loads((tmp_path / "eval_results.json").read_text())
    assert {(r["model"], r["metric"]) for r in written} == {(m, f"{k}_{a}") for m in ("tfidf_train", "tfidf_val", "tfidf_test", "zeroshot_test") for k in ("precision", "recall", "f1") for a in ("micro", "macro")}


def test_labels_of_the_test_fold_change_neither_weights_nor_thresholds(spark, tmp_path):
    seen, search, fit = [], model.threshold_search, model.one_vs_rest
    for flip in (False, True):
        rows = [(f"{f}{i}", f"text {'odd' if i % 2 else 'even'} {'loud' if i % 3 else 'calm'}", ["a"] if (i % 2 == 1) != (flip and f == "test") else ["b"], f) for f, n in (("train", 40), ("test", 20)) for i in range(n)]
        out = f"file://{tmp_path}/{flip}"
        spark.createDataFrame(rows, "id string, text string, labels array<string>, fold string").write.parquet(f"{out}/folds")
        with pytest.MonkeyPatch.context() as m:
            m.setattr(model, "one_vs_rest", lambda f, *a, **b: seen.append(("fitted on", sorted(r.id for r in b["fit_on"].collect()))) or fit(f, *a, **b))
            m.setattr(model, "threshold_search", lambda s: seen.append(("tuned on", sorted((r.id, r.label, r.proba) for r in s.collect()))) or search(s))
            stages.evaluate_stage(spark, "", out)
    assert seen[:2] == seen[2:]
    fitted, tuned = set(seen[0][1]), {r[0] for r in seen[1][1]}
    assert len(tuned) == 6 and len(fitted) == 34 and not fitted & tuned and all(i.startswith("train") for i in fitted | tuned)


def test_settle_scores_each_text_once(spark):
    d = spark.createDataFrame([(0, "hello big wide world now"), (1, "hello big wide world now"), (2, "x"), (3, "one two three four five")], "id long, text string")
    cached = spark.createDataFrame([], io.CACHE)
    out, new = judge.settle(d, cached, stages.accept_all, **stages.LIMITS)
    calls = spark.sparkContext.accumulator(0)

    def unsteady(rows):
        def run(batches):
            for b in batches:
                calls.add(len(b))
                b["codes"] = [[str(random.random())] for _ in range(len(b))]
                yield b[["cache_key", "codes"]]

        return rows.mapInPandas(run, "cache_key string, codes array<string>")

    judged, fresh = judge.settle(d, cached, unsteady, **stages.LIMITS)
    said = {r.cache_key: r.codes for r in fresh.collect()}
    assert calls.value == 2 and all(r.codes == said[r.cache_key] for r in judged.where("id <> 2").collect())  # scored once, the same for both
    assert new.count() == 2 and {r.id: r.verdict for r in out.collect()} == {0: "ACCEPT", 1: "ACCEPT", 2: "REJECT", 3: "ACCEPT"}


def test_stages_and_stream(spark, tmp_path):
    rows = [{"id": f"r{i}", "text": f"some plain words number {chr(97 + i % 26)} here", "labels": ["a"] if i % 2 else ["b"], "example_type": "t", "platform": "p", "explicitness": "e", "severity": "mild", "slang_used": [], "synthetic": True} for i in range(40)]
    source = tmp_path / "records.json"
    source.write_text("﻿" + json.dumps(rows), encoding="utf-8")
    out = f"file://{tmp_path}/out"
    stages.run(spark, f"file://{source}", out, ["filter", "profile", "split", "report"], **stages.LIMITS)
    said = (tmp_path / "out/summary.md").read_text()
    assert "40 of 40 kept" in said and "| a | 20 | 15 | 5 | 0.75 |" in said
    made = json.loads((tmp_path / "out/split_manifest.json").read_text())
    assert made["per_label_ratios"]["b"] == {"total": 20, "train": 15, "test": 5, "train_share": 0.75} and made["neg_class_used_for_stratification"] == "__NEG__" and made["n_total"] == 40 and made["stratifier"]
    assert len(json.loads((tmp_path / "out/tables/label_marginals.json").read_text())) == 2
    assert spark.read.parquet(f"{out}/folds").select("fold").distinct().count() == 2
    with pytest.raises(FileNotFoundError, match="a.json.*b.json"):
        io.read_folds(spark, f"{out}/a.json", f"{out}/b.json")
    io.read_records(spark, f"file://{source}").write.parquet(f"{out}/in")
    stream = spark.readStream.schema(io.RECORD).parquet(f"{out}/in")
    judge_stream(stream, stages.accept_all, f"{out}/c2", f"{out}/o2", f"{out}/k2", **stages.LIMITS).awaitTermination()
    assert spark.read.parquet(f"{out}/o2/batch=0").count() == 40 and io.read_cache(spark, f"{out}/c2").count() == 26


def test_synthetic(spark):
    p = synthetic.scenarios(spark, 100)
    assert {r.example_type: r["count"] for r in p.groupBy("example_type").count().collect()} == {"positive_clear": 35, "implicit": 25, "hard_negative": 25, "ambiguous": 15}
    assert p.where("example_type = 'hard_negative' and size(labels) > 0").count() == 0
    assert p.exceptAll(synthetic.scenarios(spark, 100)).count() == 0
    assert len(spark.range(1).select(synthetic.sampled(["a", "b", "c"], 2, F.col("id"))).first()[0]) == 2
    assert spark.range(3).select(synthetic.canned(["x", "y"], F.col("id").cast("string"))).count() == 3


def test_report_text():
    text = report.summary({"accepted": 85, "generated": 100}, {"n_labels": 2, "rarest_label": "a", "rarest_n": 1, "top_label": "b", "top_n": 9}, {"n_train": 64, "n_test": 21, "seed": 1240, "js": 0.0}, 0.99)
    assert "85 of 100 kept (85.0 %)" in text and "Rarest: a (1)" in text


def test_prompts(spark):
    from skeinflow.functions import prompts

    d = spark.createDataFrame([(["sleep_disturbance"], "diary", "mild", "implicit", None), ([], "tweet", "mild", "explicit", ["a", "b", "c", "d"])], "labels array<string>, platform string, severity string, explicitness string, few array<string>")
    got = [r[0] for r in d.select(prompts.generation_prompt(*(F.col(c) for c in ("labels", "platform", "severity", "explicitness", "few")))).collect()]
    assert "- sleep disturbance" in got[0] and "Examples" not in got[0] and "Show these" not in got[1] and got[1].count("---") == 2
    assert all("\n\n\n" not in g for g in got)
    asked = d.select(prompts.judge_prompt(F.col("platform"), F.col("labels"), F.col("platform"))).first()[0]
    assert asked.endswith("}") and "Labels:\nsleep_disturbance" in asked


def test_polished_or_raw(spark):
    raw, good = "אני חוזר הביתה כל יום אחרי העבודה", '"אני חוזר הביתה מדי יום אחרי העבודה שלי"'
    d = spark.createDataFrame([(raw, good), (raw, None), (raw, "(תרגום) " + raw), (raw, "קצר")], "raw string, answer string")
    got = [r[0] for r in d.select(tx.polished_or_raw(F.col("raw"), F.col("answer"))).collect()]
    assert got == [good.strip('"'), raw, raw, raw]


def test_views(spark, sf):
    from skeinflow.plans.views import register

    register(spark, sf, ["label_marginals", "label_cooccurrence"])
    assert spark.sql("SELECT count(*) FROM label_marginals m JOIN label_cooccurrence c ON c.a = m.label AND c.b = m.label AND c.n <> m.n").first()[0] == 0
