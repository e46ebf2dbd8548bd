"""Train/test splits: stratified by label set, or at random; gates, ratios and divergence.

Rows are ordered by md5(seed:id), so a split is a function of seed and ids. The stratified split works on label-set
signatures, each of which has a quota; the greedy one on labels and pairs of labels, the rarest first.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled, written
from .labels import NEGATIVE, exploded, with_negative

SEED = 1240
TEST_SIZE = 0.25
SHARE_BAND = (0.65, 0.85)
MOST_JS = 0.05
EPSILON = 1e-12
#: Up to this count, units of equal count are a round of the greedy split; beyond, those between it times two powers of two.
ALONE = 16


def seeded(seed: int, id: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))


def signature(labels: str = "labels") -> Column:
    return F.array_join(F.array_sort(F.coalesce(labels, F.array().cast("array<string>"))), "|")


def simple_quota(n: Column, test_size: float = TEST_SIZE) -> Column:
    return F.floor(n * F.lit(test_size) + 0.5)


def _folded(keyed: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """Rows to test up to their signature's quota. A signature may hold most rows: the cut is found by hash, not by ranking it in one task."""
    spread = keyed.withColumns({"_order": seeded(seed), "_slice": F.conv(F.substring(seeded(seed), 1, 3), 16, 10).cast("int")})
    within = Window.partitionBy("signature", "_slice").orderBy("_order", "id")
    sizes = spread.groupBy("signature", "_slice").agg(F.count("*").alias("_n"))  # 4096 rows for a signature at most
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("signature").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("signature", "_slice", before.alias("_before"))
    ranked = spread.withColumn("_at", F.row_number().over(within)).join(starts, ["signature", "_slice"]).join(quota, "signature")
    return ranked.withColumn("fold", F.when(F.col("_at") + F.col("_before") <= F.col("quota"), "test").otherwise("train"))


def stratified_split(records: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED, greedy: bool = False) -> DataFrame:
    """(id, labels, fold). Empty sets are a stratum of their own. `greedy` keeps each label's share where most label sets are of few rows."""
    if greedy:
        return greedy_split(records, test_size, seed)
    keyed = records.select("id", "labels").withColumn("signature", signature())
    quota = keyed.groupBy("signature").agg(F.count("*").alias("n")).select("signature", simple_quota(F.col("n"), test_size).alias("quota"))
    return _folded(keyed, quota, seed).select("id", "labels", "fold")


def _round_of(n: Column) -> Column:
    return (F.least(n, F.lit(ALONE)) + F.greatest(F.floor(F.log2(F.floor(n / ALONE))), F.lit(0))).cast("int")


def greedy_split(records: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED, pairs: bool = True, literal: int = 4096) -> DataFrame:
    """(id, labels, fold): iterative stratification by units, the labels and (with `pairs`) every two labels that stand together.

    A row belongs to the wave of its rarest unit, so each row is dealt once. Waves of units of like rarity (equal counts up to
    ALONE, then counts between two powers of two) are one round, rarest first; a round gives each of its units what the test fold still lacks of it, as a share of
    the rows that are still to deal. Within a wave rows stand by label set and seeded order, and places are taken at equal steps:
    sets of many rows keep their share, and sets of one row together do. A label of two rows or more gets one of them at
    least, if a row of its wave is left. One aggregate a round, over that round's rows only, so rounds grow with the
    logarithm of the number of rows; the driver holds a count for each unit, never rows or label sets. Up to `literal` units are sent as an expression, more are joined.
    """
    none = F.array().cast("array<string>")
    keyed = records.select("id", "labels").withColumn("_set", F.array_sort(F.array_distinct(F.array_compact(F.coalesce("labels", none)))))
    # a label stands for itself, two labels as an array of both, a row without any for the empty array
    two = F.flatten(F.transform("_set", lambda x, i: F.transform(F.slice("_set", i + 2, F.size("_set")), lambda y: F.array(x, y)))) if pairs else F.array().cast("array<array<string>>")
    units = F.when(F.size("_set") == 0, F.array(none)).otherwise(F.concat(F.transform("_set", lambda x: F.array(x)), two))
    keyed = keyed.withColumn("_units", F.transform(units, lambda u: F.to_json(u)))
    counted = settled(keyed.select(F.explode("_units").alias("unit")).groupBy("unit").agg(F.count("*").alias("n")))
    total = {r.unit: r.n for r in counted.collect()}  # a row for each unit
    if not total:
        return records.select("id", "labels", F.lit("train").alias("fold"))
    if len(total) <= literal:
        sizes = F.create_map(*(y for u, n in total.items() for y in (F.lit(u), F.lit(n))))
        placed = keyed.withColumn("_rarest", F.array_min(F.transform("_units", lambda u: F.struct(sizes[u].alias("n"), u.alias("unit")))))
    else:
        rarest = keyed.select("id", F.explode("_units").alias("unit")).join(counted, "unit").groupBy("id").agg(F.min(F.struct("n", "unit")).alias("_rarest"))
        placed = keyed.join(rarest, "id")
    placed = placed.select("id", "labels", "_units", F.col("_rarest.unit").alias("_wave"), _round_of(F.col("_rarest.n")).alias("_round"), F.array_join("_set", "|").alias("_signature"), seeded(seed).alias("_order"))
    order = ["_round", "_wave", "_signature", "_order", "id"]
    drawn = settled(placed.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))  # ranges are drawn by sampling: once
    ranges = drawn.groupBy("_wave", "_range").agg(F.count("*").alias("_n"))  # a row for each wave of each range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_wave").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("_wave", "_range", before.alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range", "_wave").orderBy(*order[2:])) + F.col("_before")
    ranked = written(drawn.join(starts, ["_wave", "_range"]).withColumn("_at", at).drop("_before", "_range"), "_round")
    n_of = {r[0]: r[1] for r in ranges.groupBy("_wave").agg(F.sum("_n")).collect()}
    waves: dict[int, list[str]] = {}
    for unit in n_of:
        waves.setdefault(min(total[unit], ALONE) + max(0, (total[unit] // ALONE).bit_length() - 1), []).append(unit)

    have, left, need = dict.fromkeys(total, 0), dict(total), {}
    spark = records.sparkSession
    dealt = lambda rows, few: rows.join(F.broadcast(spark.createDataFrame([(u, need[u], n_of[u]) for u in few], "_wave string, _need long, _of long")), "_wave")  # noqa: E731  # at most a row for each unit
    taken = F.floor(F.col("_at") * F.col("_need") / F.col("_of")) > F.floor((F.col("_at") - 1) * F.col("_need") / F.col("_of"))
    single = {u: json.loads(u) for u in total}
    name_of = {s[0]: u for u, s in single.items() if len(s) == 1}
    near = {u: sorted((total[name_of[x]], x) for x in s) for u, s in single.items()}
    rate = lambda u: min(max((total[u] * test_size - have[u]) / max(left[u], 1), 0.0), 1.0)  # noqa: E731  # what the test fold lacks, as a share of the rows still to deal
    for k in sorted(waves):
        groups: dict[tuple, list[str]] = {}
        for u in sorted(waves[k], key=lambda u: (near[u], u)):
            groups.setdefault(tuple(near[u][:1]), []).append(u)
        owed = 0.5  # parts of rows go over to the next wave
        for rarest, units_of in groups.items():
            # together the waves of one rare label take what that label lacks
            base = rate(name_of[rarest[0][1]]) if rarest else test_size
            wanted = {u: n_of[u] * rate(u) for u in units_of}
            whole, given = sum(wanted.values()), base * sum(n_of[u] for u in units_of)
            for u in units_of:
                owed += min(wanted[u] * given / whole if whole else n_of[u] * base, n_of[u])
                need[u] = min(math.floor(owed), n_of[u])
                owed -= need[u]
                if len(single[u]) == 1 < total[u] and not need[u] and not have[u] and n_of[u]:
                    need[u] = 1
        done = dealt(ranked.where(F.col("_round") == k), waves[k]).select(F.explode("_units").alias("unit"), taken.alias("_taken"))
        for r in done.groupBy("unit").agg(F.count("*").alias("n"), F.count_if("_taken").alias("taken")).collect():
            have[r.unit] += r.taken
            left[r.unit] -= r.n
    return dealt(ranked, list(n_of)).select("id", "labels", F.when(taken, "test").otherwise("train").alias("fold"))


def pair_counts(split: DataFrame) -> DataFrame:
    """(a, b, total, test): how often two labels stand together, in all and in the test fold."""
    sets = split.select("fold", F.array_sort(F.array_distinct(F.array_compact("labels"))).alias("s"))
    each = sets.select("fold", F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return each.groupBy("p.a", "p.b").agg(F.count("*").alias("total"), F.count_if(F.col("fold") == "test").alias("test"))


def random_split(df: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED, round_up: bool = False) -> DataFrame:
    """(id, fold): max(1, floor or ceil of n * test_size) rows go to test."""
    n = F.col("n") * F.lit(test_size)
    keyed = df.select("id").withColumn("signature", F.lit(""))
    quota = df.agg(F.count("*").alias("n")).select(F.lit("").alias("signature"), F.greatest(F.lit(1), F.ceil(n) if round_up else F.floor(n)).alias("quota"))
    return _folded(keyed, quota, seed).select("id", "fold")


def fold_counts(split: DataFrame, *, labels: str = "labels") -> DataFrame:
    """(label, total, train, test, train_share) in one pass."""
    test = F.count_if(F.col("fold") == "test")
    by = exploded(split, "fold", labels=labels).groupBy("label").agg(F.count("*").alias("total"), (F.count("*") - test).alias("train"), test.alias("test"))
    return by.withColumn("train_share", F.round(F.col("train") / F.col("total"), 6))


def js_divergence(split: DataFrame) -> DataFrame:
    """One row: js, of the labels' shares in the two folds, natural logarithm."""
    sizes = split.agg(F.count_if(F.col("fold") == "train").alias("n_train"), F.count_if(F.col("fold") == "test").alias("n_test"))
    p = F.col("train") / F.greatest("n_train", F.lit(1)) + EPSILON
    q = F.col("test") / F.greatest("n_test", F.lit(1)) + EPSILON
    shares = fold_counts(split).withColumns({c: sizes.select(c).scalar() for c in ("n_train", "n_test")}).select(p.alias("p"), q.alias("q"))
    whole = shares.agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"))
    scaled = shares.withColumns({c: whole.select(c).scalar() for c in ("ps", "qs")}).select((F.col("p") / F.col("ps")).alias("p"), (F.col("q") / F.col("qs")).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    return scaled.agg(F.round(F.coalesce((F.sum(F.col("p") * F.ln(F.col("p") / F.col("m"))) + F.sum(F.col("q") * F.ln(F.col("q") / F.col("m")))) / 2, F.lit(0.0)), 9).alias("js"))


def gates(split: DataFrame, band: tuple[float, float] = SHARE_BAND, most_js: float = MOST_JS) -> DataFrame:
    """One row: absent labels, labels out of the band, js, and passed."""
    share = F.col("train") / F.col("total")
    bad = fold_counts(split).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("test") == 0, F.col("label")))), ",").alias("absent"),
        F.array_join(F.array_sort(F.collect_list(F.when(~share.between(*band), F.col("label")))), ",").alias("out_of_band"),
    )
    one = bad.withColumn("js", js_divergence(split).scalar())
    return one.withColumn("passed", (F.col("absent") == "") & (F.col("out_of_band") == "") & (F.col("js") < most_js))


def check_gates(split: DataFrame, **limits) -> float:
    """The divergence; all failures are raised together."""
    row = gates(split, **limits).first()
    if not row.passed:
        raise RuntimeError(f"split gates failed: absent from test: [{row.absent}]; share out of band: [{row.out_of_band}]; divergence: {row.js}")
    return row.js


def manifest(split: DataFrame, seed: int = SEED, test_size: float = TEST_SIZE) -> DataFrame:
    """One row: seed, sizes, actual_test_ratio, js."""
    sizes = split.agg(F.count("*").alias("n_total"), F.count_if(F.col("fold") == "train").alias("n_train"), F.count_if(F.col("fold") == "test").alias("n_test"))
    ratio = F.try_divide(F.col("n_test").cast("double"), F.col("n_total").cast("double"))
    return sizes.withColumn("js", js_divergence(split).scalar()).select(F.lit(seed).alias("seed"), F.lit(test_size).alias("test_size"), "n_total", "n_train", "n_test", F.round(ratio, 6).alias("actual_test_ratio"), "js")


def full_manifest(split: DataFrame, seed: int = SEED, test_size: float = TEST_SIZE, stratifier: str = "pairs of labels, in rounds") -> dict:
    """The manifest as one object: sizes, divergence, each label's counts and share, and how the split was made."""
    row = manifest(split, seed, test_size).first().asDict()
    ratios = {r.label: {"total": r.total, "train": r.train, "test": r.test, "train_share": round(r.train_share, 4)} for r in fold_counts(split).orderBy("label").collect()}  # a row for each label
    named = {"stratifier": stratifier, "version": split.sparkSession.version, "neg_class_used_for_stratification": NEGATIVE}
    return row | {"js_divergence_train_test": round(row["js"], 4), "per_label_ratios": ratios} | named


def for_stratifying(records: DataFrame) -> DataFrame:
    return with_negative(records)
