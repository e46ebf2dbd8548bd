"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, with DataFrame functions only.

A text's paragraphs are its lines, long lines cut at the first sentence end after PIECE code points. Pieces of more than
`longest` code points are cut on: after a word whose hash marks an end, so that cuts survive edits elsewhere; where
`longest` has no such word, at its last space, or else at `longest`. Each paragraph gives a digest: 48 bits of its hash
and 15 bits of its length. A text's set of digests is hashed into cells (a count, the XOR of digests and of their check
values) of three subtables; that is its sketch, and the one of 3 * WRITTEN cells is its fingerprint as written.

Two versions are compared by their sketches: the cells of one are subtracted from those of the other, so what they share
cancels, and peeling takes a cell that holds one digest, gives that digest up and subtracts it from its other two cells.
When nothing is left, the digests that differ are recovered. How many will differ is expected from a sample (digests of
one hash value in SAMPLED): if hardly any, the two written fingerprints are compared, within the row; else both texts are
hashed into as many cells as that needs. Pairs that can't be peeled are tried again with four times the cells.
Likeness is the share of both texts' lengths in paragraphs that don't differ, 1 for two empty texts.

Each text is dealt once, by a key of its id and hash. It sends its start and its digests to the document before it, whose
order is found by range with ids and sizes only. Larger tables are rows keyed by document and cell: building, subtracting
and peeling are aggregations that stay where the text was dealt, so no digest is shuffled again but those of failed pairs.

A null text counts as empty. Null ids come last, together as one id. Rows with the same id stand in order of a hash of
their texts; rows with the same id and text are one for all work, with the same next document (the one after them, or
themselves if there is no other), and come out as often as they came in. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cuts import cut
from .texts import table

PIECE = 80
LONGEST = 300
#: One word in so many, by its hash, ends a part of a long piece.
ENDS = 8
#: Words with the space before them; above U+2E80, where scripts have no spaces, each code point.
_UNIT = r"\s*[\x21-\x{2E7F}]{1,64}|\s*\S|\s+"
#: Cells of a written fingerprint in each of its three subtables, and the differing digests it is used for.
WRITTEN = 4
FEW = 4
#: One digest in so many, by its hash, is in the sample that the expected difference comes from.
SAMPLED = 4
ROUNDS = 6
_LENGTH = (1 << 15) - 1
_SIGN = 1 << 15
#: A row's cell: which pair, log2 of the cells of a subtable (or TOLD: the length recovered so far), subtable, place.
_PAIR, _BITS, _SUBTABLE, _TOLD = 62, 56, 54, 63
PAIRS = ("edit", "next")


def shorter(piece: Column, longest: int) -> Column:
    """A piece's parts of at most `longest` code points; lines hold no line end, so one marks where a part may end."""
    units = F.regexp_extract_all(piece, F.lit(_UNIT), F.lit(0))
    marked = F.array_join(F.transform(units, lambda u: F.when(F.pmod(F.xxhash64(F.trim(u)), F.lit(ENDS)) == 0, F.concat(u, F.lit("\n"))).otherwise(u)), "")
    parts = F.regexp_extract_all(marked, F.lit(rf"(?s).{{{PIECE},{longest}}}?\n|.{{{PIECE},{longest}}}(?=\s)|.{{1,{longest}}}"), F.lit(0))
    return F.transform(parts, lambda p: F.replace(p, F.lit("\n"), F.lit("")))


def digests(text: Column, longest: int = LONGEST) -> Column:
    """The set of a text's paragraph digests: hash bits, then (below) a free bit for the sign and the length."""
    if not PIECE < longest <= _LENGTH:
        raise ValueError(f"longest must be more than {PIECE} and at most {_LENGTH}")
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{{PIECE},}}?[.!?](?=\s|$)|[^\n]+"), F.lit(0))
    pieces = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > longest, shorter(p, longest)).otherwise(F.array(p))))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p).bitwiseAND(~0xFFFF).bitwiseOR(F.length(p).cast("long"))))


def total_length(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, d: a + d.bitwiseAND(_LENGTH))


# the written fingerprint: a small table within a row


def _place(digest: Column, subtable: Column) -> Column:
    """A digest's place among the WRITTEN cells of a subtable: each goes by bits of its own."""
    return F.call_function("shiftrightunsigned", digest, F.lit(20) + 14 * subtable).bitwiseAND(WRITTEN - 1)


def sketch(found: Column) -> Column:
    """The table of 3 * WRITTEN cells: an array of (c, k, x)."""

    def cell(i: Column) -> Column:
        empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("x"))
        own = F.filter(found, lambda d: _place(d, F.floor(i / WRITTEN).cast("int")) == i % WRITTEN)
        return F.aggregate(own, empty, lambda a, d: F.struct((a["c"] + 1).alias("c"), a["k"].bitwiseXOR(d).alias("k"), a["x"].bitwiseXOR(F.hash(d)).alias("x")))

    return F.transform(F.sequence(F.lit(0), F.lit(3 * WRITTEN - 1)), cell)


def packed(cells: Column) -> Column:
    """A table as bytes: count, digests and check values of each cell."""
    one = lambda c: F.concat(F.lpad(F.hex(c["c"].cast("long")), 8, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["x"].cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))
    return F.unhex(F.array_join(F.transform(cells, one), ""))


def peeled(a: Column, b: Column) -> Column:
    """(apart: length of the digests recovered from table a less table b, failed)."""
    cell = lambda c, k, x: F.struct(c.alias("c"), k.alias("k"), x.alias("x"))
    apart = F.zip_with(a, b, lambda p, q: cell(p["c"] - q["c"], p["k"].bitwiseXOR(q["k"]), p["x"].bitwiseXOR(q["x"])))
    state = lambda cells, told: F.struct(cells.alias("cells"), told.alias("told"))

    def without(s: Column, p: Column) -> Column:
        left = F.transform(s["cells"], lambda c, i: F.when(_place(p["k"], F.floor(i / WRITTEN).cast("int")) == i % WRITTEN, cell(c["c"] - p["c"], c["k"].bitwiseXOR(p["k"]), c["x"].bitwiseXOR(p["x"]))).otherwise(c))
        return state(left, s["told"] + p["k"].bitwiseAND(_LENGTH))

    def step(s: Column, _: Column) -> Column:
        pure = F.slice(F.filter(s["cells"], lambda c: c["c"].isin(1, -1) & (F.hash(c["k"]) == c["x"])), 1, 1)
        return F.when(F.size(pure) == 0, s).otherwise(F.get(F.transform(pure, lambda p: without(s, p)), 0))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(3 * WRITTEN)), state(apart, F.lit(0).cast("long")), step)
    return F.struct(end["told"].alias("apart"), F.exists(end["cells"], lambda c: (c["c"] != 0) | (c["k"] != 0) | (c["x"] != 0)).alias("failed"))


def expected(a: Column, b: Column) -> Column:
    """How many digests of two sets will differ, by their samples; never more than there are."""
    sample = lambda found: F.filter(found, lambda d: F.shiftrightunsigned(d, 48).bitwiseAND(SAMPLED - 1) == 0)
    differ = (F.size(F.array_except(sample(a), sample(b))) + F.size(F.array_except(sample(b), sample(a)))).cast("double")
    return F.least(F.size(a) + F.size(b), F.ceil(FEW + SAMPLED * (differ + F.sqrt(differ))).cast("int"))


# documents, their edits and the documents after them


def following(ids: DataFrame) -> DataFrame:
    """From rows (id, hash, n_chars): the distinct ones with copies, next_id and next_hash, by falling id, round to the first."""
    ranged = ids.groupBy("id", "hash", "n_chars").agg(F.count("*").alias("copies")).repartitionByRange(F.col("id").desc_nulls_last(), F.col("hash"))
    dealt = cut(ranged.withColumn("range", F.spark_partition_id()))  # ranges are drawn by sampling, so they are drawn once
    order = [F.col("id").desc_nulls_last(), F.col("hash")]
    heads = dealt.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*order))).where("place = 1")
    # one row for each range
    across = Window.partitionBy(F.lit(1)).orderBy("range")
    this = F.struct(F.col("id"), F.col("hash"))
    heads = heads.select(F.col("range").alias("_range"), F.coalesce(F.lead(this).over(across), F.first(this).over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    within = dealt.withColumn("near", F.lead(this).over(Window.partitionBy("range").orderBy(*order)))
    met = within.join(heads, F.col("range") == F.col("_range")).withColumn("next", F.coalesce("near", "after"))
    return met.select("id", "hash", "n_chars", "copies", F.col("next.id").alias("next_id"), F.col("next.hash").alias("next_hash"))


def keyed(id: str, hash: str, names: tuple[str, str]) -> list[Column]:
    """Two longs, never null, that stand for id and text."""
    return [F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("null")), F.col(hash)).alias(names[0]), F.col(hash).alias(names[1])]


def with_edit(df: DataFrame, by: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """Per id and text of df: k1, k2 (its key), copies, id, n_chars, edited text, and the digests of it (own), of its edit and of the next document."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = df.select(F.col(by).alias("id"), whole.alias("text"), F.xxhash64(whole).alias("hash"))
    order = following(hashed.select("id", "hash", F.length("text").cast("long").alias("n_chars")))
    order = cut(order.select("id", "n_chars", "copies", *keyed("id", "hash", ("k1", "k2")), *keyed("next_id", "next_hash", ("n1", "n2"))))
    # both joins read this one exchange of the texts, at every size
    texts = hashed.select(*keyed("id", "hash", ("t1", "t2")), "text").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    start = F.substring(F.col("text"), F.lit(1), F.expr("cast(n_chars div 3 as int)"))
    sent = texts.join(order.hint("merge"), (F.col("t1") == F.col("n1")) & (F.col("t2") == F.col("n2")))
    sent = sent.select("k1", "k2", "id", "n_chars", "copies", start.alias("start"), digests(F.col("text"), longest).alias("next"))
    met = texts.join(sent.hint("merge"), (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")))
    # true of every row; as a condition on both sides it keeps all columns, so that plans of some columns reuse the same two exchanges
    met = met.where((F.col("copies") > 0) | (F.col("id").cast("string") > F.col("text")))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.expr("cast(n_chars - n_chars div 3 as int)")), F.col("start"))
    made = met.select("k1", "k2", "copies", "id", "n_chars", edited.alias("edited"), digests(F.col("text"), longest).alias("own"), "next").withColumn("edit", digests(F.col("edited"), longest))
    return made.withColumns({f"{p}_expected": expected(F.col("own"), F.col(p)) for p in PAIRS})


# larger tables: rows of cells


def _cells(digest: Column, head: Column, bits: Column, level: int) -> list[Column]:
    spot = lambda j: F.xxhash64(digest, F.lit(16 * level + j)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    return [head.bitwiseOR(j << _SUBTABLE).bitwiseOR(spot(j)) for j in range(3)]


def peel(pairs: DataFrame, level: int = 0) -> DataFrame:
    """From rows (k1, k2, pair: 0 or 1, n: digests expected to differ, a, b: arrays of digests): (k1, k2), apart and failed by pair.

    Both texts' cells are built and subtracted in one aggregation by cell, as sums of opposite sign. Of pairs that don't
    differ nothing is left; a key without a pair that differs gives no row.
    """
    bits = F.greatest(F.lit(2), F.ceil(F.log2(F.greatest("n", F.lit(1)) * (1.5 * 4**level)))).cast("int")
    head = F.shiftleft(F.col("pair").cast("long"), _PAIR).bitwiseOR(F.shiftleft(bits.cast("long"), _BITS))
    signed = F.concat("a", F.transform("b", lambda d: d.bitwiseOR(_SIGN)))
    one = pairs.select("k1", "k2", head.alias("head"), F.explode(signed).alias("d"))
    one = one.select("k1", "k2", "head", F.col("d").bitwiseAND(~_SIGN).alias("k"), F.when(F.col("d").bitwiseAND(_SIGN) == 0, 1).otherwise(-1).alias("c"))
    bits_of = lambda c: F.shiftright(c, _BITS).bitwiseAND(63).cast("int")
    rows = one.select("k1", "k2", "k", "c", F.hash("k").alias("x"), F.lit(0).cast("long").alias("apart"), F.explode(F.array(*_cells(F.col("k"), F.col("head"), bits_of(F.col("head")), level))).alias("cell"))
    made = ["cell", "c", "k", "x", "apart"]

    def summed(rows: DataFrame) -> DataFrame:
        cells = rows.groupBy("k1", "k2", "cell").agg(F.sum("c").cast("int").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("x").alias("x"), F.sum("apart").alias("apart"))
        return cells.where("apart > 0 or c <> 0 or k <> 0 or x <> 0")

    cells, told = summed(rows), (1 << _BITS) - 1
    head = F.col("cell").bitwiseAND(~told)
    for r in range(ROUNDS):
        j = r % 3
        pure = (bits_of(F.col("cell")) != _TOLD) & (F.shiftright("cell", _SUBTABLE).bitwiseAND(3) == j) & F.col("c").isin(1, -1) & (F.hash("k") == F.col("x"))
        others = [c for i, c in enumerate(_cells(F.col("k"), head, bits_of(F.col("cell")), level)) if i != j]
        nothing = [F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("x")]
        gives = [F.struct(head.bitwiseOR(_TOLD << _BITS).alias("cell"), *nothing, F.col("k").bitwiseAND(_LENGTH).alias("apart"))]
        gives += [F.struct(c.alias("cell"), (-F.col("c")).alias("c"), "k", "x", F.lit(0).cast("long").alias("apart")) for c in others]
        step = F.when(pure, F.array(*gives)).otherwise(F.array(F.struct(*made)))
        cells = summed(cells.select("k1", "k2", F.explode(step).alias("s")).select("k1", "k2", "s.*"))
    of = lambda i: F.shiftright("cell", _PAIR) == i
    left = bits_of(F.col("cell")) != _TOLD
    return cells.groupBy("k1", "k2").agg(*(x for i, p in enumerate(PAIRS) for x in (F.coalesce(F.sum(F.when(of(i), F.col("apart"))), F.lit(0)).alias(f"{p}_apart"), F.coalesce(F.max(of(i) & left), F.lit(False)).alias(f"{p}_failed"))))


def _pairs(rows: DataFrame, which: dict[str, Column]) -> DataFrame:
    """Rows (k1, k2, pair, n, a, b) of the pairs for which `which` holds."""
    of = lambda i, p: F.when(which[p], F.struct(F.lit(i).alias("pair"), F.col(f"{p}_expected").alias("n"), F.col(p).alias("b")))
    some = rows.where(which["edit"] | which["next"]).select("k1", "k2", F.col("own").alias("a"), F.explode(F.array_compact(F.array(*(of(i, p) for i, p in enumerate(PAIRS))))).alias("p"))
    return some.select("k1", "k2", "p.pair", "p.n", "a", "p.b")


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with what `found` has for their key, as columns with an underscore."""
    return rows.join(found.withColumnsRenamed({c: f"_{c}" for c in found.columns}).hint("merge"), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")


def fingerprints(df: DataFrame, by: str = "doc_id", text: str = "text", longest: int = LONGEST, most_levels: int = 8) -> DataFrame:
    """Per row of df: `by`, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    made = with_edit(df, by, text, longest)
    few = {p: F.col(f"{p}_expected") <= FEW for p in PAIRS}
    large = peel(_pairs(made, {p: ~few[p] for p in PAIRS}))
    rows = made.withColumns({f"{p}_table": sketch(F.col(p)) for p in ("own", *PAIRS)}).withColumns({f"{p}_small": F.when(few[p], peeled(F.col("own_table"), F.col(f"{p}_table"))) for p in PAIRS})
    rows = rows.withColumns({f"{p}_whole": total_length(F.col("own")) + total_length(F.col(p)) for p in PAIRS})
    met = _joined(rows, large)
    told = lambda p, what, otherwise: F.when(few[p], F.col(f"{p}_small")[what]).otherwise(F.coalesce(f"_{p}_{what}", otherwise))
    met = met.withColumns({f"{p}_failed": told(p, "failed", F.lit(False)) for p in PAIRS} | {f"{p}_apart": told(p, "apart", F.lit(0)) for p in PAIRS})
    again = F.col("edit_failed") | F.col("next_failed")
    # digests are kept only where a pair is tried again
    done = cut(met.select(
        "k1", "k2", "copies", "id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), packed(F.col("own_table")).alias("print"), packed(F.col("edit_table")).alias("edited_print"),
        *(f"{p}_{x}" for p in PAIRS for x in ("whole", "apart", "failed", "expected")), *(F.when(again, F.col(c)).alias(c) for c in ("own", *PAIRS)),
    ))

    open_, level, solved = done.where(again).select("k1", "k2", "own", *PAIRS, *(f"{p}_{x}" for p in PAIRS for x in ("failed", "expected"))), 0, None
    while not open_.isEmpty():
        level += 1
        if level > most_levels:
            raise RuntimeError("sketches could not be peeled")
        dealt = cut(open_.repartition("k1", "k2"))
        found = _joined(dealt, peel(_pairs(dealt.repartition("k1", "k2"), {p: F.col(f"{p}_failed") for p in PAIRS}), level))
        found = found.withColumns({f"{p}_apart": F.when(F.col(f"{p}_failed"), F.coalesce(f"_{p}_apart", F.lit(0))) for p in PAIRS} | {f"{p}_failed": F.col(f"{p}_failed") & F.coalesce(f"_{p}_failed", F.lit(False)) for p in PAIRS})
        found = cut(found.select(*dealt.columns, *(f"{p}_apart" for p in PAIRS)))
        right = found.select("k1", "k2", *(F.when(~F.col(f"{p}_failed"), F.col(f"{p}_apart")).alias(f"{p}_apart") for p in PAIRS))
        solved = right if solved is None else solved.unionByName(right)
        open_ = found.where(again).select(*dealt.columns)
    if solved is not None:
        solved = solved.groupBy("k1", "k2").agg(*(F.max(f"{p}_apart").alias(f"{p}_apart") for p in PAIRS))
        done = _joined(done, solved).withColumns({f"{p}_apart": F.when(F.col(f"{p}_failed"), F.col(f"_{p}_apart")).otherwise(F.col(f"{p}_apart")) for p in PAIRS})

    likeness = lambda p: F.when(F.col(f"{p}_whole") == 0, 1.0).otherwise(1 - F.col(f"{p}_apart") / F.greatest(f"{p}_whole", F.lit(1)))
    each = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")
    hexed = lambda c: F.lower(F.hex(c))
    out = done.select(
        F.col("id").alias(by), "n_chars", hexed("sha").alias("edited_sha256"), hexed("print").alias("fingerprint"), hexed("edited_print").alias("edited_fingerprint"), likeness("edit").alias("near_edited"), likeness("next").alias("near_next"), each,
    )
    return out.drop("_copy")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
