"""Terms of a large lexicon in texts: the texts' different pieces are met by the terms, then the texts by their pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled, spread

#: Characters of a beginning, terms (or pieces) that are sent to all tasks (some 100 bytes each), and places of a piece.
GRAM, SENT, PIECE = 8, 1 << 18, 256


def _class_of(codes: list[int]) -> str:
    """A regex class of these code points, as ranges."""
    ends: list[list[int]] = []
    for c in sorted(codes):
        if ends and ends[-1][1] == c - 1:
            ends[-1][1] = c
        else:
            ends.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ends) + "]"


def lexicon_matches(df: DataFrame, terms: DataFrame, text: str = "text", id: str = "id", term: str = "term", gram: int = GRAM) -> DataFrame:
    """(id, term, places): every term that stands anywhere in a text, as a part of words too, and how often, overlaps counted.

    A text is cut where a character stands that no term has, and long runs after every PIECE places, each piece with as much more as the longest
    term needs. Equal pieces are looked up once: a place by the first `gram` characters from there (or fewer, for shorter terms), then by the lengths
    that terms of this beginning have, each by equality. So a place costs as many look-ups as there are such lengths, however many terms
    begin alike. Up to SENT terms, beginnings or pieces are sent to all tasks, more are met by a shuffle.
    Null texts and empty or null terms match nothing; a term given twice counts once, rows of equal ids count together.
    """
    known = settled(terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct())
    n, longest, shortest = known.agg(F.count("*"), F.max(F.length("term")), F.min(F.length("term"))).first()
    if not n:
        return df.select(id).limit(0).select(id, F.lit("").alias("term"), F.lit(0).cast("long").alias("places"))
    letters = known.select(F.explode(F.array_distinct(F.regexp_extract_all("term", F.lit("(?s)."), F.lit(0)))).alias("c")).distinct()
    of = _class_of([ord(r[0]) for r in letters.collect()])
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?=({of}{{1,{PIECE + longest - 1}}})){of}{{1,{PIECE}}}"), F.lit(1))
    pieces = spread(df.select(id, text)).select(id, F.explode(cut).alias("_piece")).where(F.length("_piece") >= shortest)
    sent = lambda frame, rows: F.broadcast(frame) if rows <= SENT else frame

    beginnings = settled(known.groupBy(F.substring("term", 1, gram).alias("_key")).agg(F.collect_set(F.length("term")).alias("_sizes")))
    sizes = sorted(r[0] for r in beginnings.select(F.length("_key")).distinct().collect())  # 1 to `gram`
    at = F.sequence(F.lit(1), F.least(F.length("_piece") - (shortest - 1), F.lit(PIECE)))
    rests = F.explode(F.transform(at, lambda i: F.substr(F.col("_piece"), i, F.lit(longest)))).alias("_rest")
    here = pieces.select("_piece").distinct().where(F.length("_piece") >= shortest).select("_piece", rests)
    keys: Column = F.array_distinct(F.array(*(F.substring("_rest", 1, k) for k in sizes)))
    probes = here.select("_piece", "_rest", F.explode(keys).alias("_key")).join(sent(beginnings, beginnings.count()), "_key")
    tried = probes.select("_piece", "_rest", F.explode("_sizes").alias("_size")).where(F.length("_rest") >= F.col("_size"))
    met = tried.select("_piece", F.substr("_rest", F.lit(1), F.col("_size")).alias("term")).join(sent(known, n), "term")
    found = settled(met.groupBy("_piece", "term").agg(F.count("*").alias("_times")))
    return pieces.join(sent(found, found.count()), "_piece").groupBy(id, "term").agg(F.sum("_times").alias("places"))
