"""Text predicates and scalars as native column expressions, parameterised by character class and word list.

Null texts count as empty. Lengths are in code points. White space is what str.split() splits on: the class SPACE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex

#: Unicode white space and the four ASCII separators, as the inside of a regex character class.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


#: The same characters, as text.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


#: One character of a word, and one of white space: printable ASCII is decided first, without a look at the rest of SPACE.
WORD, GAP = f"[!-~[^{SPACE}]]", f"[{SPACE}&&[^!-~]]"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def word_count(c: Column) -> Column:
    """Each word, with the white space behind it, becomes one character: no list of words is made."""
    return F.length(F.regexp_replace(strip(text_of(c)), f"{WORD}++{GAP}*+", "x")).cast("long")


def char_count(c: Column) -> Column:
    return F.length(text_of(c)).cast("long")


def label_count(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)).cast("long")


def count_of(c: Column, chars: str) -> Column:
    """How often a regex (a character class, say) is found."""
    return F.regexp_count(text_of(c), F.lit(chars)).cast("long")


def letters_of(c: Column, chars: str) -> Column:
    """How many characters are of a class in square brackets. Runs of them are taken at once."""
    return (F.length(text_of(c)) - F.length(F.regexp_replace(text_of(c), f"{chars}++", ""))).cast("long")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), f"[{SPACE}]+", " "))


def normal_key(c: Column) -> Column:
    """The key by which texts count as the same: collapsed and lower-cased."""
    return F.lower(collapse(c))


def words(c: Column) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit(f"[^{SPACE}]+"), F.lit(0))


def first_words(c: Column, n: int = 3) -> Column:
    found = F.regexp_extract(text_of(c), f"^[{SPACE}]*+([^{SPACE}]++(?:[{SPACE}]++[^{SPACE}]++){{0,{n - 1}}})", 1)
    return F.regexp_replace(found, f"[{SPACE}]++", " ")


def contains_any(c: Column, terms: list[str], any_case: bool = False) -> Column:
    def found(within: Column) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.contains(within, F.lit(t.lower() if any_case else t))
        return out

    return F.exists(F.array(F.lower(text_of(c))), found) if any_case else found(text_of(c))  # lower-cased once, not for each term


def matched_terms(c: Column, terms: list[str]) -> Column:
    """The terms that occur in the text, in list order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text_of(c), t))


def normalize_text(c: Column, prefixes: tuple[str, ...] = ("---",)) -> Column:
    """Stripped, without the first artifact prefix that leads it; a quote that follows the prefix goes, and all quotes at the end."""
    base = strip(text_of(c))
    out = base
    for p in reversed(prefixes):
        rest = strip(F.substring(base, F.lit(len(p) + 1), F.length(base)))
        unquoted = strip(F.regexp_replace(F.substring(rest, F.lit(2), F.length(rest)), '"+$', ""))
        out = F.when(base.startswith(p), F.when(rest.startswith('"'), unquoted).otherwise(rest)).otherwise(out)
    return out


def broken_syntax(c: Column, patterns: list[str] | None = None) -> Column:
    patterns = patterns if patterns is not None else [p.replace("%s", SPACE) for p in lex.BROKEN_SYNTAX]
    return F.rlike(text_of(c), F.lit("|".join(f"(?:{p})" for p in patterns))) if patterns else F.lit(False)


def dangling(c: Column, endings: list[str]) -> Column:
    """Does the text end, but for spaces and full stops, in one of these?"""
    bare = F.regexp_replace(text_of(c), "[ .]+$", "")
    out = F.lit(False)
    for e in endings:
        out = out | bare.endswith(e)
    return out


def foreign_share(c: Column, target: str = lex.BLOCK, foreign: str = lex.LATIN) -> Column:
    """Share of foreign letters among foreign and target letters; null without letters."""
    a, b = letters_of(c, foreign), letters_of(c, target)
    return F.try_divide(a.cast("double"), (a + b).cast("double"))


def prefilter_code(c: Column, target: str = lex.BLOCK, foreign: str = lex.LATIN, most_foreign: float = 0.10, least_words: int = 5) -> Column:
    """MIXED_SCRIPT, else GIBBERISH_SHORT, else null; judged on the normalised text."""
    clean = normalize_text(c)
    mixed = F.coalesce(foreign_share(clean, target, foreign) > most_foreign, F.lit(False))
    return F.when(mixed, "MIXED_SCRIPT").when(count_of(clean, f"{target}{{2,}}") < least_words, "GIBBERISH_SHORT")


def accept_gate(c: Column, letters: str = lex.LETTERS, least_chars: int = 25, least_letters: int = 12, forbidden=lex.FORBIDDEN, meta=lex.META_TEXT, points: str = lex.VOWEL_POINTS, archaic=lex.ARCHAIC, endings=lex.DANGLING, broken=None) -> Column:
    """The acceptance conjunction, without the duplicate check; cheap terms first."""
    return (
        (char_count(c) >= least_chars) & (letters_of(c, letters) >= least_letters) & ~contains_any(c, [*forbidden, *meta], True)
        & ~F.rlike(text_of(c), F.lit(points)) & ~contains_any(c, archaic) & ~dangling(c, endings) & ~broken_syntax(c, broken)
    )


def repeated_neighbours(c: Column) -> Column:
    """Do two equal words of more than one letter stand next to each other?"""
    return F.rlike(text_of(c), F.lit(rf"(?<!{WORD})({WORD}{{2,}}+){GAP}++\1(?!{WORD})"))


def words_like(c: Column, word: str) -> Column:
    """How many words a pattern matches as a whole; it may be written with ^ and $."""
    return F.regexp_count(text_of(c), F.lit(rf"(?<!{WORD})(?:{word.removeprefix('^').removesuffix('$')})(?!{WORD})")).cast("long")


def valid_gate(c: Column, letters: str = lex.LETTERS, least_chars: int = 30, least_letters: int = 15, forbidden=lex.FORBIDDEN, phrases=lex.META_PHRASES, foreign_word: str = "^[A-Za-z]{3,}$", most_foreign: int = 3) -> Column:
    return (
        (char_count(c) >= least_chars) & (letters_of(c, letters) >= least_letters) & ~contains_any(c, [*forbidden, *phrases], True)
        & (words_like(c, foreign_word) <= most_foreign) & ~repeated_neighbours(c)
    )


def polish_gate(raw: Column, polished: Column, letters: str = lex.LETTERS, points: str = lex.VOWEL_POINTS, meta=lex.META_TEXT, archaic=lex.ARCHAIC_IN_POLISH, broken=None) -> Column:
    """Is the polished text a safe rewrite of the raw one?"""
    before, after = word_count(raw), word_count(polished)
    return (
        (char_count(polished) >= 15) & (letters_of(polished, letters) >= 10) & ~F.rlike(text_of(polished), F.lit(points)) & ~contains_any(polished, meta, True)
        & ~((before > 3) & (after < before * F.lit(0.3))) & (after <= before * F.lit(2.5)) & ~contains_any(polished, archaic) & ~broken_syntax(polished, broken)
    )


def quality_score(c: Column, slang=lex.SLANG) -> Column:
    """1 less the penalties for length, dense slang, colons, a leading quote and few words; at least 0. In steps of 0.1, held exactly as tenths."""
    n, slangs = char_count(c), F.size(matched_terms(c, slang))
    penalties = [(n < 40, 3), (n > 450, 3), (slangs > 3, 3), (slangs > 5, 3), (count_of(c, ":") > 1, 2), (F.rlike(text_of(c), F.lit("^[\"'“‘]")), 2), (word_count(c) < 5, 3)]
    tenths = F.lit(10)
    for when, by in penalties:
        tenths = tenths - F.when(when, by).otherwise(0)
    return F.greatest(tenths, F.lit(0)) / F.lit(10.0)


def strip_meta_lines(c: Column) -> Column:
    """Without one pair of quotes around it and without lines that open with a bracket; lines joined by spaces."""
    t = strip(text_of(c))
    quoted = F.rlike(t, F.lit("(?s)^[\"'“].*[\"'”]$")) & (F.length(t) >= 2)
    t = F.when(quoted, strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    lines = F.filter(F.split(t, "\r\n|[\n\r]"), lambda x: ~F.rlike(x, F.lit(rf"^[{SPACE}]*(?:\(|$)")))
    return collapse(F.array_join(lines, " "))


def polished_or_raw(raw: Column, answer: Column, **gate) -> Column:
    """A rewrite, cleaned of quotes and meta lines, if it is a safe one; else the raw text. A null answer is a failed one."""
    clean = strip_meta_lines(answer)
    return F.when(answer.isNotNull() & polish_gate(raw, clean, **gate), clean).otherwise(raw)


def phrase_shape(c: Column, nouns=lex.SUBJECT_NOUNS, asking=lex.INTERROGATIVES, prefix: str = lex.DEFINITE_PREFIX, suffixes=lex.DEFINITE_SUFFIXES) -> Column:
    """'clause' for a phrase with a subject of its own or a question, else 'verb'; judged by the first word."""
    first = first_words(c, 1)
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | first.endswith(s)
    definite = first.startswith(prefix) & (F.length(first) > 3) & ends
    return F.when(first.isin(*nouns) | definite | first.isin(*asking), "clause").otherwise("verb")


def cache_key(c: Column, version: str = "v2") -> Column:
    return F.concat(F.lit(f"{version}:"), F.sha1(text_of(c)))


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that only the parts decide (32 bits of their md5)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def pick(bank: list[str], *seed: Column) -> Column:
    """One of the bank, each with equal chance, decided by the seed."""
    return F.element_at(F.array(*map(F.lit, bank)), (F.floor(hash_uniform(*seed) * len(bank)) + 1).cast("int"))


def weighted_pick(bank: list, weights: list[int], *seed: Column) -> Column:
    """Index (from 0) of one of the bank by weight, decided by the seed."""
    u, total, at = hash_uniform(*seed) * sum(weights), 0, None
    for i, w in enumerate(weights):
        total += w
        at = F.when(u < total, i) if at is None else at.when(u < total, i)
    return at.cast("int")
