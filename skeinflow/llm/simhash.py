"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison, then connected.

Fingerprints of equal value are one from then on. With radius r the 64 bits are cut into r + e parts, of which any two
fingerprints in reach share at least e, so each pair in reach meets in a bucket of e equal parts. e is 2 (15 tables of
21 bits at radius 4), and grows with the number of fingerprints so that buckets don't: 3 (35 tables of 27 bits) from
about 10**8 on, 4 (70 tables of 32 bits) from about 10**10. Buckets of more than SLICE fingerprints are dealt to slices, and every two slices meet in a cell of their own: nothing is capped, and
no task holds more than two slices. A cell stores its fingerprints as bit planes (64 lanes a word). The distances of
all lanes are counted at once by carry-save adders, plane by plane, and words whose lanes all lie beyond the radius are
abandoned. A cell gives a forest of its links, not its pairs; the forests are connected in Spark.

Radius 4 of 64 bits reaches texts of a similarity of about 0.95 only. `similar_groups` reaches a given Jaccard similarity
of the sets of shingles (0.8 of five words by default): its fingerprints have WIDE bits, of which texts of similarity s
differ in a share acos(2s / (1 + s)) / pi, with a radius of MARGIN standard deviations more: of pairs of similarity 0.8
97% link, of 0.85 nearly all, of 0.75 half, of 0.7 one in fourteen; unrelated texts differ in half of the bits. No cut
into equal parts serves such a radius, so two texts meet in a bucket if they share two of their LEAST least shingle
hashes, as 99% of those of similarity 0.8 do. Slices, bit planes and forests are the same. These links only say who is
to be compared: a second pass, over the groups that they make, takes a pair in reach as linked if the Jaccard similarity
of its sets (of 32-bit hashes of the shingles, so that of 20,000 shingles one is mistaken in ten pairs) is large enough.
A pair that fails hides no other: pairs are checked until one joins their groups. A group of at most SLICE fingerprints
and SLICE_BYTES of sets is one cell, so its sets are sent once; a larger one meets in the buckets of its members.

A null or empty text has the fingerprint zero and is linked like any other. Rows with equal texts share a fingerprint;
a null id never names a component unless all ids in it are null. A very long text is hashed whole by the task that holds
it, in memory that grows with its length. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .cuts import cut
from .texts import map_texts, table

SEED = 42
SHINGLE = 4
RADIUS = 4
SLICE = 4096
#: Bytes of the sets of shingles in a slice.
SLICE_BYTES = 32 << 20
#: Cells up to this size are compared lane against shifted lane, many cells at once; larger ones query by query.
SMALL = 64
#: Bits of the fingerprints of similar_groups, standard deviations beyond the expected distance, shingle hashes that make buckets.
WIDE = 1024
MARGIN = 2.0
LEAST = 5
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: Parts that the rows of a component are dealt to when it is named.
SALTS = 16
#: Unrelated fingerprints that a bucket may hold on average.
BUCKET = 64
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The hash of each shingle; fewer words than `width` are one shingle, no words none."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, "<u8")
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    stops = [e - 1 for e in ends[len(ends) - n :]]
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), "<u8", n)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in more than half of the hashes, as one number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bits set in more than half of the shingles' hashes, as an unsigned number."""
    return int(majority(shingle_hashes(text, width)))


def wide_majority(hashes: np.ndarray) -> np.ndarray:
    """WIDE bits: the majority of other hashes of the same values, independent for each lane of 64 bits."""
    lanes = np.array([0x9E3779B97F4A7C15 * (lane + 1) & (1 << 64) - 1 for lane in range(WIDE // 64)], np.uint64)
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        h = (hashes[at : at + (1 << 12), None] ^ lanes) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        counts += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def wide_fingerprint(text: bytes, width: int = SIMILAR_SHINGLE) -> tuple[bytes, list[int], bytes]:
    """(WIDE bits of the set of shingles, the LEAST least of their hashes, signed, and the set as sorted hashes of 32 bits)."""
    h = np.unique(shingle_hashes(text, width))
    return wide_majority(h).tobytes(), h[:LEAST].view("<i8").tolist(), np.unique((h >> np.uint64(32)).astype("<u4")).tobytes()


def similar(a: bytes, b: bytes, least: float) -> bool:
    """Whether two sets of hashes have this Jaccard similarity or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-6:
        return False
    both = np.concatenate((np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= least * (len(both) - shared) - 1e-9


def radius_of(similarity: float, bits: int = WIDE, margin: float = MARGIN) -> int:
    """The number of differing bits that reaches texts of this Jaccard similarity."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row k holds bit k of each fingerprint (a number, or a row of them), 64 lanes a word; spare lanes are 0."""
    rows = np.ascontiguousarray(prints.reshape(len(prints), -1)).astype("<u8")
    rows = np.concatenate((rows, np.zeros((-len(prints) % 64, rows.shape[1]), "<u8")))
    bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def _beyond(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, bits low to high, exceeds the radius."""
    more, same = np.zeros_like(over), np.full_like(over, _FULL)
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            same &= counter[i]
        else:
            more |= same & counter[i]
            same &= ~counter[i]
    return over | more


def lanes_within(differing, n_planes: int, shape: tuple[int, ...], radius: int, among: np.ndarray | None = None) -> np.ndarray:
    """Lanes in which at most `radius` of the planes differ. differing(k, where) gives the differing lanes of plane k for the words `where` (flat indices).

    With `among` only those words are looked at; the others have no lanes.
    """
    size = int(np.prod(shape))
    where = np.arange(size) if among is None else among
    counter = [np.zeros(len(where), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(where), np.uint64)
    for k in range(n_planes):
        carry = differing(k, where)
        for i, c in enumerate(counter):  # a carry-save step: add one bit to each lane's counter
            counter[i], carry = c ^ carry, c & carry
        over |= carry
        if k % 8 == 7:  # give up words whose lanes all lie beyond the radius
            live = np.flatnonzero(_beyond(counter, over, radius) != _FULL)
            if len(live) < 0.75 * len(where):
                where, over, counter = where[live], over[live], [c[live] for c in counter]
                if not len(where):
                    break
    out = np.zeros(size, np.uint64)
    out[where] = ~_beyond(counter, over, radius)
    return out.reshape(shape)


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8), bitorder="little").astype(bool)


def link_small(cells: np.ndarray, prints: np.ndarray, radius: int, check=None) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions) within many small cells that stand one after the other: each lane against the lane `shift` further on.

    With check(a, b), a pair in reach links only if it passes; pairs that others have joined already aren't checked.
    """
    n = len(prints)
    p = planes(prints)
    p = np.concatenate((p, np.zeros((len(p), 2), np.uint64)), axis=1)
    found_a, found_b = [], []
    for shift in range(1, n):
        same = cells[shift:] == cells[:-shift]
        if not same.any():
            break
        word, bit = divmod(shift, 64)
        words = (n - shift + 63) // 64

        def differing(k, where, word=word, bit=bit):
            far = p[k, where + word] if not bit else p[k, where + word] >> np.uint64(bit) | p[k, np.minimum(where + word + 1, p.shape[1] - 1)] << np.uint64(64 - bit)
            return p[k, where] ^ far

        near = np.flatnonzero(_lanes(lanes_within(differing, len(p), (words,), radius))[: n - shift] & same)
        found_a.append(near)
        found_b.append(near + shift)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
    label = np.arange(n)
    if check:
        return _checked(label, a.tolist(), b.tolist(), check)
    while len(a):  # least position reachable within the cell: what is left are the forest's links
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _checked(label: np.ndarray, a: list[int], b: list[int], check) -> tuple[np.ndarray, np.ndarray]:
    """The forest of those pairs that pass the check, as links to the least position of each tree."""
    up = label.tolist()

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, j in zip(a, b):
        x, y = top(i), top(j)
        if x != y and check(i, j):
            up[max(x, y)] = min(x, y)
    label = np.array([top(x) for x in range(len(up))], np.int64)
    child = np.flatnonzero(label != np.arange(len(up)))
    return child, label[child]


def link_large(prints: np.ndarray, radius: int, together: int = 128, check=None) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions) within one large cell: `together` queries at a time against all its lanes.

    Lanes stand by the group that they belong to so far, and a query skips words that hold its own group only, so a group
    of copies that fills a cell costs little more than its first queries. With check(a, b), a query meets another group if
    one of the group's lanes in reach passes; each pair is checked once at most, by the query that stands first.
    """
    n = len(prints)
    p = planes(prints)
    used = [k for k in range(len(p)) if (p[k] != p[k][0]).any() or p[k][0] not in (0, _FULL)]  # the others are equal throughout
    label = np.arange(n)
    at, until = 0, together
    while at < n:
        order = np.argsort(label, kind="stable")
        p = planes(prints[order])
        width = p.shape[1]
        while at < min(n, until):
            q = prints[at : at + together]
            own = np.unpackbits(np.ascontiguousarray(q.reshape(len(q), -1)).astype("<u8").view(np.uint8), axis=1, bitorder="little")
            bits = np.where(own[:, used].T, _FULL, np.uint64(0)).reshape(len(used), len(q))
            groups = label[np.r_[order, np.repeat(order[-1], width * 64 - n)]].reshape(width, 64)
            alone = np.where(groups.min(1) == groups.max(1), groups[:, 0], -1)
            among = np.flatnonzero(label[at : at + len(q), None] != alone)

            def differing(k, where, p=p, bits=bits, width=width):
                return p[used[k], where % width] ^ bits[k, where // width]

            near = lanes_within(differing, len(used), (len(q), width), radius, among) if len(among) else np.zeros((len(q), 0), np.uint64)
            for row in np.flatnonzero(near.any(1)):
                lanes = order[np.flatnonzero(_lanes(near[row])[:n])]
                if check:
                    lanes = lanes[(lanes > at + row) & (label[lanes] != label[at + row])]
                    lanes = np.array([own[passed] for g in np.unique(label[lanes]) for own in [lanes[label[lanes] == g]] for passed in [next((k for k, x in enumerate(own) if check(at + row, x)), None)] if passed is not None], np.int64)
                met = np.r_[label[at + row], label[lanes]]
                least, most = met.min(), met.max()
                if least < most:
                    mark = np.zeros(n, bool)
                    mark[met] = True
                    label[mark[label]] = least
            at += len(q)
        until *= 4
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def forest(cells: np.ndarray, prints: np.ndarray, radius: int, check=None) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions) between fingerprints that stand in the same cell (cells are sorted), lie in reach and pass the check, if there is one."""
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, len(cells)])
    out = []
    in_small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    if in_small.any():
        at = np.flatnonzero(in_small)
        a, b = link_small(cells[at], prints[at], radius, check and (lambda i, j: check(at[i], at[j])))
        out.append((at[a], at[b]))
    for s, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        a, b = link_large(prints[s : s + size], radius, check=check and (lambda i, j, s=s: check(s + i, s + j)))
        out.append((s + a, s + b))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def parts(radius: int, equal: int = 2) -> list[tuple[int, int]]:
    """(first bit, bits) of the radius + equal parts of a fingerprint."""
    n = radius + equal
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def equal_parts(n: int, radius: int) -> int:
    """How many parts make a bucket, so that n fingerprints that have nothing in common fill it with BUCKET at most."""
    return next((e for e in (2, 3) if n >> 64 * e // (radius + e) <= BUCKET), 4)


def links(prints: DataFrame, radius: int = RADIUS, slice_rows: int = SLICE, equal: int | None = None) -> DataFrame:
    """From distinct fingerprints (fp): links (u, v) that connect all of them that lie in reach of each other."""
    equal = equal or equal_parts(prints.count(), radius)
    part = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << n) - 1) for a, n in parts(radius, equal)]
    keys = [F.xxhash64(F.lit(t), *(part[i] for i in chosen)) for t, chosen in enumerate(combinations(range(len(part)), equal))]
    return _linked(prints.select("fp", F.explode(F.array(*keys)).alias("bucket")), radius, slice_rows)


def _pairs_of_least() -> Column:
    return F.flatten(F.transform("least", lambda a, i: F.transform(F.slice("least", i + 2, F.lit(LEAST)), lambda b: F.xxhash64(a, b))))


def wide_links(prints: DataFrame, radius: int, slice_rows: int = SLICE) -> DataFrame:
    """From distinct (fp, print, least): links (u, v) of the fp whose prints lie in reach of each other and that share two of their least hashes."""
    return _linked(prints.select("fp", "print", F.explode(_pairs_of_least()).alias("bucket")), radius, slice_rows)


def checked_links(printed: DataFrame, distinct: DataFrame, loose: DataFrame, radius: int, similarity: float, slice_rows: int = SLICE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The links (u, v) within the groups `loose` (u, root) of distinct (fp, least, n_set) whose prints lie in reach and whose sets are as similar as asked.

    printed has (fp, print, set), rows repeated. Sets travel once, or by the buckets of their fingerprint where a group is too large for a cell.
    """
    member = distinct.select("fp", "least", "n_set").join(loose, F.col("fp") == F.col("u"), "left").select("fp", "least", "n_set", F.coalesce("root", "fp").alias("root"))
    small = (F.count("*") <= slice_rows) & (4 * F.sum("n_set") <= slice_bytes)
    groups = member.groupBy("root").agg(small.alias("small"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = F.when(F.col("small"), F.array(F.xxhash64(F.lit("group"), "root"))).otherwise(_pairs_of_least())
    spread = cut(_told(member, groups, "inner").select("fp", "n_set", F.explode(buckets).alias("bucket")))
    sets = printed.groupBy("fp").agg(F.first("print").alias("print"), F.first("set").alias("set")).withColumnRenamed("fp", "_fp")
    cells = _cells(spread, slice_rows, 4 * F.sum("n_set") / slice_bytes).select("cell", "fp")
    return _compared(cells.join(sets, F.col("fp") == F.col("_fp")).select("cell", "fp", "print", "set"), radius, similarity)


def _told(member: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """Rows (fp, root) with the facts of their root, in columns of other names. A root may hold most rows: its facts meet them in SALTS parts."""
    facts = facts.withColumnRenamed("root", "_root").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = member.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    return salted.join(facts, (F.col("root") == F.col("_root")) & (F.col("salt") == F.col("_salt")), how)


def _cells(spread: DataFrame, slice_rows: int, fill: Column | None = None) -> DataFrame:
    """From rows (fp, bucket, more): rows (cell, fp, more) for buckets of several rows. A bucket has a slice for each slice_rows, or for each unit of the aggregate `fill`, if those are more."""
    own = [c for c in spread.columns if c != "bucket"]
    slices = [F.ceil(x).cast("int") for x in (F.count("*") / slice_rows, *([] if fill is None else [fill]))]
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n"), (F.greatest(*slices) if len(slices) > 1 else slices[0]).alias("slices")).where("n > 1")
    met = spread.join(sizes, "bucket")
    at = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    cells = met.select(*own, "bucket", at.alias("own"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    return cells.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), *own)


def _linked(spread: DataFrame, radius: int, slice_rows: int) -> DataFrame:
    """From rows (fp, bucket), with `print` where that isn't fp itself: links within buckets."""
    return _compared(_cells(spread, slice_rows), radius)


def _compared(cells: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """From rows (cell, fp), with `print` where that isn't fp itself and then with `set` where similarity is to be checked: links within cells."""
    width = len(cells.columns)

    def run(batches):
        held = []
        for batch in batches:
            held = [np.concatenate(x) for x in zip(held, columns(batch))] if held else columns(batch)
            last = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last cell may go on
            yield linked(*(x[:last] for x in held))
            held = [x[last:] for x in held]
        if held:
            yield linked(*held)

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        cell, fp = (batch.column(i).to_numpy() for i in (0, 1))
        prints = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(len(fp), -1) if width > 2 else fp.view(np.uint64)
        if width < 4:
            return [cell, fp, prints]
        sets = np.empty(len(fp), object)
        sets[:] = batch.column(3).to_pylist()
        return [cell, fp, prints, sets]

    def linked(cell: np.ndarray, fp: np.ndarray, prints: np.ndarray, sets: np.ndarray | None = None) -> pa.RecordBatch:
        check = None if sets is None else (lambda i, j: similar(sets[i], sets[j], similarity))
        u, v = forest(cell, prints, radius, check) if len(cell) else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(fp[x]) for x in (u, v)], names=["u", "v"])

    return cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(df: DataFrame, keep: list[str], by: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row of df: `keep`, fp (the fingerprint as a signed long), component_id (the least `by` that its links reach)."""

    def rows_of(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"fp": pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))}

    return _grouped(df, keep, by, text, rows_of, "fp bigint", [], lambda _, distinct: links(distinct.select("fp"), radius))


def similar_groups(df: DataFrame, keep: list[str], by: str = "doc_id", text: str = "text", width: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """As near_duplicates, with links between texts whose sets of shingles have this Jaccard similarity or more; fp is a hash of the wide fingerprint."""

    def rows_of(texts: list[bytes]) -> dict[str, pa.Array]:
        prints, least, sets = zip(*(wide_fingerprint(t, width) for t in texts)) if texts else ((), (), ())
        h = np.array([xxhash.xxh64_intdigest(p, SEED) for p in prints], np.uint64).view(np.int64)
        return {"fp": pa.array(h), "print": pa.array(prints, pa.binary()), "least": pa.array(least, pa.list_(pa.int64())), "n_set": pa.array([len(x) // 4 for x in sets], pa.int64()), "set": pa.array(sets, pa.binary())}

    radius = radius_of(similarity)

    def link(printed: DataFrame, distinct: DataFrame) -> DataFrame:
        loose = components(wide_links(distinct.select("fp", "print", "least"), radius))
        return checked_links(printed, distinct, loose, radius, similarity)

    return _grouped(df, keep, by, text, rows_of, "fp bigint, print binary, least array<bigint>, n_set bigint, set binary", ["print", "least", "n_set"], link)


def _grouped(df: DataFrame, keep: list[str], by: str, text: str, rows_of, schema: str, more: list[str], link) -> DataFrame:
    inner = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(by).alias("_by"), F.col(text).alias("text"))
    held = [f"_k{i}" for i in range(len(keep))]
    printed = cut(map_texts(inner, rows_of, schema, [*held, "_by"]))
    distinct = cut(printed.groupBy("fp").agg(F.min("_by").alias("first"), *(F.first(c).alias(c) for c in more)))
    rooted = components(link(printed, distinct))
    member = distinct.select("fp", "first").join(rooted, F.col("fp") == F.col("u"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # who is alone needs no name
    named = member.groupBy("root").agg(F.min("first").alias("named"), F.count("*").alias("n")).where("n > 1").drop("n")
    classes = _told(member, named, "left").select(F.col("fp").alias("_fp"), F.coalesce("named", "first").alias("component_id"))
    return printed.join(classes, F.col("fp") == F.col("_fp")).select(*(F.col(a).alias(b) for a, b in zip(held, keep)), "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
