"""Substring dedup: every word that a repeated window of words covers is removed, all of its copies alike.

A window of W words that occurs twice holds, at its other place, one whole block of B = (W + 1) // 2 words at a multiple
of B. So the reference is cut into such blocks, each rolling window of B words probes the index of blocks, and only
around hits are windows of W words compared: those whose words recur are joined into maximal repeats, and their words go.

Equal texts are taken as one first (with the number of copies), so each is looked at once. Words are hashed; probes
travel as packed arrays, bucketed by hash, with two bytes for the place and four for what the bucket doesn't say
(a false hit costs a comparison, nothing else). Windows are compared by 96 bits of two rolling hashes with different
multipliers: among 10**12 different windows a chance of 10**-5 that any two agree. A repeat is extended window by window,
not from one pair of places to the next, so a passage that is everywhere costs no more for it. A hash that recurs within one chunk of texts is settled there and sent once, so a passage that is everywhere gives no
more rows than there are chunks. Nothing is paired: buckets are counted, and only the dealt hashes meet.

Null and empty texts have no words and lose none. Texts with fewer than W words lose none. Repeated rows are copies:
their windows occur elsewhere, so all their words go if they have W. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import map_texts, small_batches, table

WINDOW = 35
#: Words whose hashes are handled together, and words a bucket (at least one bucket for each shuffle partition).
CHUNK_WORDS = 1 << 20
BUCKET_WORDS = 1 << 23
_M = 0x9E3779B97F4A7C15
_M2 = 0xD6E8FEB86659FD93
#: What two windows are compared by.
_WINDOW_HASH = np.dtype([("a", "<u8"), ("b", "<u4")])
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def rolling(words: np.ndarray, width: int, multiplier: int = _M) -> np.ndarray:
    """Polynomial hash of each run of `width` words, by doubling."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    out, have, power, base = None, 0, words, 1
    while True:
        if width >> int(math.log2(base)) & 1:
            m = np.uint64(pow(multiplier, base, 1 << 64))
            out = power[: len(words) - base + 1] if out is None else out[: len(words) - have - base + 1] * m + power[have : len(words) - base + 1]
            have += base
        if 2 * base > width:
            return out[:n]
        power = power[: len(words) - 2 * base + 1] * np.uint64(pow(multiplier, base, 1 << 64)) + power[base : len(words) - base + 1]
        base *= 2


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


class Chunk:
    """Texts' word hashes in a row, with where each text starts."""

    def __init__(self, keys: list[bytes], hashes: list[np.ndarray]):
        self.keys, self.sizes = keys, np.array([len(h) for h in hashes], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.text = np.repeat(np.arange(len(keys)), self.sizes)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the windows that lie within one text."""
        h = rolling(self.words, width)
        at = np.flatnonzero(self.text[width - 1 :] == self.text[: len(h)]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]

    def packed(self, at: np.ndarray, values: np.ndarray | None) -> bytes:
        """Places (rising) by text: number of texts, number of places, keys, counts, places within the text, values."""
        text = self.text[at]
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(at) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[first, len(at)]).astype("<u4")
        place = (at - self.starts[text]).astype("<u4")
        small = not len(place) or int(place.max()) < 1 << 16
        head = struct.pack("<III", len(first), len(at), small)
        body = [head, b"".join(self.keys[i] for i in text[first]), counts.tobytes(), place.astype("<u2" if small else "<u4").tobytes()]
        return b"".join(body + ([values.tobytes()] if values is not None else []))


def unpacked(blob: bytes, kind: str | np.dtype | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray | None]:
    """(keys in a row, counts, places, values)."""
    texts, n, small = struct.unpack_from("<III", blob)
    at = 12 + 16 * texts
    counts = np.frombuffer(blob, "<u4", texts, at)
    places = np.frombuffer(blob, "<u2" if small else "<u4", n, at + 4 * texts)
    values = np.frombuffer(blob, kind, n, at + 4 * texts + (2 if small else 4) * n) if kind is not None else None
    return blob[12:at], counts, places, values


class Outbox:
    """Chosen places by text, sent as one packed row for each destination, so that rows don't multiply with buckets."""

    def __init__(self, destinations: int, most: int = 1 << 21):
        self.destinations, self.most, self.n, self.held = destinations, most, 0, []

    def add(self, keys: bytes, counts: np.ndarray, places: np.ndarray, chosen: np.ndarray) -> None:
        if len(chosen):
            text = np.repeat(np.arange(len(counts)), counts)[chosen]
            own = np.bincount(text, minlength=len(counts))
            with_some = np.flatnonzero(own)
            self.held.append((np.frombuffer(keys, "<u8").reshape(-1, 2)[with_some], own[with_some], places[chosen].astype("<u4")))
            self.n += len(chosen)

    def full(self) -> bool:
        return self.n >= self.most

    def rows(self) -> pa.RecordBatch:
        to, packed = [], []
        if self.held:
            keys, counts, places = (np.concatenate(x) for x in zip(*self.held))
            starts = np.cumsum(counts) - counts
            order, slices = _slices((keys[:, 0] % np.uint64(self.destinations)).astype(np.int32))
            for d, s, e in slices:
                own = order[s:e]
                size = counts[own]
                at = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                to.append(d)
                packed.append(b"".join((struct.pack("<III", len(own), len(at), 0), keys[own].tobytes(), size.astype("<u4").tobytes(), places[at].tobytes())))
        self.n, self.held = 0, []
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(packed, pa.binary())], schema=_SENT)


def received(batches):
    """(key, places) of each text, from the packed rows of its destination (they stand together)."""

    def settle(held):
        keys, counts, places = (np.concatenate(x) for x in zip(*((np.frombuffer(k, "<u8").reshape(-1, 2), c, p) for k, c, p, _ in map(lambda x: unpacked(x, None), held))))
        starts = np.cumsum(counts.astype(np.int64)) - counts
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        k = keys[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)])
        out = [b"".join(places[starts[i] : starts[i] + counts[i]].tobytes() for i in order[s:e]) for s, e in zip(first, np.r_[first[1:], len(order)])]
        return pa.RecordBatch.from_arrays([pa.array([k[i].tobytes() for i in first], pa.binary()), pa.array(out, pa.binary())], schema=_PLACES)

    destination, held = None, []
    for batch in batches:
        for d, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if d != destination:
                if held:
                    yield settle(held)
                destination, held = d, []
            held.append(packed)
    if held:
        yield settle(held)


#: Kinds of packed rows: blocks of the index come before the probes of their bucket; settled places pass through.
BLOCKS, PROBES, SETTLED = 0, 1, 2
_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("packed", pa.binary())])
_SENT = pa.schema([("destination", pa.int32()), ("packed", pa.binary())])
_PLACES = pa.schema([("key", pa.binary()), ("places", pa.binary())])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, p = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int8()), pa.array(p, pa.binary())], schema=_ROW)


def _slices(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    return order, [(int(b[s]), int(s), int(e)) for s, e in zip(first, np.r_[first[1:], len(b)])]


def _once(h: np.ndarray, prefer: np.ndarray | None = None, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places to send: one for each hash (h, more), a preferred one if any; mask of hashes that recur here)."""
    order = np.lexsort([x for x in (None if prefer is None else ~prefer, more, h) if x is not None])
    new = np.zeros(len(h), bool)
    if len(h):
        new[0] = True
        for x in (h, more):
            if x is not None:
                new[1:] |= x[order][1:] != x[order][:-1]
    recurs = np.zeros(len(h), bool)
    recurs[order] = ~new | np.r_[~new[1:], False] if len(h) else new
    return np.sort(order[new]), recurs


def chunks(batches, hits: bool):
    """Chunks of (key, packed text[, places]) rows, and the places of hits by text."""
    known, unzip = WordHashes(), zstandard.ZstdDecompressor()
    keys, hashes, places, n = [], [], [], 0
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3 if hits else 2)]
        for row in zip(*columns):
            words = unzip.decompress(row[1]).split()
            keys.append(row[0])
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            places.append(np.frombuffer(row[2], "<u4") if hits else None)
            n += len(words)
            if n >= CHUNK_WORDS:
                yield Chunk(keys, hashes), places
                keys, hashes, places, n = [], [], [], 0
    if keys:
        yield Chunk(keys, hashes), places


def probe_rows(batches, block: int, buckets: int):
    """The index's blocks and the probes of each chunk, packed by bucket."""
    for chunk, _ in chunks(batches, False):
        at, h = chunk.windows(block)
        if not len(at):
            continue
        h = mixed(h)
        aligned = (at - chunk.starts[chunk.text[at]]) % block == 0
        send, recurs = _once(h, aligned)
        rows = [(int(h[0] % np.uint64(buckets)), SETTLED, chunk.packed(at[recurs], None))] if recurs.any() else []
        at, h, aligned = at[send], h[send], aligned[send]
        bucket, low = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), h.astype("<u4")
        order, slices = _slices(bucket)
        for b, s, e in slices:
            own = order[s:e]
            blocks = own[aligned[own]]
            if len(blocks):
                rows.append((b, BLOCKS, low[blocks].tobytes()))
            rows.append((b, PROBES, chunk.packed(at[own], low[own])))
        yield _rows(rows)


def hit_rows(batches, block: int, destinations: int):
    """Probes that meet a block other than themselves, by text."""
    bucket, blocks, index, counts, out = None, [], None, None, Outbox(destinations)
    for batch in batches:
        for b, kind, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket:
                bucket, blocks, index = b, [], None
            if kind == BLOCKS:
                blocks.append(np.frombuffer(packed, "<u4"))
                continue
            keys, n, places, low = unpacked(packed, "<u4" if kind == PROBES else None)
            if kind == PROBES:
                if index is None:
                    index, counts = np.unique(np.concatenate(blocks) if blocks else np.zeros(0, "<u4"), return_counts=True)
                if not len(index):
                    continue
                at = np.minimum(np.searchsorted(index, low), len(index) - 1)
                out.add(keys, n, places, np.flatnonzero((index[at] == low) & ((counts[at] > 1) | (places % block != 0))))
            else:
                out.add(keys, n, places, np.arange(len(places)))
        if out.full():
            yield out.rows()
    yield out.rows()


def window_rows(batches, window: int, block: int, buckets: int):
    """Windows around hits, packed by bucket."""
    for chunk, places in chunks(batches, True):
        steps = np.zeros(len(chunk.words) + 1, np.int64)
        for start, hits in zip(chunk.starts, places):  # a hit at x lies in the windows from x - (window - block) to x
            np.add.at(steps, start + np.maximum(hits.astype(np.int64) - (window - block), 0), 1)
            np.add.at(steps, start + hits.astype(np.int64) + 1, -1)
        near = np.cumsum(steps[:-1]) > 0
        at, h = chunk.windows(window)
        chosen = near[at]
        at, h = at[chosen], h[chosen]
        if not len(at):
            continue
        h2 = (mixed(rolling(chunk.words, window, _M2)[at]) >> np.uint64(32)).astype("<u4")
        send, recurs = _once(h, more=h2)
        rows = [(int(h[0] % np.uint64(buckets)), SETTLED, chunk.packed(at[recurs], None))] if recurs.any() else []
        at, h = at[send], h[send].astype("<u8")
        both = np.empty(len(h), _WINDOW_HASH)
        both["a"], both["b"] = h, h2[send]
        order, slices = _slices((mixed(h ^ np.uint64(_M)) >> np.uint64(20)).astype(np.uint64).__mod__(np.uint64(buckets)).astype(np.int32))
        for b, s, e in slices:
            rows.append((b, PROBES, chunk.packed(at[order[s:e]], both[order[s:e]])))
        yield _rows(rows)


def repeat_rows(batches, destinations: int):
    """Windows that occur twice or more, by text."""
    out = Outbox(destinations)

    def settle(held):
        parts = [unpacked(p, _WINDOW_HASH) for p in held]
        values = np.concatenate([x[3] for x in parts])
        _, recurs = _once(np.ascontiguousarray(values["a"]), more=np.ascontiguousarray(values["b"]))
        for (keys, n, places, own), here in zip(parts, np.split(recurs, np.cumsum([len(x[3]) for x in parts])[:-1])):
            out.add(keys, n, places, np.flatnonzero(here))

    bucket, held = None, []
    for batch in batches:
        for b, kind, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket:
                if held:
                    settle(held)
                bucket, held = b, []
            if kind == SETTLED:
                keys, n, places, _ = unpacked(packed, None)
                out.add(keys, n, places, np.arange(len(places)))
            else:
                held.append(packed)
        if out.full():
            yield out.rows()
    if held:
        settle(held)
    yield out.rows()


def removal(words: list[bytes], starts: np.ndarray, window: int) -> tuple[int, bytes]:
    """(words removed, text kept) when the windows at `starts` go."""
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts.astype(np.int64), 1)
    np.add.at(steps, np.minimum(starts.astype(np.int64) + window, len(words)), -1)
    gone = np.cumsum(steps[:-1]) > 0
    return int(gone.sum()), b" ".join(words[i] for i in np.flatnonzero(~gone))


def remove_repeats(df: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per row of df: `keep`, n_words, n_removed, kept_sha256 (words kept, joined by spaces) and, if asked for, kept_text."""
    spark = df.sparkSession
    block = (window + 1) // 2
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n_bytes = df.agg(F.coalesce(F.sum(F.octet_length(whole)), F.lit(0))).first()[0]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, math.ceil(n_bytes / 6 / BUCKET_WORDS))
    key = F.unhex(F.md5(whole)).alias("key")

    def pack(texts: list[bytes]) -> dict[str, pa.Array]:
        squeeze = zstandard.ZstdCompressor(level=3)
        split = [t.split() for t in texts]
        joined = [b" ".join(w) for w in split]
        return {
            "n_words": pa.array([len(w) for w in split], pa.int64()),
            "digest": pa.array([hashlib.sha256(j).digest() for j in joined], pa.binary()),
            "packed": pa.array([squeeze.compress(j) for j in joined], pa.binary()),
        }

    rows = map_texts(df.select(key, whole.alias("text")), pack, "n_words bigint, digest binary, packed binary", ["key"])
    # the key is never null; saying so keeps joins from filtering it anew, so that all of them read the same exchange
    texts = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("n_words").alias("n_words"), F.first("digest").alias("digest"), F.first("packed").alias("packed"), F.count("*").alias("copies"))

    def by_bucket(made: DataFrame) -> DataFrame:
        return made.repartition(max(partitions, buckets), "bucket").sortWithinPartitions("bucket", "kind")

    long = texts.where(F.col("n_words") >= window).select("key", "packed")

    def with_places(sent: DataFrame) -> DataFrame:
        places = sent.repartition(max(partitions, buckets), "destination").sortWithinPartitions("destination").mapInArrow(received, "key binary, places binary")
        return long.join(places.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).select("key", "packed", "places")

    row, sent = "bucket int, kind tinyint, packed binary", "destination int, packed binary"
    probes = long.mapInArrow(lambda b: probe_rows(b, block, buckets), row)
    hits = by_bucket(probes).mapInArrow(lambda b: hit_rows(b, block, buckets), sent)
    windows = with_places(hits).mapInArrow(lambda b: window_rows(b, window, block, buckets), row)
    repeats = by_bucket(windows).mapInArrow(lambda b: repeat_rows(b, buckets), sent)

    def kept_rows(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            keys, removed, digests, kept_texts = [], [], [], []
            for k, packed, places in zip(*(c.to_pylist() for c in batch.columns)):
                n, kept = removal(unzip.decompress(packed).split(), np.frombuffer(places, "<u4"), window)
                keys.append(k)
                removed.append(n)
                digests.append(hashlib.sha256(kept).digest())
                kept_texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(removed, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept_texts, pa.string())], names=["_key", "n_removed", "kept_digest", "kept_text"])

    cleared = with_places(repeats).mapInArrow(kept_rows, "_key binary, n_removed bigint, kept_digest binary, kept_text string")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= window)
    results = texts.join(cleared, F.col("key") == F.col("_key"), "left").select(
        F.lower(F.hex("key")).alias("_text_key"), "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_digest", "digest")))).alias("kept_sha256"),
        F.when(copied, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.col("_key").isNull().alias("whole"),
    )
    # a text may have most rows as its copies: both sides are dealt by the key as written, which lets Spark split such a part
    documents = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.md5(whole).alias("_copy_key"), *([whole.alias("_text")] if with_text else []))
    met = documents.join(results, F.col("_copy_key") == F.col("_text_key"))
    own = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    extra = [F.when(F.col("whole") & (F.col("n_removed") == 0), F.trim(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", " "))).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []
    return met.select(*own, "n_words", "n_removed", "kept_sha256", *extra)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])


#: The same in DuckDB: all windows, counted.
OP4_SQL = """
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM words WHERE len(w) >= 35),
windows AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM starts),
repeated AS (SELECT r, s FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(s, s + 35)) AS i FROM repeated) GROUP BY r),
each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
dropped AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM repeated),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM each ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
