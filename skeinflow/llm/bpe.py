"""Word BPE: a backtracking encoder over an automaton of the vocabulary, and decoding through an offset table.

A piece of text (a word with its end mark) is encoded from left to right: the longest token that starts here, found
with an Aho-Corasick automaton, is taken if it may follow the token before it; else a shorter one, and when none is left
the token before it is taken back. Two neighbours are compatible if merging their joined string gives just those two
tokens again, so the sequence found is the one that merging by rank gives; each position is tried once per token end,
in time linear in the piece. The pair checks are kept in a table. Pieces recur, so each worker keeps their results too.

Null texts count as empty: no tokens, an empty decoded text. Repeated rows give repeated results. A very long text is
encoded whole by the task that holds it, in memory that grows with its length. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .texts import map_texts, table

#: Added to the code point of a letter that carries the end mark; byte letters lie below it.
ENDED = 0x1000
#: Pieces, and pairs, that a worker keeps in each of two generations.
KEPT = 150_000


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Kept(dict):
    """Values by key, made when they are missed. Of two generations: when the young one is full it becomes the old one, so what recurs stays."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:  # long pieces hardly recur
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Tokens, merges and the automaton of a tokenizer file of kind BPE with an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.letters = byte_letters()
        size = 1 + max([*self.ids.values(), *self.specials.values()])
        self.tokens = [""] * size
        for token, i in [*self.ids.items(), *self.specials.items()]:
            self.tokens[i] = token
        # the offset table: all tokens' bytes in a row, each followed by the space that stands between tokens
        raw = [f"{t} ".encode() for t in self.tokens]
        self.buffer = np.frombuffer(b"".join(raw), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        # one letter for each symbol from here on: a last letter with its end mark is the letter ENDED further on
        self.rank_of = {(self.symbols(a), self.symbols(b)): r for (a, b), r in self.ranks.items()}
        # only tokens that merging their own letters gives can come out of merging at all
        self.made = {c: i for t, i in self.ids.items() if self._merged(c := self.symbols(t)) == [c]}
        self.automaton = ahocorasick.Automaton()
        for c in self.made:
            self.automaton.add_word(c, c)
        self.automaton.make_automaton()
        self.follows = _Kept(lambda pair: self._merged(pair[0] + pair[1]) == list(pair))
        self.encoded = _Kept(lambda piece: self.encode_piece(self.symbols("".join(map(self.letters.__getitem__, piece.encode())) + self.end)))
        self.numerals = [str(i) for i in range(size)]
        self.letter_ids = {self.symbols(t): i for t, i in self.ids.items()}

    def symbols(self, token: str) -> str:
        """A token as one letter for each symbol."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + chr(ord(token[-1]) + ENDED)
        return token

    def _merged(self, symbols: str) -> list[str]:
        """Merging by rank, leftmost first: used once a token and once a pair of tokens."""
        parts = list(symbols)
        while True:
            best = min(((r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := self.rank_of.get(pair)) is not None), default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """May `right` follow `left`? Merging the letters of both must give these two tokens."""
        return self.follows[left, right]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece, given as one letter for each symbol."""
        n = len(piece)
        starts: list[list[str]] = [[] for _ in range(n)]
        for last, token in self.automaton.iter(piece):  # by rising end, so the longest comes last at each start
            starts[last + 1 - len(token)].append(token)
        if not n or (starts[0] and len(starts[0][-1]) == n):
            return (self.made[piece],) if n else ()
        path: list[tuple[str, int, list[str]]] = []  # token, its start, what is left to try there
        dead: set[int] = set()  # from such a place no way leads to the end
        at, left, before = 0, starts[0], None
        while at < n:
            while left:
                token = left.pop()
                if at + len(token) not in dead and (before is None or self.compatible(before, token)):
                    path.append((token, at, left))
                    at += len(token)
                    before, left = token, list(starts[at]) if at < n else left
                    break
            else:
                if not path:  # a letter that the vocabulary lacks: merge what there is
                    return tuple(self.letter_ids[s] for s in self._merged(piece) if s in self.letter_ids)
                dead.add(at)
                _, at, left = path.pop()
                before = path[-1][0] if path else None
        return tuple(self.made[t] for t, _, _ in path)

    def normal(self, text: str) -> str:
        """NFC, then lower case letter by letter (no final sigma). White space is left: pieces never hold it."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part, special in self._parts(text):
            if special:
                ids.append(self.specials[part])
            else:
                ids += chain.from_iterable(map(self.encoded.__getitem__, self.pieces.findall(self.normal(part))))
        return ids

    def _parts(self, text: str):
        if not any(s in text for s in self.specials):
            return [(text, False)]
        return [(p, p in self.specials) for p in regex.split("(" + "|".join(map(regex.escape, self.specials)) + ")", text) if p]

    def decode(self, ids: list[int]) -> bytes:
        """The tokens joined by spaces, as the file names no decoder: each id's span is copied out of the buffer."""
        if not len(ids):
            return b""
        at = np.asarray(ids, np.int64)
        size = self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(size)
        index = np.arange(ends[-1]) + np.repeat(self.offsets[at] - (ends - size), size)
        return self.buffer[index[:-1]].tobytes()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(df: DataFrame, path: str, keep: list[str], text: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: `keep`, n_tokens, ids (if asked for), ids_sha256, decoded_sha256."""

    def rows_of(texts: list[bytes]) -> dict[str, pa.Array]:
        v = vocabulary(path)
        encoded = [v.encode(t.decode()) for t in texts]
        digest = lambda b: hashlib.sha256(b).hexdigest()
        out = {
            "n_tokens": pa.array([len(x) for x in encoded], pa.int64()),
            "ids_sha256": pa.array([digest(" ".join(map(v.numerals.__getitem__, x)).encode()) for x in encoded], pa.string()),
            "decoded_sha256": pa.array([digest(v.decode(x)) for x in encoded], pa.string()),
        }
        return out | ({"ids": pa.array(encoded, pa.list_(pa.int32()))} if with_ids else {})

    return map_texts(df, rows_of, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, keep, text)


def decode_ids(df: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Per row: `keep` and `decoded`, the text of an array of ids; null counts as empty."""
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(x or []).decode() for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return df.select(*keep, df[ids].cast("array<int>")).mapInArrow(run, ", ".join(x for x in (types, "decoded string") if x))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], with_ids=False)
