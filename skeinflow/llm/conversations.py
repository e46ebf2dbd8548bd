"""Repair of conversations: the cheapest edits that make the roles' initials fit `(s?(ua)+)?`, found by A* on the edit lattice.

A node is (messages read, state of the pattern). Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an empty
message 3; a blank message, or one whose role and text came before, must be deleted; one that doesn't end in `.!?` and stays
costs 3 more. The heuristic is the sum over the messages to come of 4 for a deletion that must be and 3 for an end that is cut off, which no
path can avoid; it never falls by more than a step costs, so each node is settled once. The queue is ordered by (cost plus
heuristic, audit), the audit being the edits' initials so far. Of paths of equal cost to a node the one of least audit is
popped first, since its beginnings cost no more and sort no later than it does.

A range sort by conversation and turn lays messages out, so a long conversation lies over many tasks. It is cut into blocks
of BLOCK messages, and A* runs in each from every state to every state; since an insertion belongs to the message it
comes before, no such audit is the beginning of another, so their ranks decide ties wherever blocks are joined. The chain of
blocks is then walked over costs and ranks alone, some hundred bytes each. Conversations that lie whole in one block, all but
the first and last of a task and the long ones, are done at once. Only the digest of a long conversation's repaired text,
which no two tasks can share, is fed by one task; it streams the blocks and holds one at a time (and the audit that is returned).

Rows of a conversation follow by turn (null first), then role, then text; equal rows stand side by side. A null role or text
counts as one space. An empty role, like any of another initial, can't be kept. A null id is a conversation of its own. Conversations
without messages give zeros, an empty audit and no text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuts import cut
from .texts import small_batches, table

#: Messages and bytes of a block.
BLOCK = 1024
BLOCK_BYTES = 4 << 20

#: The pattern: at the start, after the system's, the user's and the assistant's message; what may follow and where it leads.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
MADE = ["user", "user", "assistant", "user"]
LAST = (0, 3)
OK, BLANK, REPEATED, CUT_OFF = range(4)
KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join([*(f"{c} long" for c in COUNTS), "audit string, repaired_sha256 string"])


def fault(role: str, text: str, repeated: bool) -> int:
    end = text.rstrip(SPACES)
    return BLANK if not end else REPEATED if repeated else CUT_OFF if end[-1] not in ".!?" else OK


def search(initials: list[str], faults: list[int], start: int = 0, final: bool = True) -> dict[int, tuple[int, str]]:
    """Cost and audit of the cheapest edits by the state they end in, least audit first among equals.

    `final`: the conversation ends here, so only the best of the states that may end it is given. Otherwise nothing is
    inserted after the last message, and every state that can be reached is given.
    """
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if faults[i] in (BLANK, REPEATED) else UNENDED if faults[i] == CUT_OFF else 0)
    queue, settled, found = [(ahead[0], "", 0, start)], bytearray(4 * (n + 1)), {}
    push = lambda cost, audit, i, q: heapq.heappush(queue, (cost + ahead[i], audit, i, q))
    while queue:
        total, audit, i, q = heapq.heappop(queue)
        if settled[4 * i + q]:
            continue
        settled[4 * i + q] = 1
        cost = total - ahead[i]
        made = MADE[q]
        if i == n:
            if not final or q in LAST:
                found[q] = (cost, audit)
                if final:
                    return found
        else:
            push(cost + DELETE, audit + "D", i + 1, q)
            if faults[i] in (OK, CUT_OFF):
                stays = cost + (UNENDED if faults[i] == CUT_OFF else 0)
                if initials[i] in NEXT[q]:
                    push(stays + KEEP, audit + "K", i + 1, NEXT[q][initials[i]])
                push(stays + REROLE, audit + "R", i + 1, NEXT[q][made[0]])
        if i < n or final:
            push(cost + INSERT, audit + "I", i, NEXT[q][made[0]])
    return found


def ending(q: int) -> str:
    """What is inserted after the last message so that the conversation may end."""
    return "" if q in LAST else "I" if q == 2 else "II"


def edited(audit: str, roles: list[str], texts: list[str], q: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each message that the edits leave, from state q on."""
    i = 0
    for e in audit:
        if e != "D":
            role = roles[i] if e == "K" else MADE[q]
            yield e, role, "" if e == "I" else texts[i]
            q = NEXT[q][role[:1]]
        i += e != "I"


def faults_of(roles: list[str], texts: list[str], first: Iterable[int] | None = None) -> list[int]:
    """`first`: places whose role and text didn't come before; without it they are found among these messages."""
    if first is None:
        seen: set = set()
        return [fault(r, t, (r, t) in seen or bool(seen.add((r, t)))) for r, t in zip(roles, texts)]
    first = set(first)
    return [fault(r, t, i not in first) for i, (r, t) in enumerate(zip(roles, texts))]


def _digest(said: Iterable[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in said).encode()).hexdigest()


class Tally:
    """Counts over a conversation's messages, which come in order and in any number of pieces."""

    def __init__(self):
        self.least = self.most = self.initial = None
        self.distinct = 0
        self.of = [0] * 4
        self.illegal = 0

    def add(self, turns: list, roles: list[str], faults: list[int]) -> None:
        for t, r, f in zip(turns, roles, faults):
            if t is not None and t != self.most:
                self.distinct += 1
                self.least, self.most = t if self.least is None else self.least, t
            self.illegal += self.initial is not None and self.initial + r[:1] not in LEGAL
            self.initial = r[:1]
            self.of[f] += 1

    def counts(self) -> list[int]:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return [gaps, self.of[BLANK], self.of[REPEATED], self.of[CUT_OFF], self.illegal]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], bulk: Callable[[tuple], int] = lambda r: 1) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some BLOCK, or fewer where they are large."""
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
    for r in rows:
        held.append(r)
        size += bulk(r)
        if size >= BLOCK:
            yield make()
            held, size = [], 0
    if held:
        yield make()


_L, _S = pa.int64(), pa.string()
_MESSAGES = [pa.list_(_L), pa.list_(_S), pa.list_(_S)]
_COUNTED = [*[_L] * len(COUNTS), _S, _S]


def _laid_out(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column) -> DataFrame:
    """Rows in order, over the tasks. Those of no copies only name their conversation."""
    said = lambda c: F.when(F.col("_n") > 0, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("")
    rows = df.withColumn("_n", copies).select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), said(role).alias("_role"), said(text).alias("_text"), F.col("_n").cast("long").alias("_n"))
    keys = ["_conv", "_turn", "_role", "_text", "_tie"]
    return rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")


def _blocked(rows: DataFrame, kind: str, block: int, most_bytes: int) -> DataFrame:
    """Results of conversations that lie in one block, and blocks of the others: the first and last of each task, and long ones."""

    def groups(batches) -> Iterator[tuple]:
        """(conversation, its block's number, whether more of it may follow or came before, turns, roles, texts)"""
        now, turns, roles, texts, size, begun, n, alone = None, [], [], [], 0, False, 0, False
        for conv, turn, role, text, copies in _lists(batches):
            if not begun or conv != now:
                if begun:
                    yield now, n, alone, turns, roles, texts
                now, alone, n = conv, begun, n + 1
                begun, turns, roles, texts, size = True, [], [], [], 0
            for _ in range(copies):
                if len(turns) >= block or size > most_bytes:
                    yield now, n, False, turns, roles, texts
                    turns, roles, texts, size, n, alone = [], [], [], 0, n + 1, False
                turns.append(turn), roles.append(role), texts.append(text)
                size += len(text) + len(role) + 16
        if begun:
            yield now, n, False, turns, roles, texts

    def run(batches):
        part = TaskContext.get().partitionId()

        def rows():
            for conv, n, alone, turns, roles, texts in groups(batches):
                if not alone:
                    yield conv, part, n, *[None] * len(_COUNTED), turns, roles, texts
                    continue
                faults, tally = faults_of(roles, texts), Tally()
                tally.add(turns, roles, faults)
                [(cost, audit)] = search([r[:1] for r in roles], faults).values()
                yield conv, part, n, *tally.counts(), cost, audit, _digest(edited(audit, roles, texts)), None, None, None

        bulk = lambda r: 1 if r[-1] is None else 1 + sum(map(len, r[-1])) // 4096
        names = [x.split()[0].strip("`") for x in f"_conv x, _part x, _no x, {RESULT}, turns x, roles x, texts x".split(", ")]
        return _batches(rows(), names, [conv_type, _L, _L, *_COUNTED, *_MESSAGES], bulk)

    conv_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return rows.mapInArrow(run, f"_conv {kind}, _part long, _no long, {RESULT}, turns array<long>, roles array<string>, texts array<string>")


def _first_said(blocks: DataFrame) -> DataFrame:
    """Blocks with the places of messages whose role and text didn't come before in the conversation. Digests travel, not texts."""
    key = F.transform(F.arrays_zip("roles", "texts"), lambda m: F.md5(F.concat(F.length(m["roles"]).cast("string"), F.lit(":"), m["roles"], m["texts"])))
    each = blocks.select("_conv", "_part", "_no", F.posexplode(key).alias("i", "_key"))
    first = each.groupBy("_conv", "_key").agg(F.min(F.struct("_part", "_no", "i")).alias("at")).select("at.*")
    places = first.groupBy("_part", "_no").agg(F.collect_list("i").alias("first"))  # a block's at most
    return blocks.join(places, ["_part", "_no"], "left")


def _solved(blocks: DataFrame, kind: str) -> DataFrame:
    """Each block's faults, and cost, rank and audit from every state to every state (place 4 * from + to)."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"faults": [], "costs": [], "ranks": [], "audits": []}
            for roles, first in zip(b.column("roles").to_pylist(), b.column("first").to_pylist()):
                texts = b.column("texts")[len(out["faults"])].as_py()
                faults = faults_of(roles, texts, first or [])
                costs, ranks, audits = [None] * 16, [None] * 16, [None] * 16
                for p in range(4):
                    found = search([r[:1] for r in roles], faults, p, final=False)
                    order = sorted(a for _, a in found.values())
                    for q, (c, a) in found.items():
                        costs[4 * p + q], ranks[4 * p + q], audits[4 * p + q] = c, order.index(a), a
                for k, x in (("faults", faults), ("costs", costs), ("ranks", ranks), ("audits", audits)):
                    out[k].append(x)
            kept = [b.column(c) for c in ("_conv", "_part", "_no", "turns", "roles", "texts")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(out[k], pa.list_(_L)) for k in ("faults", "costs", "ranks")), pa.array(out["audits"], pa.list_(_S))], names=["_conv", "_part", "_no", "turns", "roles", "texts", *out])

    return blocks.select("_conv", "_part", "_no", "turns", "roles", "texts", "first").mapInArrow(run, f"_conv {kind}, _part long, _no long, turns array<long>, roles array<string>, texts array<string>, faults array<long>, costs array<long>, ranks array<long>, audits array<string>")


def walk(chain: list[tuple[list, list]]) -> tuple[list[int], int]:
    """The states between blocks on the cheapest way through, least audit first, and the state it ends in.

    Chain: costs and ranks of each block. Ways into a state are compared by cost, then by the order of their audits so far.
    """
    best, back = {0: (0, 0)}, []
    for costs, ranks in chain:
        ways: dict[int, tuple] = {}
        for p, (cost, order) in best.items():
            for q in range(4):
                if costs[4 * p + q] is not None:
                    way = (cost + costs[4 * p + q], order, ranks[4 * p + q], p)
                    if q not in ways or way < ways[q]:
                        ways[q] = way
        sorts = {k: i for i, k in enumerate(sorted({w[1:3] for w in ways.values()}))}
        best = {q: (w[0], sorts[w[1:3]]) for q, w in ways.items()}
        back.append(bytes(ways[q][3] if q in ways else 0 for q in range(4)))
    q = last = min(best, key=lambda q: (best[q][0] + INSERT * len(ending(q)), best[q][1]))
    states = []
    for b in reversed(back):
        states.append(b[q])
        q = b[q]
    return states[::-1], last


def _chosen(solved: DataFrame) -> DataFrame:
    """The states that the best way enters and leaves each block in. Streams the blocks' costs, keeps 16 bytes or so of each."""

    def run(batches):
        def ways(held: list[tuple]) -> Iterator[tuple]:
            states, last = walk([h[2:] for h in held])
            for h, p, q in zip(held, states, [*states[1:], last]):
                yield h[0], h[1], p, q

        def rows():
            now, held = None, []
            for conv, part, no, costs, ranks in _lists(batches):
                if held and conv != now:
                    yield from ways(held)
                    held = []
                now = conv
                held.append((part, no, costs, ranks))
            if held:
                yield from ways(held)

        return _batches(rows(), ["_part", "_no", "_from", "_to"], [_L] * 4)

    lined = solved.where(F.size("turns") > 0).select("_conv", "_part", "_no", "costs", "ranks").repartition("_conv").sortWithinPartitions("_conv", "_part", "_no")
    return lined.mapInArrow(run, "_part long, _no long, _from long, _to long")


def _put_together(solved: DataFrame, kind: str) -> DataFrame:
    """Results of conversations of several blocks, streamed in order."""

    def run(batches):
        def result(conv, tally, cost, audit, digest, q):
            tail = ending(q)
            for _, role, text in edited(tail, [], [], q):
                digest(role, text)
            return conv, *tally.counts(), cost + INSERT * len(tail), "".join(audit) + tail, digest.sha.hexdigest()

        class Digest:
            def __init__(self):
                self.sha, self.any = hashlib.sha256(), False

            def __call__(self, role: str, text: str):
                self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
                self.any = True

        def rows():
            now, begun = None, False
            for conv, turns, roles, texts, faults, costs, audits, p, q in _lists(batches):
                if not begun or conv != now:
                    if begun:
                        yield result(now, tally, cost, audit, digest, state)
                    now, begun, tally, cost, audit, digest, state = conv, True, Tally(), 0, [], Digest(), 0
                if turns:
                    tally.add(turns, roles, faults)
                    cost += costs[4 * p + q]
                    audit.append(audits[4 * p + q])
                    for _, role, text in edited(audit[-1], roles, texts, p):
                        digest(role, text)
                    state = q
            if begun:
                yield result(now, tally, cost, audit, digest, state)

        return _batches(rows(), ["_conv", *(x.split()[0] for x in RESULT.split(", "))], [conv_type, *_COUNTED], lambda r: 1 + len(r[-2]) // 4096)

    conv_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    lined = solved.repartition("_conv").sortWithinPartitions("_conv", "_part", "_no")
    return lined.select("_conv", "turns", "roles", "texts", "faults", "costs", "audits", "_from", "_to").mapInArrow(run, f"_conv {kind}, {RESULT}")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per conversation: conv, gaps in its turns, messages that are blank, repeated or cut off, illegal successions of
    roles, the cost and audit of the cheapest repair, and the digest of the repaired `role:text` lines.

    `copies` says how often each row stands (0: it only names its conversation).
    """
    small_batches(df.sparkSession)
    kind = df.schema[conv].dataType.simpleString()
    if kind not in ("bigint", "int"):
        kind = "string"
        df = df.withColumn(conv, F.col(conv).cast("string"))
    made = cut(_blocked(_laid_out(df, conv, turn, role, text, copies if copies is not None else F.lit(1)), kind, block, block_bytes))
    done = made.where(F.col("audit").isNotNull()).select("_conv", *(x.split()[0] for x in RESULT.split(", ")))
    solved = cut(_solved(_first_said(made.where(F.col("audit").isNull()).select("_conv", "_part", "_no", "turns", "roles", "texts")), kind))
    way = _chosen(solved)
    rest = _put_together(solved.join(way, ["_part", "_no"], "left"), kind)
    return done.unionByName(rest).withColumnRenamed("_conv", conv)


def damaged(df: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults put in, by the checksum of conversation and turn, and how often each row stands."""
    put = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.encode(F.concat(put("conv_id"), F.lit(":"), put("turn")), "UTF-8")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(put("text"), ".!?", "")).otherwise(put("text"))
    rows = df.select("conv_id", "turn", F.when(code == 4, "user").otherwise(put("role")).alias("role"), text.alias("text"), code.alias("_code"))
    return rows, F.when(F.col("_code") == 0, 0).when(F.col("_code") == 3, 2).otherwise(1)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damaged(table(spark, sf_dir, "conversations"))
    return repair(rows, copies=copies)


def _sql() -> str:
    """The same in SQL, by dynamic programming: the best (cost, audit, text) for each state of the pattern, message by message."""
    step = lambda s, cost, edit, said="": f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 'o': {s}.o{said}}} END"
    best = lambda *ways: f"list_sort([{', '.join(ways)}], 'ASC', 'NULLS LAST')[1]"
    put = lambda role, text: f" || chr(10) || {role} || ':' || {text}"
    insert = lambda s, role: step(s, 3, "I", put(f"'{role}'", "''"))
    stays = lambda s, k: f"CASE WHEN NOT forced AND k = '{k}' THEN {step(s, 'e', 'K', put('role', 'text'))} END"
    made = lambda s, role: f"CASE WHEN NOT forced THEN {step(s, '3 + e', 'R', put(repr(role), 'text'))} END"
    dropped = lambda s: step(s, 4, "D")
    read = [
        best(dropped("s0")), best(dropped("s1"), stays("s0", "s")),
        best(dropped("s2"), *(x for s in ("s0", "s1", "s3") for x in (stays(s, "u"), made(s, "user")))), best(dropped("s3"), stays("s2", "a"), made("s2", "assistant")),
    ]
    two = best("t2", *(insert(s, "user") for s in ("t0", "t1", "t3")))
    blank = "[\\x20\\x09-\\x0D]"
    bits = "list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: {bits}) AS t),
        given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        coded AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(key)), lambda i: ascii(substr(key, (i + 1)::INT, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM given, crc),
        said AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded),
        lined AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM said),
        marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_replace(text, '{blank}+$', '') AS core, lead(role) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM lined),
        m AS MATERIALIZED (SELECT *, left(role, 1) AS k, CASE WHEN core = '' THEN 'b' WHEN again THEN 'd' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f, f IN ('b', 'd') AS forced, CASE f WHEN 't' THEN 3 ELSE 0 END AS e, after IS NOT NULL AND left(role, 1) || left(after, 1) NOT IN ('su', 'ua', 'au') AS odd FROM marked),
        walk AS (
            SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': ''}} AS s0, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR) AS s1, {{'c': 3, 'a': 'I', 'o': chr(10) || 'user:'}} AS s2, {{'c': 6, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, i, t0, t1, u2, {best("t3", insert("u2", "assistant"))} FROM (
                SELECT *, {two} AS u2 FROM (
                    SELECT w.conv_id, m.i, {", ".join(f"{x} AS t{q}" for q, x in enumerate(read))} FROM walk w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1))),
        ends AS (SELECT conv_id, {best("s0", "s3")} AS s FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (odd) AS illegal FROM m GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, s.c::BIGINT AS cost, s.a AS audit, sha256(substr(s.o, 2)) AS repaired_sha256
        FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


OP11_SQL = _sql()
