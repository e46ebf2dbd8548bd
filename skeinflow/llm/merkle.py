"""A manifest of a table as a tree of hashes, with a proof for each row, and rows folded back to the root by their proofs.

H is the hexadecimal sha256 of its inputs, put together as text. A leaf is H of a row's fields; within a group leaves
ascend by id, and while several nodes remain every two consecutive ones become their H (an odd last one alone becomes
its own). What remains is the group's subroot; subroots by group, null first, fold likewise into the root.

Leaves are hashed where the rows lie; from then on only ids and digests travel. A range sort numbers them; blocks of
2**LEVELS leaves, at multiples of that number, each reduce to one node; blocks of those reduce again while more than TOP
nodes are left. The driver builds the tree above them and broadcasts each node's path to the root (at most TOP paths of
some 1.5 KB), and blocks finish their rows' paths, proofs and folds. A hot group is only more blocks; a table of more
than TOP groups numbers their subroots in turn and reduces those in blocks too.

Nulls are written as `-`, so they differ from empty texts. Rows of equal ids follow by their leaf; equal rows have equal
leaves and stand side by side, each with its own proof. A null id comes first in its group and counts as unchanged. An
empty table gives no rows. Long texts are hashed whole. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cuts import cut
from .texts import small_batches, table

#: Levels of a block, and how many nodes are left to the driver at most.
LEVELS = 12
TOP = 8192

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODE = "_g string, _n long, _pos long, _digest string"
PATH = "_g string, _pos long, _path string"


def h(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf(fields: list[Column]) -> Column:
    """H of the fields, each its UTF-8 byte count, a colon and its text, or `-` if null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(one(c.cast("string")) for c in fields)), 256)


def levels_of(digests: list[bytes], most: int | None = None) -> list[list[bytes]]:
    """The levels above the digests: until one node is left, or `most` of them."""
    out = [digests]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        d = out[-1]
        out.append([h(*d[i : i + 2]) for i in range(0, len(d), 2)])
    return out


def path_of(levels: list[list[bytes]], at: int) -> list[bytes]:
    """What each level's hash takes besides: L or R and the sibling, or - where there is none."""
    out = []
    for d in levels[:-1]:
        sibling = at ^ 1
        out.append((b"L" if sibling < at else b"R") + d[sibling] if sibling < len(d) else b"-")
        at >>= 1
    return out


def folded(digest: bytes, path: list[bytes]) -> bytes:
    for step in path:
        digest = h(digest) if step == b"-" else h(step[1:], digest) if step[:1] == b"L" else h(digest, step[1:])
    return digest


def proof(path: list[bytes]) -> bytes:
    return h(*(step[1:] for step in path))


def _numbered(df: DataFrame, group: str, order: list[str], small: int = 100_000) -> DataFrame:
    """Adds to df _pos, the row's place in its group by `order`, and _n, the group's size."""
    ties = df.withColumn("_tie", F.monotonically_increasing_id())  # equal rows need not meet in one task
    keys = [group, *order, "_tie"]
    lined = cut(ties.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    rows = lined.withColumn("_part", F.shiftright("_at", 33))
    per = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    by = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(per.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(by).alias("_n")))
    few = starts.count() <= small  # at most a row for each partition and each group
    met = rows.join(F.broadcast(starts) if few else starts, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_of")))
    return met.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_group", "_of", "_shift")


def _blocks(nodes: DataFrame, levels: int):
    return nodes.withColumn("_block", F.shiftright("_pos", levels)).groupBy("_g", "_block")


def _in_order(t: pa.Table) -> pa.Table:
    return t.sort_by("_pos")


def _levels(t: pa.Table, levels: int) -> list[list[bytes]]:
    """A block's levels: to its one node if it is all of its group, else as many as a whole block has."""
    whole = t.column("_n")[0].as_py() <= 1 << levels
    return levels_of([d.encode() for d in t.column("_digest").to_pylist()], None if whole else levels)


def reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """One node for each block of 2**levels nodes."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        n = t.column("_n")[0].as_py()
        made = _levels(_in_order(t), levels)[-1][0].decode()
        return pa.table({"_g": [key[0].as_py()], "_n": pa.array([-(-n >> levels)], pa.int64()), "_pos": [key[1].as_py()], "_digest": [made]})

    return _blocks(nodes, levels).applyInArrow(run, NODE)


def _above(nodes: list) -> tuple[dict[tuple[str, int], bytes], bytes]:
    """The driver's tree: each node's path to the root, and the root."""
    of: dict[str, list] = {}
    for r in sorted(nodes, key=lambda r: (r._g.encode(), r._pos)):
        of.setdefault(r._g, []).append(r._digest.encode())
    trees = {g: levels_of(d) for g, d in of.items()}
    top = levels_of([t[-1][0] for t in trees.values()]) if trees else [[b""]]
    paths = {(g, i): b",".join(path_of(t, i) + path_of(top, k)) for k, (g, t) in enumerate(trees.items()) for i in range(len(t[0]))}
    return paths, top[-1][0]


def _finished(nodes: DataFrame, levels: int, of: Callable, schema: str, sent=None, paths: DataFrame | None = None) -> DataFrame:
    """of(table, paths) for each block, its nodes' paths made of their own part and that of the block: sent, or met by a shuffle."""

    def run(key, t: pa.Table, up: bytes) -> pa.Table:
        t = _in_order(t)
        made = _levels(t, levels)
        rest = up.split(b",") if up else []
        return of(t, [path_of(made, i) + rest for i in range(t.num_rows)])

    if paths is None:
        return _blocks(nodes, levels).applyInArrow(lambda key, t: run(key, t, sent.value[key[0].as_py(), key[1].as_py()]), schema)
    upper = paths.withColumnRenamed("_pos", "_block").groupBy("_g", "_block")
    return _blocks(nodes, levels).cogroup(upper).applyInArrow(lambda key, t, p: run(key, t, p.column("_path")[0].as_py().encode()), schema)


def _node_paths(t: pa.Table, paths: list[list[bytes]]) -> pa.Table:
    return pa.table({"_g": t.column("_g"), "_pos": t.column("_pos"), "_path": [b",".join(p).decode() for p in paths]})


def _paths(nodes: DataFrame, levels: int, top: int):
    """Paths to the root of nodes (_g, _n, _pos, _digest): a broadcast of them all if they are few, else a frame; and the root."""
    spark = nodes.sparkSession
    if nodes.count() <= top:
        paths, root = _above(nodes.collect())
        return spark.sparkContext.broadcast(paths), None, root
    if not nodes.where("_n > 1").isEmpty():
        higher = cut(reduced(nodes, levels))
        sent, frame, root = _paths(higher, levels, top)
        return None, cut(_finished(nodes, levels, _node_paths, PATH, sent, frame)), root
    # a node for each of many groups: these are the leaves of the tree above, in order of group
    lined = _numbered(nodes.select(F.lit("").alias("_all"), "_g", "_digest"), "_all", ["_g"]).select(F.col("_g").alias("_old"), F.lit("").alias("_g"), "_n", "_pos", "_digest")
    lined = cut(lined)
    sent, frame, root = _paths(cut(reduced(lined, levels)), levels, top)
    found = _finished(lined, levels, lambda t, p: pa.table({"_g": t.column("_old"), "_pos": pa.array([0] * t.num_rows, pa.int64()), "_path": [b",".join(x).decode() for x in p]}), PATH, sent, frame)
    return None, cut(found), root


def manifest(df: DataFrame, by: str = "doc_id", group: str = "lang", fields: list[str] = FIELDS, altered: dict[str, Column] | None = None, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """Per row of df: `by`, leaf, subroot, root, proof (siblings from the leaf up, as L or R and digest, comma-joined),
    proof_sha256, folded_root (of the leaf with the fields `altered`, folded by the row's proof) and verified."""
    small_batches(df.sparkSession)
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # sorts as the group does, null first
    kept = leaf([F.col(c) for c in fields])
    changed = leaf([(altered or {}).get(c, F.col(c)) for c in fields])
    leaves = cut(df.select(F.col(by).alias("_id"), named.alias("_g"), kept.alias("_digest"), F.nullif(changed, kept).alias("_changed")))
    rows = _numbered(leaves, "_g", ["_id", "_digest"])
    nodes = cut(reduced(rows, levels))
    sent, frame, root = _paths(nodes, levels, top)
    root = root.decode()

    def of(t: pa.Table, paths: list[list[bytes]]) -> pa.Table:
        was = [d.encode() for d in t.column("_digest").to_pylist()]
        now = [c.encode() if c else d for c, d in zip(t.column("_changed").to_pylist(), was)]
        own = (t.column("_n")[0].as_py() - 1).bit_length()
        subroot = folded(was[0], paths[0][:own]).decode()
        back = [folded(d, p).decode() for d, p in zip(now, paths)]
        return pa.table({
            by: t.column("_id"), "leaf": t.column("_digest"), "subroot": [subroot] * t.num_rows, "root": [root] * t.num_rows, "proof": [b",".join(p).decode() for p in paths],
            "proof_sha256": [proof(p).decode() for p in paths], "folded_root": back, "verified": [b == root for b in back],
        })

    schema = f"`{by}` {df.schema[by].dataType.simpleString()}, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"
    return _finished(rows, levels, of, schema, sent, frame)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    altered = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return manifest(table(spark, sf_dir, "documents"), altered=altered).drop("proof")


def _sql() -> str:
    """The same in SQL: every level of either tree is a query over the one below."""
    h = "sha256(string_agg(h, '' ORDER BY pos))"
    up = lambda last, keys: f"SELECT {keys} pos // 2 AS pos, {h} AS h FROM {last} WHERE {{more}} GROUP BY ALL"
    own, top, low, high = [], [], 26, 12
    for k in range(low):
        own.append(f"a{k + 1} AS MATERIALIZED (WITH s AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM a{k}) " + up("s", "g,").format(more="c > 1") + ")")
    for k in range(high):
        top.append(f"b{k + 1} AS MATERIALIZED (WITH s AS (SELECT *, count(*) OVER () AS c FROM b{k}) " + up("s", "").format(more="c > 1") + ")")
    every = " UNION ALL ".join(f"SELECT {k} AS k, g, pos, h, count(*) OVER (PARTITION BY g) AS c FROM a{k}" for k in range(low + 1))
    upper = " UNION ALL ".join(f"SELECT {k} AS k, pos, h, count(*) OVER () AS c FROM b{k}" for k in range(high + 1))
    step = "CASE WHEN {b}.h IS NULL THEN '-' WHEN {b}.pos < {a}.pos THEN 'L' || {b}.h ELSE 'R' || {b}.h END"
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    put = lambda n: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    bits = "list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"""WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: {bits}) AS t),
        r0 AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {put("n_chars")} AS leaf, {put("(n_chars + 1)")} AS changed, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, (i + 1)::INT, 1))::BIGINT) AS bytes FROM documents),
        r1 AS (SELECT * EXCLUDE (bytes), coalesce(xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS hit FROM r0, crc),
        r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM r1),
        a0 AS (SELECT g, pos, leaf AS h FROM r), {", ".join(own)}, a AS MATERIALIZED ({every}),
        subroots AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM a WHERE c = 1 QUALIFY row_number() OVER (PARTITION BY g ORDER BY k) = 1),
        b0 AS (SELECT pos, h FROM subroots), {", ".join(top)}, b AS MATERIALIZED ({upper}),
        ups AS (SELECT s.g, list({step.format(a="x", b="y")} ORDER BY x.k) FILTER (x.c > 1) AS steps FROM subroots s JOIN b x ON x.pos = s.pos >> x.k LEFT JOIN b y ON y.k = x.k AND y.pos = xor(x.pos, 1) GROUP BY ALL),
        paths AS (SELECT r.g, r.pos, list({step.format(a="x", b="y")} ORDER BY x.k) FILTER (x.c > 1) AS steps FROM r JOIN a x ON x.g = r.g AND x.pos = r.pos >> x.k LEFT JOIN a y ON y.g = r.g AND y.k = x.k AND y.pos = xor(x.pos, 1) GROUP BY ALL),
        f AS (SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM b WHERE c = 1 ORDER BY k LIMIT 1) AS root, coalesce(p.steps, []) || coalesce(u.steps, []) AS steps, CASE WHEN hit THEN coalesce(changed, leaf) ELSE leaf END AS was FROM r JOIN subroots s USING (g) JOIN ups u USING (g) JOIN paths p ON p.g = r.g AND p.pos = r.pos),
        d AS (SELECT *, list_reduce(list_prepend(was, steps), lambda h, s: CASE WHEN s = '-' THEN sha256(h) WHEN s[1] = 'L' THEN sha256(s[2:] || h) ELSE sha256(h || s[2:]) END) AS folded_root FROM f)
        SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM d"""


OP12_SQL = _sql()
