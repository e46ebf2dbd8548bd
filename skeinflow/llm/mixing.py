"""Mixing sources to target weights: equal-token blocks apportioned by Sainte-Lague, then taken by seeded selection.

Targets. Sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all words; a source's target stops at
`most` times its size and the excess is shared again by weight, until no target lies above.

Blocks. Documents are dealt to shards of about SHARD_ROWS rows by a seeded hash. A shard holds its part of every source
(a cell), and each cell's part of its source's target is its weight there. The shard's blocks, all of the same number
of words, go one by one to the cell with the highest quotient weight / (2 * seats + 1), as long as the cell isn't used
up `most` times; that gives the integer quota of each cell. The seats are counted, never listed: work doesn't depend
on the number of blocks. A cell's documents stand in seeded order on a line of words that is cut into blocks; a quota
takes whole passes over the line and then a run of blocks from a seeded start, around the end.

Only (document, source, size) rows are shuffled, and the line is a window within a cell, so a source with a third of all
rows is spread over all shards. Null texts have size 0. A null source is a source like any other. Rows with the same
id stand next to each other, in order of size. Equal seeds give equal results. Of a very long text only its size is kept;
it lies on the line like any other and may be taken in part. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cuts import cut
from .texts import table

SEED = "mix-1"
SHARD_ROWS = 5_000
MOST = 3
WEIGHTS = (1, 2, 3)


def hash_number(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 that only the parts decide."""
    joined = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def _summed_before(df: DataFrame, order: list[Column], names: list[str]) -> DataFrame:
    """Adds `rank` (from 1) in an order without ties and, for each name, its sum over the rows before as `<name>_before`.

    Rows are dealt by ranges of the order, each summed by a task of its own; only the ranges' totals, a row each, meet.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))  # ranges are drawn by sampling: once
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).alias(f"_{n}")
    sums = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *map(total, names))
    earlier = Window.orderBy("_range").partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    bases = sums.select(F.col("_range").alias("_r"), *(so_far(f"_{c}", earlier).alias(f"_base_{c}") for c in ("n", *names)))
    own = Window.partitionBy("_range").orderBy(*order)
    met = dealt.join(F.broadcast(bases), F.col("_range") == F.col("_r"))  # as many rows as there are ranges
    above = own.rowsBetween(Window.unboundedPreceding, -1)
    return met.select(*df.columns, (F.col("_base_n") + F.row_number().over(own)).alias("rank"), *((F.col(f"_base_{n}") + so_far(n, above)).alias(f"{n}_before") for n in names))


def source_targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From rows (source, size): one row a source with source_size and target. Sources may be as many as the rows: no task sees all of them."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = _summed_before(by, [F.col("source").asc_nulls_last()], []).select("source", "source_size", F.col("rank").alias("place"), weight.alias("weight"))
    # sources meet their stop in order of size / weight: if all up to this one had stopped, would it stop too?
    share = F.col("source_size") / F.col("weight")
    placed = cut(_summed_before(ranked, [share.asc(), F.col("place").asc()], ["source_size", "weight"]))
    everything, weighed = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, left = F.lit(everything) - most * F.col("source_size_before"), F.lit(weighed) - F.col("weight_before")
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  words times weights are beyond a long if sources are many
    stops = wide(rest) * F.col("weight") >= wide(most * F.col("source_size")) * left
    level = placed.where(~stops).agg(F.min(F.struct("rank", rest.alias("rest"), left.alias("left"))).alias("first")).first().first
    open_target = F.lit(float(level.rest)) / F.lit(float(level.left)) * F.col("weight") if level else F.lit(None)
    target = F.when(stops, (most * F.col("source_size")).cast("double")).otherwise(open_target.cast("double"))
    return placed.select("source", "source_size", target.alias("target"))


def seats(weights: list[float], caps: list[int], total: int) -> list[int]:
    """Sainte-Lague: `total` seats by highest quotients weight / (2k + 1), the first cell on ties, up to each cap."""
    n, whole = len(weights), sum(weights)
    if not whole or total <= 0:
        return [0] * n
    total = min(total, sum(c for w, c in zip(weights, caps) if w > 0))
    w, most = np.asarray(weights, float), np.asarray(caps, np.int64)
    reached = lambda q: np.minimum(most, np.floor((w / q + 1) / 2))  # noqa: E731  seats whose quotients are q or more
    low, high = 0.0, 2.0 * max(weights)  # with all quotients from high on there are no more seats than wanted
    for _ in range(80):
        middle = (low + high) / 2
        if middle > 0 and reached(middle).sum() <= total:
            high = middle
        else:
            low = middle
    given = np.maximum(0, reached(high) - 1).astype(np.int64).tolist()  # one less, for rounding; the rest go one by one
    heap = [(-x / (2 * g + 1), i) for i, (x, g, c) in enumerate(zip(weights, given, caps)) if g < c and x > 0]
    heapq.heapify(heap)
    for _ in range(total - sum(given)):
        _, i = heap[0]
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heapreplace(heap, (-weights[i] / (2 * given[i] + 1), i))
        else:
            heapq.heappop(heap)
    return given


def mix(df: DataFrame, keep: list[str], by: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, most: int = MOST) -> DataFrame:
    """`keep`, size, source_size, target, taken for each row of df."""
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = cut(df.select(F.struct(*keep).alias("kept"), F.col(source).cast("string").alias("source"), size.alias("size"), hash_number(F.lit(seed), F.col(by)).alias("at"), F.col(by).alias("by")))
    rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(1, math.ceil(rows / SHARD_ROWS))
    targets = source_targets(sized, most)
    smallest = targets.where("source_size > 0").agg(F.min("source_size")).first()[0] or 1
    block = max(1, min(words // (shards << 16), smallest // (64 * shards)))

    dealt = sized.withColumn("shard", F.col("at") % shards)
    cells = dealt.groupBy("shard", "source").agg(F.sum("size").alias("cell_size"))
    same = cells["source"].eqNullSafe(targets["source"])
    weight = F.when(F.col("source_size") > 0, F.col("target") * F.col("cell_size") / F.col("source_size")).otherwise(0.0)
    weighed = cells.join(targets, same).select("shard", cells["source"], "cell_size", "source_size", "target", weight.alias("weight"))

    def quotas(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("source", na_position="last", key=lambda s: s.map(lambda x: x.encode(), na_action="ignore"))
        n = [max(1, round(s / block)) if s else 0 for s in cell.cell_size.tolist()]
        given = seats(cell.weight.tolist(), [most * x for x in n], math.floor(cell.weight.sum() / block + 0.5))
        return cell.assign(blocks=n, quota=given)

    quota = weighed.groupBy("shard").applyInPandas(quotas, "shard bigint, source string, cell_size bigint, source_size bigint, target double, weight double, blocks bigint, quota bigint")
    line = Window.partitionBy("shard", "source").orderBy("at", F.col("by").asc_nulls_first(), "size")
    placed = dealt.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    q = quota.withColumnsRenamed({"shard": "_shard", "source": "_source"})
    met = placed.join(q, (F.col("shard") == F.col("_shard")) & F.col("source").eqNullSafe(F.col("_source")))
    passes, run = F.expr("quota div greatest(blocks, 1)"), F.expr("quota % greatest(blocks, 1)")
    first = hash_number(F.lit(seed), F.col("shard"), F.col("source")) % F.greatest("blocks", F.lit(1))
    met = met.withColumns({"passes": passes, "first": first, "last": first + run})
    edge = lambda i: F.expr(f"(cell_size * ({i})) div greatest(blocks, 1)")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least("end", b) - F.greatest("start", a))
    part = overlap(edge("first"), edge("least(last, blocks)")) + F.when(F.col("last") > F.col("blocks"), overlap(F.lit(0), edge("last - blocks"))).otherwise(0)
    return met.select("kept.*", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), ["doc_id"])


#: The same in DuckDB. Its candidate quotients run `slack` seats to either side of each cell's share.
OP7_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS spot
  FROM documents),
totals AS (SELECT greatest(1, CAST(ceil(count(*) / 5000.0) AS BIGINT)) AS shards, coalesce(sum(size), 0)::BIGINT AS words FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighted AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM sources),
placed AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::BIGINT AS rest,
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS remaining
  FROM weighted WINDOW before AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(rest, (source_size / weight, rank)) AS rest, arg_min(remaining, (source_size / weight, rank)) AS remaining
  FROM placed WHERE NOT rest * weight >= 3 * source_size * remaining),
targets AS (
  SELECT source, source_size, CASE WHEN p.rest * weight >= 3 * source_size * p.remaining THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(level.rest AS DOUBLE) / level.remaining * weight END AS target
  FROM placed p LEFT JOIN level ON true),
block AS (
  SELECT shards, greatest(1, least(words // (shards * 65536), (SELECT coalesce(min(source_size), 1) FROM sources WHERE source_size > 0) // (64 * shards))) AS block FROM totals),
dealt AS (SELECT sized.*, spot % shards AS shard FROM sized, totals),
cells AS (SELECT shard, source, sum(size)::BIGINT AS cell_size FROM dealt GROUP BY ALL),
weighed AS (
  SELECT shard, c.source, cell_size, source_size, target, CASE WHEN source_size > 0 THEN target * cell_size / source_size ELSE 0.0 END AS weight,
    CASE WHEN cell_size = 0 THEN 0 ELSE greatest(1, CAST(round_even(cell_size / block, 0) AS BIGINT)) END AS blocks, block
  FROM cells c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source, block),
shares AS (
  SELECT *, least(floor(sum(weight) OVER s / block + 0.5), sum(CASE WHEN weight > 0 THEN 3 * blocks ELSE 0 END) OVER s) AS total,
    sum(weight) OVER s AS whole, count(*) OVER s AS n
  FROM weighed WINDOW s AS (PARTITION BY shard)),
given AS (SELECT *, CAST(least(3 * blocks, greatest(0, floor(CASE WHEN whole > 0 THEN total * weight / whole ELSE 0 END) - (3 * n + 4))) AS BIGINT) AS base FROM shares),
extra AS (
  SELECT g.shard, g.source, count(*) AS extra FROM (
    SELECT g.*, base + k AS seat, row_number() OVER (PARTITION BY shard ORDER BY weight / (2 * (base + k) + 1) DESC, source NULLS LAST, k) AS place
    FROM given g, LATERAL (SELECT unnest(range(0, CAST(6 * n + 12 AS BIGINT))) AS k) WHERE weight > 0 AND base + k < 3 * blocks) g
  JOIN (SELECT shard, min(total) - sum(base) AS open FROM given GROUP BY shard) o USING (shard) WHERE place <= open GROUP BY ALL),
quota AS (
  SELECT g.*, base + coalesce(extra, 0) AS quota FROM given g LEFT JOIN extra e ON g.shard = e.shard AND g.source IS NOT DISTINCT FROM e.source),
run AS (
  SELECT *, quota // greatest(blocks, 1) AS passes, first, first + quota % greatest(blocks, 1) AS last FROM (
    SELECT *, CAST('0x' || substr(md5('mix-1:' || CAST(shard AS VARCHAR) || ':' || coalesce(source, 'null')), 1, 8) AS BIGINT) % greatest(blocks, 1) AS first FROM quota)),
lined AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY shard, source ORDER BY spot, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM dealt)
SELECT doc_id, size, source_size, target,
  CAST(passes * size + greatest(0, least(stop, cell_size * least(last, blocks) // greatest(blocks, 1)) - greatest(stop - size, cell_size * first // greatest(blocks, 1)))
    + CASE WHEN last > blocks THEN greatest(0, least(stop, cell_size * (last - blocks) // greatest(blocks, 1)) - (stop - size)) ELSE 0 END AS BIGINT) AS taken
FROM lined l JOIN run r ON l.shard = r.shard AND l.source IS NOT DISTINCT FROM r.source
"""
