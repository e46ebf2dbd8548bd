"""Exact quantiles and densities of measures by group, from counts of ranges: no task holds a group's values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Ranges that an interval is cut into, the number of values that are sorted in one row, and the rows of a table that is sent to all tasks.
RANGES, FEW, SENT = 1024, 4096, 100_000


def quantiles(df: DataFrame, group: str, x: str, at: list[float], ranges: int = RANGES, few: int = FEW) -> DataFrame:
    """(group, p, value) by linear interpolation, as exact as sorting each group.

    A quantile lies between two ranks. The interval that holds a rank is cut into ranges, whose counts tell in which one it
    lies; that range's own least and greatest value are the next interval. Once it holds one value, or few enough to sort,
    the rank is read off. Two or three passes do, whatever the group's size; each keeps counts of ranges only. Null
    groups are a group; null and NaN values are left out; a group without values gives no rows.
    """
    rows = df.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    whole = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.col("p") * (F.col("n") - 1)
    wanted = whole.withColumn("p", F.explode(F.array(*map(F.lit, map(float, at))))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    rank = F.when(F.col("side") == 0, F.floor(place)).otherwise(F.ceil(place))
    state = settled(wanted.select("g", "p", "side", rank.cast("long").alias("k"), "n", "lo", "hi", (place - F.floor(place)).alias("part")))
    keys = ["g", "p", "side"]

    def inside(some: DataFrame) -> DataFrame:
        some = some.withColumnRenamed("g", "_g")
        return rows.join(F.broadcast(some) if some.count() <= SENT else some, F.col("g").eqNullSafe(F.col("_g")) & F.col("x").between(F.col("lo"), F.col("hi"))).drop("_g")

    while not (open_ := state.where((F.col("lo") < F.col("hi")) & (F.col("n") > few))).isEmpty():
        bin_ = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * ranges), F.lit(ranges - 1))
        counts = inside(open_).groupBy(*keys, "k", "part", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = counts.withColumn("_before", before).where((F.col("_before") <= F.col("k")) & (F.col("k") < F.col("_before") + F.col("n")))
        state = settled(state.where((F.col("lo") == F.col("hi")) | (F.col("n") <= few)).unionByName(held.select(*keys, (F.col("k") - F.col("_before")).alias("k"), "n", "lo", "hi", "part")))
    sorted_ = inside(state.where("lo < hi")).groupBy(*keys, "k", "part").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    found = sorted_.select(*keys, "part", F.element_at("xs", (F.col("k") + 1).cast("int")).alias("v")).unionByName(state.where("lo = hi").select(*keys, "part", F.col("lo").alias("v")))
    low, high = (F.max(F.when(F.col("side") == s, F.col("v"))) for s in (0, 1))
    return found.groupBy("g", "p").agg((low + F.max("part") * (high - low)).alias("value")).withColumnRenamed("g", group)


def densities(df: DataFrame, group: str, x: str, points: int = 100, bins: int = 1024, reach: float = 2.0) -> DataFrame:
    """(group, i, at, density): a Gaussian kernel density on a grid of each group, what a violin shows.

    The bandwidth is Scott's, n**(-1/5) deviations, and the grid goes `reach` bandwidths beyond the least and greatest value. The
    kernel is applied to histograms of `bins` equal parts, which add up over tasks, so a value counts at its part's middle. Groups of one
    value have no density and give no rows; null and NaN values are left out.
    """
    rows = df.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    each = rows.groupBy("g").agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("hi > lo")
    stats = settled(each.select("g", "n", "lo", "hi", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw")))
    sent = stats.withColumnRenamed("g", "_g")
    met = rows.join(F.broadcast(sent) if stats.count() <= SENT else sent, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
    width = (F.col("hi") - F.col("lo")) / bins
    part = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    histogram = met.groupBy("g", "n", "lo", "hi", "bw", part.alias("part")).agg(F.count("*").alias("m")).withColumn("mid", F.col("lo") + (F.col("part") + 0.5) * width)
    grid = F.col("lo") - reach * F.col("bw") + F.col("i") * ((F.col("hi") - F.col("lo") + 2 * reach * F.col("bw")) / (points - 1))
    spread = histogram.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", grid)  # bins by points for a group
    kernel = F.exp(-0.5 * F.pow((F.col("at") - F.col("mid")) / F.col("bw"), F.lit(2.0)))
    summed = spread.groupBy("g", "i", "at", "n", "bw").agg(F.sum(F.col("m") * kernel).alias("s"))
    return summed.select(F.col("g").alias(group), "i", "at", (F.col("s") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"))
