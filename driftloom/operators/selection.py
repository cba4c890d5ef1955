"""Exact percentiles by refined histograms.

Every wanted rank has an interval of values that it must lie in. A pass counts the values
inside by bins, from which follows the bin of the rank; the smallest and largest value in it
are the next interval. The first bins are powers of two, so that no range is too wide; then
an interval is cut into BINS equal parts, until it holds one value. That takes at most six
passes of doubles, and no buffer or task ever holds more than the bins of a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.operators.graph import stored

BINS = 2048


def _power(x: Column) -> Column:
    """Bins by sign and power of two, in order of the values; NaN is the largest."""
    size = lambda v: F.floor(F.log2(v)).cast("int") + 1200
    return F.when(F.isnan(x), 3000).when(x == float("inf"), 2500).when(x == float("-inf"), -2500).when(x > 0, size(x)).when(x < 0, -size(-x)).otherwise(0)


def joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on ``by`` in which null keys meet; the right side's keys are dropped."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    if not on:  # a single row, known by a constant
        left, right, on = left.withColumn("_one", F.lit(1)), right.withColumn("_r__one", F.lit(1)), [F.col("_one") == F.col("_r__one")]
    return left.join(right, on, how).drop("_one", *[f"_r_{c}" for c in [*by, "_one"]])


def at_ranks(rows: DataFrame, value: str, by: list[str], ranks: DataFrame) -> DataFrame:
    """``by, rank, found``: the value at each rank (from 0, by ``by, rank``) of the values
    that aren't null, in order."""
    x = rows.select(*by, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    lo, hi = F.lit(float("-inf")), F.lit(float("nan"))
    open_ = stored(ranks.select(*by, "rank").distinct().select(*by, "rank", lo.alias("_lo"), hi.alias("_hi"), F.lit(0).cast("long").alias("_below")))
    done, first = [], True
    while open_.limit(1).count():
        near = joined(x, open_, by)
        if first:
            digit = _power(F.col("_x"))
        else:
            near = near.filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
            digit = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS).cast("int"), F.lit(BINS - 1))
        bins = near.groupBy(*by, "rank", "_below", digit.alias("_d")).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        w = W.partitionBy(*by, "rank").orderBy("_d")
        bins = bins.withColumn("_upto", F.col("_below") + F.sum("_n").over(w))
        hit = bins.filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_n")))
        hit = stored(hit.select(*by, "rank", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_below")))
        one = F.col("_lo") == F.col("_hi")
        done.append(hit.filter(one).select(*by, "rank", F.col("_lo").alias("found")))
        open_, first = hit.filter(~one), False
    out = done[0] if done else open_.select(*by, "rank", F.col("_lo").alias("found"))
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def percentiles(rows: DataFrame, value: str, by: list[str], wanted: dict[str, float], nearest: bool = False) -> DataFrame:
    """``by`` and a column for each name and share wanted: the percentile of ``value``,
    between two ranks by linear interpolation, or (``nearest``) at the rank
    ``bround(q (n - 1))``. Null where a group has no value."""
    names = list(wanted)
    n = stored(rows.groupBy(*by).agg(F.count(value).alias("_n")))
    place = {c: (F.bround(F.lit(q) * (F.col("_n") - 1)) if nearest else F.lit(q) * (F.col("_n") - 1)) for c, q in wanted.items()}
    ends = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in place.values()])))
    found = at_ranks(rows, value, by, n.filter("_n > 0").select(*by, F.explode(ends).alias("rank")))
    known = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("_m"))
    out = joined(n, stored(known), by, "left")

    def between(p: Column) -> Column:
        low, high = (F.col("_m").getItem(f(p).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return out.select(*by, *[between(place[c]).alias(c) for c in names])
