"""Values on nodes: normalising, blending, percentiles, rolling up a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators.graph import stored
from driftloom.operators.selection import joined, percentiles


def minmax(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Into [0, 1] by smallest and largest; a constant is 0. One aggregation, whose
    result is joined (a single row or one a group), rather than a window over all."""
    s = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = rows.join(s, list(by)) if by else rows.crossJoin(s)
    return j.withColumn("norm", F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def robust(rows: DataFrame, value: str, by: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Into [0, 1] by two quantiles, clipped. They are selected exactly by histograms;
    no group is gathered."""
    s = stored(percentiles(rows, value, by, {"_lo": low, "_hi": high}))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
    return rows.join(s, list(by)).withColumn("norm", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - F.col("_lo")) / width))).drop("_lo", "_hi")


def summary(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """N, min, max, mean, p50, p90."""
    s = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    p = stored(percentiles(rows, value, list(by), {"p50": 0.5, "p90": 0.9}))
    return joined(s, p, list(by), "left")


def blend(fields: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of named fields (name, node, value) over the union of nodes,
    missing values 0, weights made to sum up to 1."""
    total = sum(weights.values()) or 1.0
    w = F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v / total)]), F.col("name"))
    return fields.filter(F.col("name").isin(*weights)).groupBy("node").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(w * F.col("value")))).alias("value"))


def relative_filter(rows: DataFrame, value: str, least: float) -> DataFrame:
    """Rows with a share of the largest value of at least ``least``."""
    top = rows.agg(F.max(value).alias("_m"))
    return rows.crossJoin(top).filter((F.col("_m") > 0) & (F.col(value) / F.col("_m") >= least)).drop("_m")


def looked_up(nodes: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Node values by key, 0 where there is none."""
    return nodes.join(values, key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def rolled_up(child: DataFrame, parent_of: DataFrame, key: str, parent: str, value: str, mode: str = "mean") -> DataFrame:
    """Values of children aggregated on their parents; no child is 0."""
    agg = {"mean": F.avg(value), "sum": F.sum(value), "max": F.max(value)}[mode]
    return parent_of.join(child, key, "left").groupBy(parent).agg(F.coalesce(agg, F.lit(0.0)).alias(value))


def point_similarity(rows: DataFrame, by: str, q: float = 0.95, weights: tuple = (1.0, 1.0, 0.25)) -> DataFrame:
    """1 less the distance to a percentile point of S, H and Z over the largest."""
    # one selection for all three: a row for each of them
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in "SHZ"])).alias("e")).select("e.axis", "e.v")
    point = percentiles(long, "v", ["axis"], {"at": q})
    ref = point.agg(*[F.max(F.when(F.col("axis") == c, F.col("at"))).alias(f"_{c}") for c in "SHZ"])
    d = F.sqrt(sum((w * F.pow(F.col(c) - F.col(f"_{c}"), 2) for c, w in zip("SHZ", weights, strict=True)), F.lit(0.0)))
    x = rows.crossJoin(ref).select(by, d.alias("d"))
    return x.crossJoin(x.agg(F.max("d").alias("_m"))).select(by, F.when(F.col("_m") > 0, 1 - F.col("d") / F.col("_m")).otherwise(1.0).alias("sim"))
