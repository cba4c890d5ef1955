"""Ordered series: n-grams, thresholds, drift, blocks, layouts, Pareto fronts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.operators.prefix import ewma, frozen, page_hinkley
from driftloom.operators.prefix import running_sums as ledger

__all__ = ["ewma", "frozen", "ledger", "page_hinkley"]  # series of any length

MAD_SCALE = 1.4826


def bigrams(rows: DataFrame, by: list[str], order: str, item: str) -> DataFrame:
    """Pairs of neighbours in order, counted."""
    second = F.lead(item).over(W.partitionBy(*by).orderBy(order))
    x = rows.select(*by, F.col(item).alias("first"), second.alias("second")).filter("second IS NOT NULL")
    return x.groupBy(*by, "first", "second").agg(F.count("*").alias("cnt"))


def sequence_fingerprint(rows: DataFrame, by: str, order: str, item: Column) -> DataFrame:
    """SHA-256 of the items in order and their bigrams, joined by bars."""
    items = rows.select(by, order, item.alias("_item"))
    items = items.withColumn("_next", F.lead("_item").over(W.partitionBy(by).orderBy(order)))
    ordered = F.array_sort(F.collect_list(F.struct(order, "_item", "_next")))
    g = items.groupBy(by).agg(ordered.alias("_l"))
    words = F.transform("_l", lambda s: s["_item"])
    pairs = F.transform(F.filter("_l", lambda s: s["_next"].isNotNull()), lambda s: F.concat_ws(">", s["_item"], s["_next"]))
    return g.select(by, F.sha2(F.array_join(F.concat(words, pairs), "|"), 256).alias("fingerprint"))


def block_lengths(defs: DataFrame, by: str, line: str, total: str) -> DataFrame:
    """Lines up to the next definition, or the end of the file; 1 at least."""
    nxt = F.coalesce(F.lead(line).over(W.partitionBy(by).orderBy(line)), F.col(total) + 1)
    return defs.withColumn("length", F.greatest(F.lit(1), nxt - F.col(line)))


def sampled(ids: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """Every max(1, n div k)-th id in order, k at most."""
    w = W.partitionBy(by)
    x = ids.withColumn("_r", F.row_number().over(w.orderBy(key)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    return x.filter((F.col("_r") % step == 0) & (F.col("_r") / step < k)).drop("_r", "_n")


def grid_layout(nodes: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Rows and columns of a nearly square grid in a fixed order, with centres."""
    w = W.partitionBy(by)
    x = nodes.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    cols = F.ceil(F.sqrt("_n")).cast("int")
    rows = F.ceil(F.col("_n") / cols).cast("int")
    out = x.withColumn("row", F.floor(F.col("_i") / cols).cast("int")).withColumn("col", (F.col("_i") % cols).cast("int"))
    return out.withColumn("u", (F.col("col") + 0.5) / cols).withColumn("v", (F.col("row") + 0.5) / rows).drop("_i", "_n")


def rolling_thresholds(rows: DataFrame, by: str, order: str, x: str, n: int = 90) -> DataFrame:
    """q90, q95 and q99 of the last n rows as alpha, beta and z."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)

    def quantile(q: float) -> Column:
        place = (F.size("_s") - 1) * F.lit(q)
        low = F.element_at("_s", F.floor(place).cast("int") + 1)
        high = F.element_at("_s", F.ceil(place).cast("int") + 1)
        return F.when(F.size("_s") > 0, low + (high - low) * (place - F.floor(place)))

    # one sorted frame for all three
    out = rows.withColumn("_l", F.collect_list(F.col(x).cast("double")).over(w)).withColumn("_s", F.array_sort("_l"))
    return out.select(*rows.columns, quantile(0.90).alias("alpha"), quantile(0.95).alias("beta"), quantile(0.99).alias("z"))


def rolling_mad(rows: DataFrame, by: str, order: str, x: str, n: int = 90) -> DataFrame:
    """Median of the last n rows and 1.4826 times the median distance from it."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)

    def median(values: Column) -> Column:
        s, k = F.array_sort(values), F.size(values)
        low, high = F.element_at(s, ((k + 1) / 2).cast("int")), F.element_at(s, (k / 2 + 1).cast("int"))
        return (low + high) / 2

    out = rows.withColumn("_l", F.collect_list(F.col(x).cast("double")).over(w)).withColumn("median", median(F.col("_l")))
    away = F.transform("_l", lambda v: F.abs(v - F.col("median")))
    return out.withColumn("sigma", MAD_SCALE * median(away)).drop("_l")


def robust_z(rows: DataFrame, x: str, mean: str, sigma: str) -> DataFrame:
    """Distance in robust deviations; 0 where there is no spread."""
    return rows.withColumn("z_score", F.when(F.col(sigma) > 0, (F.col(x) - F.col(mean)) / F.col(sigma)).otherwise(0.0))


def latest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of a key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def _local_fronts(by: list[str], high: str, low: str, ties: list[str]):
    """Of a task's rows, those that no other row of the task shows not to be on the front.
    Of equal rows the first by ``ties`` stays. Held are the fronts so far; rows with nulls are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            full = pc.and_(pc.is_valid(rows[high]), pc.is_valid(rows[low]))
            yield from rows.filter(pc.invert(full)).to_batches()
            rows = rows.filter(full)
            rows = rows if held is None else pa.concat_tables([held, rows])
            x = pd.DataFrame({"key": np.zeros(len(rows), int), "high": rows[high].to_numpy(), "low": rows[low].to_numpy(), "at": np.arange(len(rows))})
            if by:
                x["key"] = rows.select(by).to_pandas().groupby(by, dropna=False, sort=False).ngroup()
            if ties:
                first = rows.select(ties).rename_columns([f"t{k}" for k in range(len(ties))]).to_pandas()
                x = x.loc[first.sort_values(list(first.columns), kind="stable", na_position="first").index]
            x = x.sort_values(["key", "high", "low"], ascending=[True, False, True], kind="stable")
            before = x.groupby("key")["low"].cummin().groupby(x["key"]).shift()
            held = rows.take(pa.array(x.loc[before.isna() | (x["low"] < before), "at"])).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return run


def pareto_front(rows: DataFrame, by: str | None, high: str, low: str) -> DataFrame:
    """Rows for which no row with more of ``high`` has as little of ``low``, by key, or
    of all rows; of rows equal in these one, the first by the other columns in turn. Each task
    finds the fronts of its own rows first, so only those are shuffled and merged."""
    keys = [by] if by else []
    ties = [c for c in rows.columns if c not in (by, high, low)]
    x = rows.withColumns({"_h": F.col(high).cast("double"), "_l": F.col(low).cast("double")})
    x = x.mapInArrow(_local_fronts(keys, "_h", "_l", ties), x.schema).drop("_h", "_l")
    w = W.partitionBy(*keys).orderBy(F.desc(high), F.asc(low), *ties).rowsBetween(W.unboundedPreceding, -1)
    return x.withColumn("_m", F.min(low).over(w)).filter(F.col("_m").isNull() | (F.col(low) < F.col("_m"))).drop("_m")

