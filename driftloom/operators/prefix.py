"""Running results over one long series, by parallel prefix.

Rows are dealt by ranges of (key, order), so that a key of any length is cut into blocks
that lie in different tasks. Each block gives a summary that can be combined with the next
one's: sums, a sum and its running minimum, the last known value, or an affine map. The
summaries are combined over a key's blocks (no more than there are partitions), and what
stands before a block is joined to its rows, on which a window of the block alone runs.

The order's values are distinct within a key; a null key is a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.operators.graph import stored


def blocks(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with the number of their range, ``_part``, sorted in it; stored."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, by, order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(by, order))


def _in_block(by: str, order: str):
    return W.partitionBy(by, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def _before(by: str):
    return W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def _with(rows: DataFrame, summaries: DataFrame, by: str) -> DataFrame:
    """Rows with what stands before their block: a stored table with a row a block, which
    Spark broadcasts or splits by its size."""
    s = stored(summaries).withColumnsRenamed({by: "_by", "_part": "_p"})
    return rows.join(s, (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_by"))).drop("_p", "_by")


def running_sums(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """``run_x`` for each column x, the sum up to the row."""
    dealt, w = blocks(rows, by, order), _in_block(by, order)
    sums = dealt.groupBy(by, "_part").agg(*[F.sum(c).alias(f"_s{k}") for k, c in enumerate(columns)])
    sums = sums.select(by, "_part", *[F.sum(f"_s{k}").over(_before(by)).alias(f"_b{k}") for k in range(len(columns))])
    both = lambda k, c: F.coalesce(F.col(f"_b{k}") + F.sum(c).over(w), f"_b{k}", F.sum(c).over(w))
    return _with(dealt, sums, by).select(*rows.columns, *[both(k, c).alias(f"run_{c}") for k, c in enumerate(columns)])


def page_hinkley(rows: DataFrame, by: str, order: str, x: str, delta: float, limit: float) -> DataFrame:
    """Cumulated deviation from the running mean less ``delta``, minus its running
    minimum, as ``ph``; ``drift`` where it is over the limit. Nulls don't count."""
    dealt, w = blocks(rows, by, order), _in_block(by, order)
    totals = dealt.groupBy(by, "_part").agg(F.count(x).alias("_n"), F.sum(F.col(x).cast("double")).alias("_s"))
    totals = totals.select(by, "_part", *[F.coalesce(F.sum(c).over(_before(by)), F.lit(0)).alias(f"{c}0") for c in ("_n", "_s")])
    away = _with(dealt, totals, by)
    mean = (F.col("_s0") + F.sum(F.col(x).cast("double")).over(w)) / (F.col("_n0") + F.count(x).over(w))
    away = away.withColumn("_d", F.coalesce(F.col(x) - mean - delta, F.lit(0.0))).withColumn("_c", F.sum("_d").over(w))
    lows = away.groupBy(by, "_part").agg(F.sum("_d").alias("_d"), F.min("_c").alias("_low"))
    lows = lows.withColumn("_c0", F.coalesce(F.sum("_d").over(_before(by)), F.lit(0.0)))
    lows = lows.select(by, "_part", "_c0", F.min(F.col("_c0") + F.col("_low")).over(_before(by)).alias("_low0"))
    out = _with(away, lows, by).withColumn("_c", F.col("_c") + F.col("_c0"))
    low = F.least(F.min("_c").over(w), "_low0")
    return out.withColumn("ph", F.col("_c") - low).withColumn("drift", F.col("ph") > limit).select(*rows.columns, "ph", "drift")


def frozen(rows: DataFrame, by: str, order: str, value: str, drift: str, n: int) -> DataFrame:
    """``held`` from a drift on for n rows; ``frozen``, the last value (not null) from
    a row that isn't held."""
    dealt, w = blocks(rows, by, order), _in_block(by, order)
    dealt = dealt.withColumn("_i", F.row_number().over(w)).withColumn("_at", F.when(F.col(drift), F.col("_i")))
    counts = dealt.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.max("_at").alias("_at"))
    counts = counts.withColumn("_n0", F.coalesce(F.sum("_n").over(_before(by)), F.lit(0)))
    counts = counts.select(by, "_part", "_n0", F.max(F.col("_n0") + F.col("_at")).over(_before(by)).alias("_at0"))
    marked = _with(dealt, counts, by).withColumn("_i", F.col("_n0") + F.col("_i"))
    last = F.greatest("_at0", F.col("_n0") + F.max("_at").over(w))
    marked = marked.withColumn("held", F.coalesce(F.col("_i") - last <= n, F.lit(False))).withColumn("_free", F.when(~F.col("held"), F.col(value)))
    known = marked.filter("_free IS NOT NULL").groupBy(by, "_part").agg(F.max_by("_free", "_i").alias("_free"))
    known = marked.select(by, "_part").distinct().join(known.withColumnsRenamed({by: "_by", "_part": "_p"}), (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_by")), "left")
    known = known.select(by, "_part", F.last("_free", ignorenulls=True).over(_before(by)).alias("_free0"))
    out = _with(marked, known, by)
    return out.select(*rows.columns, "held", F.coalesce(F.last("_free", ignorenulls=True).over(w), "_free0").alias("frozen"))


def _from_zero(lam: float, names: list[str]):
    """In each block, the mean as if the one before it were 0, and the row's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, mean, place = None, 0.0, 0
        for batch in batches:
            # a block's rows come one after the other
            key = list(zip(batch.column("_key").to_pylist(), batch.column("_part").to_pylist(), strict=True))
            means, places = np.empty(batch.num_rows), np.empty(batch.num_rows, np.int64)
            for k, (now, x) in enumerate(zip(key, batch.column("_x").to_pylist(), strict=True)):
                if now != block:
                    block, mean, place = now, 0.0, 0
                if x is not None:
                    mean, place = lam * x + (1 - lam) * mean, place + 1
                means[k], places[k] = mean, place
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(means), pa.array(places)], names=[*names, "_z", "_n"])

    return run


def ewma(rows: DataFrame, by: str, order: str, x: str, lam: float = 0.15) -> DataFrame:
    """m = lam x + (1 - lam) m, the first value as start, over the whole series. Nulls
    leave the mean as it is (null before the first value). A block is the affine map
    m -> (1 - lam)^n m + z, and its rows are so many steps into it."""
    dealt = blocks(rows.withColumn("_key", F.col(by).cast("string")).withColumn("_x", F.col(x).cast("double")), by, order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    names = dealt.columns
    # the stored files keep each range's order, but a reader may cut or join them
    placed = dealt.repartition(by, "_part").sortWithinPartitions(by, "_part", order).mapInArrow(_from_zero(lam, names), f"{kinds}, _z double, _n long")
    placed = stored(placed)
    ends = placed.groupBy(by, "_part").agg(F.max(F.struct("_n", "_z")).alias("_e"), F.min(F.when(F.col("_x").isNotNull(), F.struct(order, "_x"))).alias("_f"))
    one = F.array_sort(F.collect_list(F.struct("_part", F.col("_e._n").alias("n"), F.col("_e._z").alias("z"))))
    keys = ends.groupBy(by).agg(one.alias("_l"), F.min("_f").alias("_f")).withColumn("_first", F.col("_f._x"))
    step = lambda m, b: F.pow(F.lit(1 - lam), b["n"]) * m + b["z"]
    starts = F.transform("_l", lambda b, k: F.struct(b["_part"].alias("_part"), F.aggregate(F.slice("_l", F.lit(1), k), F.col("_first"), step).alias("_m0")))
    starts = keys.select(by, F.explode(starts).alias("_s")).select(by, "_s._part", "_s._m0")
    mean = F.when(F.col("_n") > 0, F.pow(F.lit(1 - lam), F.col("_n")) * F.col("_m0") + F.col("_z")).otherwise(F.col("_m0"))
    # before its first value a key has no mean
    firsts = keys.select(by, F.col(f"_f.{order}").alias("_o")).withColumnRenamed(by, "_k")
    out = _with(placed, starts, by).join(stored(firsts), F.col(by).eqNullSafe(F.col("_k")))
    return out.select(*rows.columns, F.when(F.col(order) >= F.col("_o"), mean).alias("ewma"))
