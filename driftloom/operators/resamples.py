"""Bootstrap intervals with counts that add up, as drawing with replacement has them.

Equal values are counted. How often each of them is drawn in a round of n draws is
multinomial; a tree splits the draws: the root's n among its children by their weights, each
child's among its own, down to blocks of LEAF distinct values. A split is a chain of
conditional binomials from a generator that a digest of seed, arm and node starts, so that
reruns agree and any task can make any node. All rounds of a node are one row; a node and
its children are the most that a task holds (LEAF values times the rounds).

A round's mean is a sum over blocks. Its median lies in the block where the running sum of
the blocks' draws passes the middle, in order of the values.

Null values aren't drawn; an arm without values has null limits; a null arm is an arm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.operators.graph import stored
from driftloom.operators.prefix import running_sums
from driftloom.operators.selection import joined

LEAF = FANOUT = 512


def _drawn(seed: int, level: int, arm: str, node: int, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Draws of a node's children in each round: rounds x children."""
    start = int.from_bytes(hashlib.sha256(f"{seed}/{level}/{arm}/{node}".encode()).digest()[:16], "big")
    return np.random.Generator(np.random.Philox(key=start)).multinomial(counts, weights / weights.sum())


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's list as an array; nothing is copied."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _split(seed: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arms, nodes = batch.column("_arm").to_pylist(), batch.column("node").to_pylist()
            for arm, node, counts, kids, weights in zip(arms, nodes, *map(_lists, (batch.column(c) for c in ("counts", "kids", "weights"))), strict=True):
                draws = _drawn(seed, level, arm, node, counts, weights.astype(np.float64)).T
                yield pa.RecordBatch.from_arrays([pa.array([arm] * len(kids), pa.string()), pa.array(kids, pa.int64()), pa.array(list(draws), pa.list_(pa.int64()))], names=["_arm", "node", "counts"])

    return run


def _measured(seed: int):
    """Of each block: sums of its draws and, in rounds whose middle lies in it, the values
    there. ``below`` are the draws of the blocks before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("counts", "below", "values", "weights")
        for batch in batches:
            arms, nodes, sizes = (batch.column(c).to_pylist() for c in ("_arm", "node", "n"))
            for arm, node, n, counts, below, values, weights in zip(arms, nodes, sizes, *map(_lists, (batch.column(c) for c in names)), strict=True):
                draws = _drawn(seed, 0, arm, node, counts, weights.astype(np.float64))
                upto, middle = below[:, None] + draws.cumsum(axis=1), []
                for rank in ((n - 1) // 2, n // 2):
                    inside = (below <= rank) & (rank < upto[:, -1])
                    at = values[(upto > rank).argmax(axis=1)]
                    middle.append(pa.array(at, pa.float64(), mask=~inside))
                yield pa.RecordBatch.from_arrays([pa.array([arm] * len(counts), pa.string()), pa.array(range(len(counts)), pa.int32()), pa.array(draws.sum(axis=1)), pa.array(draws @ values), *middle], names=["_arm", "round", "drawn", "total", "low", "high"])

    return run


def rounds_of(values: DataFrame, by: list[str], value: str, rounds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``_arm, round, drawn, mean, median`` of every resample, and the arms (``_arm`` with the
    columns ``by``)."""
    arm = F.sha2(F.to_json(F.struct(*by)) if by else F.lit("all"), 256).alias("_arm")
    rows = values.select(*by, arm, F.col(value).cast("double").alias("v"))
    arms = stored(rows.select("_arm", *by).distinct())
    counted = rows.filter("v IS NOT NULL").groupBy("_arm", "v").agg(F.count("*").alias("n"))
    # a value's place among its arm's decides its block, so that the layout of rows doesn't
    placed = running_sums(counted.withColumn("_one", F.lit(1).cast("long")), "_arm", "v", ["_one"])
    block = placed.groupBy("_arm", F.floor((F.col("run__one") - 1) / LEAF).cast("long").alias("node"))
    leaves = block.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("_l"), F.sum("n").alias("w"))
    leaves = stored(leaves.select("_arm", "node", "w", F.transform("_l", lambda x: x["v"]).alias("values"), F.transform("_l", lambda x: x["n"]).alias("weights")))
    levels = [leaves.select("_arm", "node", "w")]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("_arm", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sum("w").alias("w"))
        levels.append(stored(up))
    sizes = stored(levels[-1].select("_arm", F.col("w").alias("n")))
    cur = sizes.select("_arm", F.lit(0).cast("long").alias("node"), F.array_repeat("n", rounds).alias("counts"))
    for k in range(len(levels) - 1, 0, -1):
        kids = levels[k - 1].groupBy("_arm", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "w"))).alias("_k"))
        kids = kids.select("_arm", "node", F.transform("_k", lambda x: x["node"]).alias("kids"), F.transform("_k", lambda x: x["w"]).alias("weights"))
        cur = stored(cur.join(kids, ["_arm", "node"]).select("_arm", "node", "counts", "kids", "weights").mapInArrow(_split(seed, k), "_arm string, node long, counts array<long>"))
    each = cur.select("_arm", "node", F.posexplode("counts").alias("round", "c"))
    before = F.sum("c").over(W.partitionBy("_arm", "round").orderBy("node").rowsBetween(W.unboundedPreceding, -1))
    below = each.withColumn("b", F.coalesce(before, F.lit(0))).groupBy("_arm", "node").agg(F.array_sort(F.collect_list(F.struct("round", "c", "b"))).alias("_r"))
    below = below.select("_arm", "node", F.transform("_r", lambda x: x["c"]).alias("counts"), F.transform("_r", lambda x: x["b"]).alias("below"))
    ready = below.join(leaves, ["_arm", "node"]).join(sizes, "_arm").select("_arm", "node", "n", "counts", "below", "values", "weights")
    found = ready.mapInArrow(_measured(seed), "_arm string, round int, drawn long, total double, low double, high double")
    out = found.groupBy("_arm", "round").agg(F.sum("drawn").alias("drawn"), (F.sum("total") / F.sum("drawn")).alias("mean"), ((F.max("low") + F.max("high")) / 2).alias("median"))
    return stored(out), arms


def intervals(values: DataFrame, by: list[str], value: str, rounds: int = 2000, seed: int = 17, share: float = 0.95) -> DataFrame:
    """``by, mean_low, mean_high, median_low, median_high``: the limits between which the
    middle ``share`` of the resamples lie. A group holds a row a round."""
    found, arms = rounds_of(values, by, value, rounds, seed)
    ends = (("low", (1 - share) / 2), ("high", (1 + share) / 2))
    limits = found.groupBy("_arm").agg(*[F.percentile(x, q).alias(f"{x}_{n}") for x in ("mean", "median") for n, q in ends])
    return joined(arms, stored(limits), ["_arm"], "left").drop("_arm")
