"""What the training-data operators share: checkpoints, bounded buckets, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch that are worked on at a time.
PART_ROWS = 256
#: What a worker process keeps between its tasks; one operator's at a time.
KEPT: dict = {}


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """All columns as one struct ``_row``, so that names of further columns can't clash
    with those that an operator makes."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def unpacked(df: DataFrame, columns: list[str], new: dict[str, Column] | None = None) -> list[Column]:
    """The columns that :func:`packed` took; those named in ``new`` are replaced."""
    return [(new or {}).get(c, F.col("_row").getField(c)).alias(c) for c in columns]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the
    cluster names one. Only where it is unset on one machine (tests) a temporary folder; on
    a cluster that would be the driver's own disk, which is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again. Its size on disk is then
    known to the planner, which broadcasts it only below the session's threshold."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row in the order, from 1. Rows are sorted
    over ranges and checkpointed; the driver sees a count for each partition."""
    at = saved(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    starts, n = [], 0
    for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts += [F.lit(r["p"]), F.lit(n)]
        n += r["n"]
    before = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return at.withColumn(name, (place + before + 1).cast("long")).drop("_m")


def over_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` with a per-task set-up: ``make()`` runs once in each task and
    returns the function applied to every batch, in parts of ``PART_ROWS`` rows, so that
    a task holds the results of few texts at a time. Unless it ``keeps`` something itself,
    the task drops what others' tasks have left in the worker process."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            KEPT.clear()
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                yield work(batch.slice(at, PART_ROWS))
        batch = None
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """At a task's end: the worker process waits for the next task, and should not hold
    unused memory of Arrow or of the system's allocator meanwhile."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


# ---------------------------------------------------------------- bounded buckets


def bucket_pairs(rows: DataFrame, key: str, member: Column, limit: int) -> DataFrame:
    """Deals rows of a bucket into work units of at most about ``2 * limit`` rows.

    A bucket of up to ``limit`` rows is one unit. A larger one is cut into ``n``
    chunks by the hash of ``member``; every unordered pair of chunks is a unit, so any
    two rows of the bucket meet in some unit and none holds the whole bucket. Adds
    ``unit_i``, ``unit_j`` and ``side`` (the row's own chunk).
    """
    hot = rows.groupBy(key).count().filter(F.col("count") > limit)
    # at most rows / limit of them; stored, so that the planner knows their size
    hot = stored(hot.select(key, F.ceil(F.col("count") / limit).cast("int").alias("chunks")))
    n = F.coalesce("chunks", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("side", F.pmod(F.xxhash64(member, F.lit(7)), n).cast("int"))
    other = F.explode(F.sequence(F.lit(0), n - 1)).alias("other")
    dealt = dealt.select("*", other)
    return dealt.select(
        *rows.columns,
        "side",
        F.least("side", "other").alias("unit_i"),
        F.greatest("side", "other").alias("unit_j"),
    )


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Splits batches sorted by ``keys`` into one dict of columns per work unit; a unit
    that goes on in the next batch is carried over. Units of one row are left out."""
    held: list[pa.RecordBatch] = []

    def columns(parts: list[pa.RecordBatch]) -> dict[str, object]:
        table = pa.Table.from_batches(parts)
        return {n: table.column(n).combine_chunks() for n in table.column_names}

    def cut(table: pa.Table) -> np.ndarray:
        arrays = [table.column(k).to_numpy() for k in keys]
        change = reduce(np.logical_or, (a[1:] != a[:-1] for a in arrays))
        return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        edges = cut(table)
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            if b - a > 1:
                yield columns(table.slice(a, b - a).to_batches())
        held = table.slice(edges[-2]).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held) > 1:
        yield columns(held)


def union_roots(n: int, left: np.ndarray, right: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links left-right."""
    parent = np.arange(n) if parent is None else parent
    while len(left):
        a, b = parent[left], parent[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        left, right, low, high = left[open_], right[open_], low[open_], high[open_]
        np.minimum.at(parent, high, low)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
    return parent


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges``: pairs of comparable ids. Returns ``node, root`` for every node with an
    edge, ``root`` the smallest id reachable. Each round joins the edges twice with the
    smallest neighbour of each node and keeps them in a checkpoint; the number of rounds
    grows with the logarithm of the longest path. The neighbours are stored first: a few
    are broadcast then, and of many the join can deal a node with very many edges to
    several tasks. The driver sees two counts a round, never edges.
    """
    edges = saved(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct())
    before = None
    while True:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        low = stored(edges.groupBy("hi").agg(F.min("lo").alias("m")))
        large = edges.join(low.withColumnRenamed("hi", "_u"), F.col("lo") == F.col("_u"), "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        large = stored(large.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
        # small star: a node's smaller neighbours, and the node, move to the smallest of them
        low = stored(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = saved(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        before = now
