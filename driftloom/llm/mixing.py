"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words. Which documents make it up is a subset-sum
problem over the counts of documents by exact length, each there twice. An even share of
each length is taken first, the largest lengths fill up until the rest is small, and a
bounded-knapsack dynamic programme fits that rest. Where it can't be fitted exactly, more
of the budget is left to the programme, up to all of it. How many documents of each length are needed is then turned into
seeded choices of documents. All counts are grouped sums over all documents.

Results for special cases: a null text has size 0; a document of size 0 is taken with 0
words; null sources come last and are one source; repeated rows are rows of their own;
among rows alike in source, size and doc_id it doesn't matter which is taken; an empty
table gives an empty result; further columns are kept by :func:`mix`.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from driftloom.llm.common import packed, saved, unpacked

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 20_240_117
#: Rest of the budget, in words, that is left to the dynamic programme at first.
FIT_WORDS = 1 << 15
#: Parts that the documents of one source and length are dealt to, by a seeded hash.
PARTS = 1024


def sized(docs: DataFrame) -> DataFrame:
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.withColumn("size", n)


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row a source.

    Sources are ranked by a range-partitioned sort: each partition's number of sources
    goes to the driver, and a window numbers the sources within a partition.
    """
    sizes = sizes.withColumn("last", F.col("source").isNull())
    dealt = saved(sizes.repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()))
    dealt = dealt.withColumn("row", F.row_number().over(W.partitionBy("part").orderBy("last", "source")))
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())
    offsets, before = {}, 0
    for part, n in counts:
        offsets[part], before = before, before + n
    if not offsets:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    offset = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    rank = F.col("row") - 1 + F.element_at(offset, F.col("part"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    ranked = dealt.select("source", "source_size", weight.alias("weight"))
    budget = SHARE * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    # the level at which the sources that aren't full share what the full ones leave;
    # each round fills at least one more source, or ends
    full = F.lit(False)
    level, known = 0.0, -1
    while True:
        row = ranked.agg(
            F.sum(F.when(full, F.col("source_size"))).alias("closed"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not row["open"] or row["n"] == known:
            break
        known = row["n"]
        level = (budget - MOST * (row["closed"] or 0)) / row["open"]
        full = F.col("weight") * F.lit(level) > MOST * F.col("source_size")
    target = F.when(full, (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def fit(counts: dict[int, int], budget: int, fit_words: int = FIT_WORDS) -> dict[int, int]:
    """How many documents of each length sum up to the budget, or the most below it.

    A sum that is the budget can't be bettered. If the words left to the dynamic programme
    don't allow it, it gets four times as many, and so on up to the whole budget, for
    which its answer is exact.
    """
    unit = math.gcd(*counts) or 1  # every sum is a multiple of it
    best = {n // unit: k for n, k in counts.items() if n > 0}
    goal, words = budget // unit, max(1, fit_words)
    while True:
        taken = fit_within(best, goal, words)
        reached = sum(n * k for n, k in taken.items())
        if reached == goal or words >= goal or reached == sum(n * k for n, k in best.items()):
            return {n * unit: k for n, k in taken.items()}
        words *= 4


def fit_within(counts: dict[int, int], budget: int, fit_words: int) -> dict[int, int]:
    """The most words up to the budget that can be had if only the last ``fit_words`` and
    the documents left for them are open."""
    lengths = sorted((n for n in counts if n > 0), reverse=True)
    total = sum(n * counts[n] for n in lengths)
    if budget >= total:
        return {n: counts[n] for n in lengths}
    share = max(0, budget - fit_words) / total if total else 0.0
    taken = {n: int(counts[n] * share) for n in lengths}
    rest = budget - sum(n * k for n, k in taken.items())
    for n in lengths:
        if rest <= fit_words:
            break
        more = min(counts[n] - taken[n], (rest - fit_words + n - 1) // n, rest // n)
        taken[n], rest = taken[n] + more, rest - more * n
    # bounded knapsack over the rest; bit s of `sums` says whether s words can be had.
    # Short lengths come first, and it ends as soon as the rest itself can be had.
    mask, sums, steps = (1 << (rest + 1)) - 1, 1, []
    for n in reversed(lengths):
        left, size = min(counts[n] - taken[n], rest // n), 1
        while left > 0 and not sums >> rest & 1:
            k = min(size, left)
            steps.append((n, k, sums))
            sums |= (sums << (n * k)) & mask
            left, size = left - k, size * 2
        if sums >> rest & 1 or n > rest:
            break
    at = sums.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n], at = taken[n] + k, at - n * k
    return taken


_FIT = T.StructType([T.StructField("source", T.StringType()), T.StructField("size", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("passes", T.LongType()), T.StructField("more", T.LongType())])


def quotas(lengths: DataFrame) -> DataFrame:
    """``source, size, source_size, target, passes, more`` from ``source, size, n``:
    documents of that length are all taken ``passes`` times, and ``more`` once more."""
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes)
    joined = lengths.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def one_source(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # every document can be had twice, so a length of n documents has 2 n copies
        counts = dict(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True))
        copies = fit({n: MOST * k for n, k in counts.items()}, round(rows["target"].iloc[0]))
        split = [divmod(copies.get(n, 0), k) for n, k in counts.items()]
        rows = rows.assign(passes=[a for a, _ in split], more=[b for _, b in split])
        return rows[["source", "size", "source_size", "target", "passes", "more"]]

    # a group is one source's distinct lengths, whatever its number of documents
    return joined.groupBy("source").applyInPandas(one_source, _FIT)


def mix(docs: DataFrame) -> DataFrame:
    """``_row`` (as it came), ``source_size, target, copies`` from ``doc_id, source, size``
    and any column ``_row``.

    The chosen documents of a source and length are those that come first by a seeded
    hash. Its leading digits deal them to parts; all parts before the last one needed
    are taken whole, and only within that part are documents ranked.
    """
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null as a value to join on
    hashed = docs.withColumn("_h", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("_src", source)
    hashed = hashed.withColumn("_part", F.pmod(F.col("_h"), F.lit(PARTS)).cast("int"))
    parts = saved(hashed.groupBy("source", "_src", "size", "_part").agg(F.count("*").alias("_n")))
    plan = quotas(parts.groupBy("source", "size").agg(F.sum("_n").alias("n"))).withColumn("_src", source).drop("source")
    parts = parts.drop("source")
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_src", "size").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).join(plan, ["_src", "size"])
    quota = F.greatest(F.lit(0), F.least("_n", F.col("more") - F.col("_before")))
    parts = parts.select("_src", "size", "_part", "source_size", "target", "passes", quota.alias("_quota"))
    joined = hashed.join(parts, ["_src", "size", "_part"])
    rank = F.row_number().over(W.partitionBy("_src", "size", "_part").orderBy("_h", "doc_id"))
    copies = F.col("passes") + F.when(rank <= F.col("_quota"), 1).otherwise(0)
    return joined.select("_row", "source_size", "target", copies.alias("copies"))


def taken(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` for each document."""
    rows = sized(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size")
    rows = mix(rows.select(packed(rows), "doc_id", "source", "size"))
    size = F.col("_row.size")
    return rows.select("_row.doc_id", size.alias("size"), "source_size", "target", (F.col("copies") * size).alias("taken"), "_row.source")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    rows = sized(docs.select(packed(docs), "doc_id", "text", "source")).drop("text")
    out = mix(rows).filter("copies > 0")
    out = out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select(*unpacked(out, docs.columns))
