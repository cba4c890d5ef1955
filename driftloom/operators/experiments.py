"""Experiment arms: aggregates, paired tests, effect sizes, bootstrap, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.operators.graph import checkpointed, numbered
from driftloom.operators.resamples import intervals


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Wins, losses, ties, mean and median difference of two arms by task."""
    d = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key).withColumn("d", F.col("_a") - F.col("_b"))
    return d.agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"), F.avg("d").alias("mean"), F.median("d").alias("median"))


def sign_test(counts: DataFrame) -> DataFrame:
    """One and two tails of the binomial test, a row for each wins and losses. Log factorials are
    sums of logarithms over the range up to n, so large n don't overflow."""
    n, k = F.col("wins") + F.col("losses"), F.greatest("wins", "losses")
    x = counts.select("wins", "losses").distinct().withColumn("_n", n).withColumn("_k", k)
    i = x.select("*", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_i"))
    w = W.partitionBy("wins", "losses").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    lf = i.withColumn("_lf", F.sum(F.when(F.col("_i") > 0, F.ln("_i")).otherwise(0.0)).over(w))
    lf = lf.withColumn("_top", F.max("_lf").over(W.partitionBy("wins", "losses")))
    # ln (n - i)! is the value at the mirrored place
    m = lf.select("wins", "losses", (F.col("_n") - F.col("_i")).alias("_i"), F.col("_lf").alias("_mf"))
    j = lf.join(m, ["wins", "losses", "_i"]).filter(F.col("_i") >= F.col("_k"))
    p = F.sum(F.exp(F.col("_top") - F.col("_lf") - F.col("_mf") - F.col("_n") * F.ln(F.lit(2.0))))
    return j.groupBy("wins", "losses").agg(F.least(F.lit(1.0), p).alias("p_one_sided")).withColumn("p_two_sided", F.least(F.lit(1.0), 2 * F.col("p_one_sided")))


def with_sum_below(rows: DataFrame, by: str, amount: str) -> DataFrame:
    """``rows`` with ``_below``, the sum of ``amount`` over the rows before in order of
    ``by``, whose values are distinct. Rows are dealt by ranges; the driver sees one sum a range."""
    dealt = checkpointed(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum(amount).alias("s")).orderBy("_part").collect()
    starts, total = [F.lit(-1), F.lit(0)], 0
    for r in sums:
        starts += [F.lit(r["_part"]), F.lit(total)]
        total += r["s"]
    own = F.sum(amount).over(W.partitionBy("_part").orderBy(by).rowsBetween(W.unboundedPreceding, -1))
    below = F.element_at(F.create_map(*starts), F.col("_part")) + F.coalesce(own, F.lit(0))
    return dealt.withColumn("_below", below.cast("long")).drop("_part")


def cliffs_delta(rows: DataFrame, arm: str, value: str, first, second) -> DataFrame:
    """(pairs above - pairs below) / all pairs, from counts by distinct value and
    their running sums, without forming a pair."""
    c = rows.filter(F.col(arm).isin(first, second)).groupBy(value).agg(F.count_if(F.col(arm) == first).alias("x"), F.count_if(F.col(arm) == second).alias("y"))
    t = with_sum_below(c, value, "y")
    s = t.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"), F.sum(F.col("x") * F.col("_below")).alias("gt"), F.sum(F.col("x") * (F.col("_below") + F.col("y"))).alias("ge"))
    return s.select((F.col("gt") - (F.col("nx") * F.col("ny") - F.col("ge"))).alias("net"), (F.col("nx") * F.col("ny")).alias("pairs"), ((F.col("gt") - (F.col("nx") * F.col("ny") - F.col("ge"))) / (F.col("nx") * F.col("ny"))).alias("delta"))


def bootstrap_ci(values: DataFrame, value: str, rounds: int = 2000, seed: int = 17) -> DataFrame:
    """2.5 and 97.5 % quantiles, ``low`` and ``high``, of the mean of seeded resamples
    with replacement. Nulls are left out; without values the limits are null."""
    found = intervals(values, [], value, rounds, seed).select(F.col("mean_low").alias("low"), F.col("mean_high").alias("high"))
    return found.agg(F.max("low").alias("low"), F.max("high").alias("high"))  # a row even for no rows


def bootstrap(values: DataFrame, by: str, value: str, rounds: int = 2000, seed: int = 17) -> DataFrame:
    """2.5 and 97.5 % quantiles of mean and median over seeded resamples with
    replacement, by arm."""
    return intervals(values, [by], value, rounds, seed)


def signs(rows: DataFrame, arm: str, value: str, first, second) -> DataFrame:
    """Sign of Cliff's delta: 1, 0 or -1 as the first arm is above the second."""
    return cliffs_delta(rows, arm, value, first, second).select(F.signum("delta").cast("int").alias("sign"), "net", "pairs")


def ranked_arms(rows: DataFrame) -> DataFrame:
    """By passes, then alignment, then |cr - 1|, then time; placed over ranges."""
    placed = numbered(rows, [F.desc("passed"), F.desc("align"), F.abs(F.col("cr") - 1), F.col("time"), F.col("arm")], "place")
    return placed.withColumn("place", (F.col("place") + 1).cast("int"))
