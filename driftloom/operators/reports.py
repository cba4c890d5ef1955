"""Reports over runs, events and files: views, ratios, hot paths, budgets, snapshots, trends."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.functions.exprs import safe_div


def last_runs(runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last run of each key, whole rows; a partial aggregate, no sort."""
    rest = [c for c in runs.columns if c != key]
    last = runs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def daily_violations(events: DataFrame, gate: str, at: str, violated: Column) -> DataFrame:
    """Events, violations and their share by gate and day."""
    n = F.count_if(violated)
    return events.groupBy(gate, F.date_trunc("day", at).alias("day")).agg(F.count("*").alias("n"), n.alias("violations"), safe_div(n, F.count("*")).alias("rate"))


def success_rates(runs: DataFrame, kind: str, success: Column) -> DataFrame:
    """Runs and the share of successes by kind."""
    return runs.groupBy(kind).agg(F.count("*").alias("n"), F.avg(F.coalesce(success, F.lit(False)).cast("int")).alias("rate"))


def top_energy(rows: DataFrame, file: str, at: str, energy: str, days: int = 7, n: int = 20) -> DataFrame:
    """The files with the largest sum of energy in the last days of the table."""
    now = rows.agg(F.max(at).alias("_now"))
    recent = rows.crossJoin(F.broadcast(now)).filter(F.col(at) > F.col("_now") - F.expr(f"interval {int(days)} days"))
    return recent.groupBy(file).agg(F.round(F.sum(energy), 4).alias("energy")).orderBy(F.desc("energy"), file).limit(n)


def ratios(rows: DataFrame, by: list[str], parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Shares by name: rows where the first condition holds, of those where the second
    does; 0 where there are none."""
    return rows.groupBy(*by).agg(*[safe_div(F.count_if(a & b), F.count_if(b)).alias(name) for name, (a, b) in parts.items()])


def repairs(events: DataFrame, key: str, kind: str, at: str, opened: str, closed: str) -> DataFrame:
    """Each opening with the next closing of its key: ``key, opened, closed`` (null if
    it was never closed)."""
    after = W.partitionBy(key).orderBy(at, kind).rowsBetween(1, W.unboundedFollowing)
    nxt = F.min(F.when(F.col(kind) == closed, F.col(at))).over(after)
    return events.select(key, kind, F.col(at).alias("opened"), nxt.alias("closed")).filter(F.col(kind) == opened).drop(kind)


def repair_times(found: DataFrame, by: list[Column]) -> DataFrame:
    """Median hours to repair and the share of openings that were closed."""
    hours = (F.unix_micros("closed") - F.unix_micros("opened")) / 3.6e9
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.median(hours).alias("hours"), safe_div(F.count("closed"), F.count("*")).alias("adopted"))


def hot_levels(rows: DataFrame, levels: dict[str, Column], n: int = 20) -> DataFrame:
    """Changes of structure and health by path, module and tile: sums, their shares
    alpha and beta, the depth's share delta; kept are the ``n`` of each level that lose
    most health beyond the structure gained."""
    out = None
    for level, name in levels.items():
        sums = rows.groupBy(name.alias("name")).agg(*[F.round(F.sum(x), 4).alias(x) for x in ("dS", "dH", "dZ")])
        total = F.greatest(F.lit(1.0), F.abs("dS") + F.abs("dH"))
        sums = sums.select(F.lit(level).alias("level"), "*", (F.col("dS") / total).alias("alpha"), (F.col("dH") / total).alias("beta"), (F.col("dZ") / total).alias("delta"))
        hot = sums.filter("dH > dS").orderBy(F.desc(F.round(F.col("dH") - F.col("dS"), 4)), "name").limit(n)
        out = hot if out is None else out.unionByName(hot)
    return out


def budgets(before: DataFrame, after: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Values of two states (key, metric, value) against rules (metric, rule, limit):
    ``grow`` (after at most before times 1 + limit), ``shrink`` (the same with a fall in
    mind: the limit is negative), ``drop`` (before less after at most the limit) and
    ``least`` (after at least the limit). The rules are a small table."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), [key, "metric"]).join(F.broadcast(rules), "metric")
    kept = F.when(F.col("rule").isin("grow", "shrink"), F.col("after") <= F.col("before") * (1 + F.col("limit"))).when(F.col("rule") == "drop", F.col("before") - F.col("after") <= F.col("limit")).otherwise(F.col("after") >= F.col("limit"))
    return both.select(key, "metric", "rule", "before", "after", kept.alias("kept"))


def snapshot_headers(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, anchors: DataFrame, by: str) -> DataFrame:
    """Headers of artifact snapshots as JSON: numbers of nodes and edges, sorted names
    of metrics (by, metric) and anchors (by, anchor)."""
    parts = (nodes.groupBy(by).agg(F.count("*").alias("nodes")), edges.groupBy(by).agg(F.count("*").alias("edges")), metrics.groupBy(by).agg(F.sort_array(F.collect_set("metric")).alias("metrics")), anchors.groupBy(by).agg(F.sort_array(F.collect_set("anchor")).alias("anchors")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by, "left")
    none = F.array().cast("array<string>")
    header = F.struct("nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("metrics", none).alias("metrics"), F.coalesce("anchors", none).alias("anchors"))
    return out.select(by, F.to_json(header).alias("header"))


def append_snapshots(headers: DataFrame, store: str, run: str | None = None) -> DataFrame:
    """Appends headers to a store and returns the rows of this run as stored."""
    run = run or uuid.uuid4().hex
    headers.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(store)
    return headers.sparkSession.read.parquet(store).filter(F.col("run") == run).drop("run")


def trend(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Change from the row before, and the slope of the straight line through all rows
    of a key."""
    w = W.partitionBy(by)
    place = F.row_number().over(w.orderBy(order))
    x = rows.withColumn("_i", place).withColumn("change", F.col(value) - F.lag(value).over(w.orderBy(order)))
    slopes = x.groupBy(by).agg(F.regr_slope(value, "_i").alias("slope"))
    return x.drop("_i").join(slopes, by)
