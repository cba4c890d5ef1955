"""Checks of artifacts and evidence, counters, stage telemetry, energies, objectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators import fields, graph

# Weights of the token types, and penalties, of a module's change energy.
ENERGY = {"ADD_FN": 0.08, "MODIFY_SIG": 0.22, "DEL_FN": 0.35, "ΔIMPORT": 0.05, "ΔCC": 0.15}
SECURITY, HOT_SPOT = 0.20, 0.10

# Fixed values of the window presets: depth, node kinds, edge kinds, most nodes, least share.
PRESETS = {
    "arch-overview": (2, ["project", "module", "topic"], ["import", "define", "call"], 900, 0.0),
    "hotspots": (2, ["module", "file", "topic"], ["import", "define", "call", "link", "use"], 800, 0.35),
    "bus": (2, ["topic", "module", "file"], ["define", "use", "link", "rpc"], 1200, 0.0),
    "module-focus": (2, ["module", "file", "func", "topic"], ["import", "define", "call"], 600, 0.0),
    "file-neighborhood": (2, ["file", "module", "func", "topic"], ["import", "define", "call"], 500, 0.0),
    "func-neighborhood": (2, ["func", "file", "module", "topic"], ["call", "define", "import"], 400, 0.0),
}


def _errors(checks: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), message) for message, ok in checks.items()]), lambda m: m.isNotNull())


def node_errors() -> Column:
    """What is wrong with a node row, an empty array if nothing."""
    return _errors({f"{c} must be a string": F.col(c).isNotNull() for c in ("id", "kind", "label")})


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def edge_errors() -> Column:
    """Both ends, and a finite weight where there is one."""
    weight = F.col("weight").isNull() | finite(F.col("weight"))
    return _errors({"src must be a string": F.col("src").isNotNull(), "dst must be a string": F.col("dst").isNotNull(), "weight must be a number": weight})


def evidence_valid(values: Column, alpha: Column, beta: Column, z: Column) -> Column:
    """Counts are whole and not negative, thresholds ordered in [0, 1]; anything
    unknown is invalid."""
    counts = F.forall(values, lambda v: v.isNotNull() & (v >= 0) & (v == F.floor(v)))
    return F.coalesce(counts & (alpha >= 0) & (alpha <= beta) & (beta <= z) & (z <= 1), F.lit(False))


def tag_counters(tags: DataFrame, by: str) -> DataFrame:
    """Items published and subscribed (a tag without a list is one), reply tags.
    ``tags``: by, key, items (array or null)."""
    k, n = F.lower("key"), F.coalesce(F.size("items"), F.lit(1))
    n = F.when(F.col("items").isNull(), 1).otherwise(n)
    return tags.groupBy(by).agg(*[F.sum(F.when(k == f"topic.{x}", n).otherwise(0)).alias(x) for x in ("publish", "subscribe")], F.count_if(k == "topic.request_reply").alias("request_reply"))


def energy(tokens: DataFrame, by: list[str], weights: dict = ENERGY, overrides: list[tuple[str, dict]] = (), security: Column | None = None, hot: Column | None = None) -> DataFrame:
    """Weighted token counts (``type, file``) and penalties of a key, scaled into
    [0, 1] within the first column of the key. The first override of a path counts."""
    pick = lambda own: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in own.items() for v in kv]), F.col("type")), F.lit(0.0))
    w = pick(weights)
    for pattern, own in reversed(overrides):
        w = F.when(F.col("file").rlike(pattern), pick(weights | own)).otherwise(w)
    flag = lambda c, p: F.max(F.when(c, p).otherwise(0.0)) if c is not None else F.lit(0.0)
    raw = tokens.groupBy(*by).agg((F.sum(w) + flag(security, SECURITY) + flag(hot, HOT_SPOT)).alias("raw"))
    return fields.minmax(raw, "raw", by[:1]).withColumnRenamed("norm", "energy")


def objective(j: Column, align: Column, ast: Column, to: Column) -> Column:
    """Lower is better."""
    return j + (1 - align) - 0.5 * F.ln(F.greatest(F.lit(1e-6), ast)) - 0.25 * F.ln(1 + F.greatest(F.lit(0.0), to))


def best_run(runs: DataFrame, by: str, key: str) -> DataFrame:
    """The run with the lowest (score, -align, j, key) of each group."""
    best = F.min(F.struct(F.col("score"), (-F.col("align")).alias("a"), F.col("j"), F.col(key))).alias("b")
    return runs.groupBy(by).agg(best).select(by, F.col(f"b.{key}").alias(key), F.col("b.score").alias("score"))


def stage_deltas(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Out less in for metrics that a stage has on both sides (``side, key, value``)."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    return metrics.groupBy(*by, "key").agg(side("in").alias("_i"), side("out").alias("_o")).select(*by, "key", (F.col("_o") - F.col("_i")).alias("delta")).filter("delta IS NOT NULL")


def stage_summary(stages: DataFrame, metrics: DataFrame, run: str, stage: str) -> DataFrame:
    """Steps of a run, how many have no metrics, and all keys that came out."""
    seen = metrics.groupBy(run, stage).agg(F.collect_set(F.when(F.col("side") == "out", F.col("key"))).alias("_k"))
    x = stages.select(run, stage).distinct().join(seen, [run, stage], "left")
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("_k", F.array().cast("array<string>"))))))
    return x.groupBy(run).agg(F.count("*").alias("steps"), F.count_if(F.col("_k").isNull()).alias("missing"), F.array_join(keys, ",").alias("keys"))


def subtree(tree: DataFrame, key: str, parent: str, weight: str) -> DataFrame:
    """Weight of each node with all below it, and its number of children. Round k
    adds what is 2 ** k to 2 ** (k + 1) - 1 levels below and doubles the pointers, so the
    rounds are the logarithm of the height. A cycle of parents is an error."""
    up = graph.checkpointed(tree.select(key, parent))
    cur = graph.checkpointed(tree.groupBy(F.col(key).alias("_at")).agg(F.min(parent).alias("_up"), F.sum(weight).alias("_w")))
    for _ in range(cur.count().bit_length() + 1):
        if not cur.filter("_up IS NOT NULL").limit(1).count():
            break
        moved = cur.filter("_up IS NOT NULL").groupBy(F.col("_up").alias("_at")).agg(F.sum("_w").alias("_w"))
        sums = cur.select("_at", "_w").unionByName(moved).groupBy("_at").agg(F.sum("_w").alias("_w"))
        above = cur.select(F.col("_at").alias("_up"), F.col("_up").alias("_next"))
        ups = cur.select("_at", "_up").join(above, "_up", "left").select("_at", F.col("_next").alias("_up"))
        cur = graph.checkpointed(ups.join(sums, "_at"))
    else:
        raise ValueError("parents form a cycle")
    parts = cur
    total = parts.groupBy(F.col("_at").alias(key)).agg(F.sum("_w").alias("total"))
    below = up.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.count("*").alias("children"))
    return tree.select(key).join(total, key).join(below, key, "left").fillna(0, ["children"])


def preset_window(name: str, nodes: DataFrame, edges: DataFrame, anchors: DataFrame, field: DataFrame | None = None) -> DataFrame:
    """A named window; ``hotspots`` filters by the field given, its 200 best nodes."""
    depth, kinds, edge_kinds, most, least = PRESETS[name]
    if field is not None and name == "hotspots":
        field = field.orderBy(F.desc("value"), "id").limit(200)
    return graph.window(nodes, edges, anchors, depth, kinds, edge_kinds, most, field, least)
