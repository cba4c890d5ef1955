import random

import pytest

from driftloom import named
from driftloom.functions import exprs as X
from driftloom.operators import experiments, graph, reports, series
from driftloom.registry import fields, operators


def slow_propagation(ids, weights, rounds):
    label, before = {i: i for i in ids}, {i: i for i in ids}
    for _ in range(rounds):
        new = {}
        for i in ids:
            votes = {}
            for j, w in weights.get(i, []):
                votes[label[j]] = votes.get(label[j], 0) + w
            best = min(votes, key=lambda x: (-votes[x], x)) if votes else label[i]
            new[i] = min(best, label[i]) if best == before[i] != label[i] else best
        before, label = label, new
        if label == before:
            break
    return label


def test_grid_votes_and_communities(spark):
    rng = random.Random(5)
    cells = [(g, x, y, g * 100 + y * 6 + x, rng.choice((0.0, 1.0, 3.0))) for g in range(3) for x in range(6) for y in range(5)]
    df = spark.createDataFrame(cells, "grid long, x int, y int, id long, edge double")
    edges = graph.grid_edges(df)
    at = {(g, x, y): (i, e) for g, x, y, i, e in cells}
    weights = {}
    for (g, x, y), (i, e) in at.items():
        for place in ((g, x + 1, y), (g, x - 1, y), (g, x, y + 1), (g, x, y - 1)):
            if place in at:
                weights.setdefault(i, []).append((at[place][0], 1 + 0.5 * (e + at[place][1])))
    assert edges.count() == sum(map(len, weights.values())) / 2
    got = {r["id"]: r["community"] for r in graph.label_propagation(df.select("id"), edges, rounds=10, weight="weight").collect()}
    assert got == slow_propagation(sorted(weights), weights, 10)


def test_operators_and_fields_by_name(spark):
    nodes = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f")], "id string, kind string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0)], "src string, dst string, weight double")
    assert operators.get("GRAPH.Degrees").name == "graph.degrees" and "bfs" in operators._aliases and operators.get("ewma").defaults["lam"] == 0.15
    assert {r["id"]: r["degree"] for r in operators.apply("degrees", nodes, edges).collect()} == {"a": 2, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        operators.register("Degrees", graph.degrees)
    assert {"degree", "pagerank"} <= set(fields.names())
    got = {r["node"]: r["value"] for r in named.blended(nodes, edges, {"degree": 1.0, "in_strength": 1.0}).collect()}
    assert got == {"a": 0.5, "b": pytest.approx(1 / 6), "c": 0.5}
    own = named.blended(nodes, edges, {"x": 1.0}, resolve=lambda name: lambda n, e: n.selectExpr("id as node", "cast(ascii(id) as double) as value"))
    assert {r["node"]: r["value"] for r in own.collect()} == {"a": 0.0, "b": 0.5, "c": 1.0}


def test_ewma_reaches_as_far_as_its_weight(spark):
    rng = random.Random(2)
    values = [rng.random() for _ in range(1500)]
    df = spark.createDataFrame([("k", k, v) for k, v in enumerate(values)], "k string, at long, v double")
    for lam in (0.02, 0.15, 0.9, 1.0):
        mean = values[0]
        for v in values[1:]:
            mean = lam * v + (1 - lam) * mean
        assert series.ewma(df, "k", "at", "v", lam).filter("at = 1499").first()["ewma"] == pytest.approx(mean, abs=1e-7)


def test_bootstrap_holds_the_mean(spark):
    rng = random.Random(3)
    rows = [(k % 2, k, rng.gauss(5 + k % 2, 1)) for k in range(400)]
    got = {r["arm"]: r for r in experiments.bootstrap(spark.createDataFrame(rows, "arm long, key long, v double"), "arm", "v", 500).collect()}
    for arm in (0, 1):
        xs = sorted(v for a, _, v in rows if a == arm)
        assert got[arm]["mean_low"] < sum(xs) / len(xs) < got[arm]["mean_high"] and got[arm]["mean_high"] - got[arm]["mean_low"] < 0.5
        assert got[arm]["median_low"] < (xs[99] + xs[100]) / 2 < got[arm]["median_high"]


def test_budgets_tags_and_repairs(spark):
    v = lambda rows: spark.createDataFrame(rows, "k string, metric string, value double")
    rules = spark.createDataFrame([("c", "shrink", -0.05), ("q", "drop", 0.1), ("s", "least", 0.9), ("p", "grow", 0.05)], "metric string, rule string, limit double")
    got = reports.budgets(v([("x", "c", 100.0), ("x", "q", 0.8), ("x", "s", 1.0), ("x", "p", 10.0)]), v([("x", "c", 95.0), ("x", "q", 0.6), ("x", "s", 0.95), ("x", "p", 10.6)]), rules, "k")
    assert {r["metric"]: r["kept"] for r in got.collect()} == {"c": True, "q": False, "s": True, "p": False}
    line = spark.createDataFrame([("x = 1  # tag:topic.publish = a, b # tag:mode=on",), ("nothing",), (None,)], "v string")
    tags = [r["t"] for r in line.select(X.line_tags("v").alias("t")).collect()]
    assert [(t["key"], t["value"], t["col"]) for t in tags[0]] == [("topic.publish", "a, b", 8), ("mode", "on", 35)] and tags[1] == []
    e = spark.createDataFrame([("u", "err", 1), ("u", "fix", 4), ("u", "err", 6), ("w", "fix", 1)], "k string, kind string, at long").selectExpr("k", "kind", "timestamp_seconds(at * 3600) as at")
    found = reports.repairs(e, "k", "kind", "at", "err", "fix")
    row = reports.repair_times(found, ["k"]).first()
    assert (row["n"], row["hours"], row["adopted"]) == (2, 3.0, 0.5)


def test_the_entry_needs_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, check=False).returncode == 0
