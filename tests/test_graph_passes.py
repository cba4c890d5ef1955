"""Searches read their edges once, however many steps they take, and PageRank takes few
rounds on graphs of two sides."""

import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators import graph


def counted_edges(spark, rows):
    """Edges that count how often a row of them is made."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(rows, "src long, dst long")
    return df.withColumn("dst", F.udf(same, "long").asNondeterministic()("dst")), seen


@pytest.mark.parametrize("run", ["bfs", "harmonic_in", "betweenness"])
def test_edges_are_made_once(spark, run):
    edges, seen = counted_edges(spark, [(k, k + 1) for k in range(8)])
    sources, nodes = spark.createDataFrame([(0, 0), (3, 3)], "source long, id long"), spark.range(9)
    more = () if run == "bfs" else (nodes,)
    assert getattr(graph, run)(sources, edges, *more).count() == {"bfs": 15}.get(run, 9)
    assert seen.value <= 16


def test_more_sources_than_bits_of_a_word(spark):
    rows = [(k, (k * 7 + 1) % 150) for k in range(150)] + [(k, (k + 40) % 150) for k in range(0, 150, 3)]
    out = {}
    for a, b in rows:
        out.setdefault(a, []).append(b)
    want = {}
    for s in range(140):
        far, front = {s: 0}, [s]
        while front:
            nxt = []
            for v in front:
                for w in out[v]:
                    if w not in far:
                        far[w] = far[v] + 1
                        nxt.append(w)
            front = nxt
        want |= {(s, v): k for v, k in far.items()}
    sources = spark.range(140).selectExpr("id as source", "id")
    got = graph.bfs(sources, spark.createDataFrame(rows, "src long, dst long")).collect()
    assert {(r["source"], r["id"]): r["dist"] for r in got} == want and len(got) == len(want)


def test_ranks_of_two_sides_take_few_rounds(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(30), 100 + rng.randrange(200)) for _ in range(2500)}
    rows = [(a, b, rng.uniform(1, 9)) for a, b in pairs] + [(b, a, rng.uniform(1, 9)) for a, b in pairs if rng.random() < 0.4]
    ids = list(range(300))
    total, rank = {}, dict.fromkeys(ids, 1 / 300)
    for a, _, w in rows:
        total[a] = total.get(a, 0) + w
    for _ in range(200):
        lost = sum(v for k, v in rank.items() if k not in total)
        nxt = dict.fromkeys(ids, 0.15 / 300 + 0.85 * lost / 300)
        for a, b, w in rows:
            nxt[b] += 0.85 * w / total[a] * rank[a]
        rank = nxt
    got = graph.pagerank(spark.createDataFrame([(k,) for k in ids], "id long"), spark.createDataFrame(rows, "src long, dst long, weight double"), rounds=25)
    assert {r["id"]: r["rank"] for r in got.collect()} == pytest.approx(rank, abs=1e-8)


@pytest.mark.parametrize("dense", [False, True])
def test_clustering_of_either_form(spark, dense):
    """Many more fans than paths, and the other way about; against all triples."""
    rng = random.Random(8)
    pairs = {(a, b) for a in range(12) for b in range(a) if rng.random() < 0.6} if dense else {(a, 20 + b) for a in range(9) for b in range(6)} | {(0, 1), (20, 21)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {k: (sum(b in near[a] for a in v for b in v) / (len(v) * (len(v) - 1)) if len(v) > 1 else 0.0) for k, v in near.items()} | {99: 0.0}
    out = graph.clustering(spark.createDataFrame([(k,) for k in want], "id long"), spark.createDataFrame(list(pairs), "src long, dst long"))
    assert {r["id"]: r["clustering"] for r in out.collect()} == pytest.approx(want)
