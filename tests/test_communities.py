"""Label propagation (G5) against the loop over nodes, and bridges (J25) end to end."""

import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators import communities, graph
from tests.test_graph_parts import brandes


def in_turn(nodes, edges, rounds=20, key=lambda n: n):
    near = {n: [] for n in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    label = {n: n for n in nodes}
    for _ in range(rounds):
        before = dict(label)
        for n in sorted(nodes, key=key):
            votes = {}
            for m in near[n]:
                votes[label[m]] = votes.get(label[m], 0) + 1
            if votes:
                label[n] = min(votes, key=lambda x: (-votes[x], x))
        if label == before:
            break
    number = {x: k for k, x in enumerate(sorted(set(label.values())))}
    return {n: number[x] for n, x in label.items()}


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")


def found(spark, nodes, edges, **more):
    return {r["id"]: r["community"] for r in communities.label_communities(*frames(spark, nodes, edges), **more).collect()}


def graphs():
    """Random graphs, a two-sided one, two cliques and nodes alone, side by side."""
    rng, edges = random.Random(3), []
    for k in range(8):
        n = rng.randrange(5, 20)
        edges += [(40 * k + rng.randrange(n), 40 * k + rng.randrange(n)) for _ in range(int(n * rng.uniform(0.8, 2.5)))]
    edges += [(400 + rng.randrange(8), 420 + rng.randrange(12)) for _ in range(30)]
    for base in (500, 505):
        edges += [(base + a, base + b) for a in range(5) for b in range(a)]
    return list(range(520)), [*edges, (504, 509)]


def test_communities_are_those_of_the_loop(spark):
    nodes, edges = graphs()
    got = found(spark, nodes, edges)
    assert got == in_turn(nodes, edges)
    assert sorted(set(got.values())) == list(range(len(set(got.values()))))
    assert len({got[n] for n in range(500, 505)}) == 1 and got[500] != got[505] and got[519] not in {got[n] for n in range(519)}


def test_another_order_and_few_rounds(spark):
    nodes, edges = graphs()
    rank = {r["id"]: r["h"] for r in frames(spark, nodes, edges)[0].select("id", F.xxhash64("id").alias("h")).collect()}
    got = found(spark, nodes, edges, order=F.xxhash64("id"), rounds=1)
    assert got == in_turn(nodes, edges, 1, lambda n: (rank[n], n))
    assert found(spark, [], []) == {}


def test_bridges_of_real_communities(spark):
    rng = random.Random(6)
    nodes = list(range(24))
    edges = [(8 * g + rng.randrange(8), 8 * g + rng.randrange(8)) for g in range(3) for _ in range(22)] + [(2, 9), (9, 17), (17, 2), (5, 12)]
    n, e = frames(spark, nodes, edges)
    beta = {k: (k * 7 % 10) / 10 for k in nodes if k % 5}
    both = edges + [(b, a) for a, b in edges]
    sources = spark.createDataFrame([(k, k) for k in nodes], "source long, id long")
    g4 = graph.betweenness(sources, spark.createDataFrame(both, "src long, dst long"), n)
    got = {r["id"]: r["betweenness"] for r in communities.bridges(communities.label_communities(n, e), e, g4, spark.createDataFrame(list(beta.items()), "id long, beta double"), 0.6, 0.3).collect()}
    community, out = in_turn(nodes, edges), {}
    for a, b in both:
        out.setdefault(a, []).append(b)
    _, total = brandes(nodes, out, nodes)
    value = {k: v / max(total.values()) for k, v in total.items()}
    cand = [k for k in nodes if len({community[m] for m in out.get(k, [])}) >= 2]
    cut = sorted(value[k] for k in cand)[round(0.6 * (len(cand) - 1))]
    want = {k: value[k] for k in cand if value[k] >= cut - 1e-12 and beta.get(k, 0) >= 0.3}
    assert want and got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
