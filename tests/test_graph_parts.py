import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from driftloom.operators import graph
from driftloom.plans import catalog
from driftloom.plans.roles import trade

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    n, e = trade(spark, SF)
    ids = sorted(r["id"] for r in n.collect())
    out = {}
    for r in e.collect():
        out.setdefault(r["src"], []).append(r["dst"])
    return ids, out


def brandes(ids, out, sources):
    """Distances by source, and the dependencies summed over sources."""
    far, total = {}, dict.fromkeys(ids, 0.0)
    for s in sources:
        dist, sigma, before, order, todo = {s: 0}, {s: 1.0}, {}, [], deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in out.get(v, []):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] = sigma.get(w, 0.0) + sigma[v]
                    before.setdefault(w, []).append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, []):
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
        far |= {(s, v): k for v, k in dist.items()}
    return far, total


def test_parts_search_against_brute_force(spark, parts):
    ids, out = parts
    sources = ids[:: max(1, len(ids) // 32)][:32]
    far, total = brandes(ids, out, sources)
    run = catalog.queries()
    assert {(r["source"], r["id"]): r["dist"] for r in run["g02_bfs_parts"](spark, SF).collect()} == far
    assert max(far.values()) > 2
    harmonic = {r["id"]: r["harmonic"] for r in run["g03_harmonic_parts"](spark, SF).collect()}
    want = dict.fromkeys(ids, 0.0)
    for (s, v), k in far.items():
        want[v] += 1 / k / len(sources) if k else 0
    assert harmonic == pytest.approx(want, abs=2e-6)
    got = {r["id"]: r["betweenness"] for r in run["g04_betweenness"](spark, SF).collect()}
    assert got == pytest.approx({k: v / max(total.values()) for k, v in total.items()}, abs=2e-6)


def test_every_node_is_in_the_results(spark, parts):
    run = catalog.queries()
    for name in ("g01_pagerank_parts", "g05_label_propagation", "g06_grid_label_propagation", "g09_components_parts", "g10_clustering_parts"):
        assert sorted(r["id"] for r in run[name](spark, SF).select("id").collect()) == parts[0], name


def test_sampled_sources(spark):
    for n, parts in ((0, 3), (5, 3), (32, 4), (1000, 7), (70, 1)):
        ids = [f"n{k}" for k in range(n)]
        random.Random(n).shuffle(ids)
        df = spark.createDataFrame([(x,) for x in ids], "id string").repartition(parts)
        want = sorted(ids)[:: max(1, n // max(1, min(32, n)))][:32]
        assert sorted(r["source"] for r in graph.sampled(df).collect()) == want


def test_sign_test_of_parts(spark):
    for r in catalog.queries()["a35_sign_test_parts"](spark, SF).limit(40).collect():
        n = r["wins"] + r["losses"]
        p = sum(math.comb(n, k) for k in range(max(r["wins"], r["losses"]), n + 1)) / 2**n
        assert r["p_one_sided"] == pytest.approx(min(1, p), abs=2e-6)
