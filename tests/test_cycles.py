"""Cycles (G14) against Tarjan's algorithm."""

import random

from driftloom.operators import cycles
from driftloom.plans import catalog

SF = "/root/testdata/sf0.001"


def tarjan(edges):
    """Node -> smallest node of its component, of nodes on cycles."""
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, stack, on, found = {}, {}, [], set(), {}
    for root in out:
        if root in index:
            continue
        todo = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while todo:
            v, rest = todo[-1]
            w = next(rest, None)
            if w is not None:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    todo.append((w, iter(out[w])))
                elif w in on:
                    low[v] = min(low[v], index[w])
                continue
            todo.pop()
            if todo:
                low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
            if low[v] == index[v]:
                group = []
                while not group or group[-1] != v:
                    group.append(stack.pop())
                    on.discard(group[-1])
                if len(group) > 1 or v in out[v]:
                    found |= dict.fromkeys(group, min(group))
    return found


def found(spark, edges, kind="long"):
    df = spark.createDataFrame(edges, f"src {kind}, dst {kind}")
    rows = cycles.components(df).collect()
    got = {r["id"]: r["component"] for r in rows}
    assert len(got) == len(rows)
    return got


def test_cycles_against_tarjan(spark):
    """Random graphs of many sizes and densities, side by side."""
    rng, edges = random.Random(7), []
    for k in range(120):
        n = rng.randrange(2, 40)
        edges += [(100 * k + rng.randrange(n), 100 * k + rng.randrange(n)) for _ in range(int(n * rng.uniform(0.6, 1.8)))]
    want = tarjan(edges)
    assert found(spark, edges) == want and len(set(want.values())) > 100


def test_what_lies_between_cycles_is_on_none(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x"), ("x", "a"), ("e", "y"), (None, "a"), ("a", None)]
    assert found(spark, edges, "string") == {"a": "a", "b": "a", "d": "d", "e": "d", "x": "x"}
    assert found(spark, []) == {}


def test_chains_rings_and_chains_on_chains(spark):
    ring = [(k, k + 1) for k in range(100, 140)] + [(140, 100)]
    tail = [(k, k + 1) for k in range(200, 260)] + [(120, 200)]
    # an ear: a chain from one node of a ring to another, and one that leads back to itself
    ear = [(105, 300), (300, 301), (301, 302), (302, 131)] + [(110, 400), (400, 401), (401, 110)]
    edges = ring + tail + ear + [(260, 500), (500, 501), (501, 500)]
    assert found(spark, edges) == tarjan(edges)


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    calls = []
    plain = cycles.stored
    monkeypatch.setattr(cycles, "stored", lambda df: calls.append(1) or plain(df))
    rounds = []
    for n in (50, 800):
        calls.clear()
        ring = [(k, (k + 1) % n) for k in range(n)]
        chain = [(n + k, n + k + 1) for k in range(n)]
        assert found(spark, ring + chain + [(0, n), (n * 2, n * 3), (n * 3, n * 3)]) == dict.fromkeys(range(n), 0) | {n * 3: n * 3}
        rounds.append(len(calls))
    assert rounds[1] <= rounds[0] + 8


def test_cycles_of_the_parts_against_tarjan(spark):
    from driftloom.plans.roles import flows

    edges = [(r["src"], r["dst"]) for r in flows(spark, SF)[1].collect()]
    want = tarjan(edges)
    assert {r["id"]: r["component"] for r in catalog.queries()["g14_cycles"](spark, SF).collect()} == want
    nodes = {x for e in edges for x in e}
    assert 0 < len(want) < len(nodes)
