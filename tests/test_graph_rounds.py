"""Rounds of G6 work on numbers and arrays of neighbours; hubs, ids of all kinds."""

import random

from driftloom.operators import graph


def test_labels_of_string_ids_and_of_hubs(spark, monkeypatch):
    """The rounds' tables hold numbers, also where ids are strings; a node of several arrays
    gets the same label."""
    rng = random.Random(8)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(90)})
    edges = [(a, b, float(rng.randrange(1, 4))) for a, b in pairs] + [(1, 99, 50.0)]
    name = lambda k: f"n{k:03}"
    numbers = spark.createDataFrame([(k,) for k in range(42)], "id long"), spark.createDataFrame(edges, "src long, dst long, weight double")
    strings = spark.createDataFrame([(name(k),) for k in range(42)], "id string"), spark.createDataFrame([(name(a), name(b), w) for a, b, w in edges], "src string, dst string, weight double")
    kept, plain = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: kept.append(df.schema) or plain(df))
    want = {name(r["id"]): name(r["community"]) for r in graph.label_propagation(*numbers, rounds=10, weight="weight").collect()}
    assert len(want) == 42 and 1 < len(set(want.values())) < 42
    kept.clear()
    assert {r["id"]: r["community"] for r in graph.label_propagation(*strings, rounds=10, weight="weight").collect()} == want
    rounds = [s for s in kept if "label" in s.names]
    assert rounds and all(s["label"].dataType.typeName() == "long" for s in rounds) and any("out" in s.names for s in kept)
    monkeypatch.setattr(graph, "CHUNK", 2)
    assert {r["id"]: r["community"] for r in graph.label_propagation(*strings, rounds=10, weight="weight").collect()} == want
