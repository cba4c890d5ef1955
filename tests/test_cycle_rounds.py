"""Rounds of G14 work on numbers, also where ids are strings."""

import random

from driftloom.operators import cycles
from tests.test_cycles import tarjan


def test_colours_are_numbers(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(f"k{rng.randrange(300)}", f"k{rng.randrange(300)}") for _ in range(420)]
    kept, plain = [], cycles.stored
    monkeypatch.setattr(cycles, "stored", lambda df: kept.append(df.schema) or plain(df))
    got = {r["id"]: r["component"] for r in cycles.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == tarjan(edges) and len(set(got.values())) > 1
    colours = [s for s in kept if "colour" in s.names]
    assert colours and all(s["colour"].dataType.typeName() == "long" for s in colours)
