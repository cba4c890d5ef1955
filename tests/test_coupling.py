"""Pairs of files changed together (J13), with one very large commit."""

from itertools import combinations

from pyspark.sql import functions as F

from driftloom.operators import events


def test_a_large_commit_is_dealt_to_many_units(spark):
    rows = [("big", f"f{k:03}") for k in range(230)] + [("small", f"f{k:03}") for k in (3, 9, 200, 201)] + [("one", "f001"), (None, "f001"), (None, "f002")]
    df = spark.createDataFrame(rows + rows[:40], "c string, p string").repartition(3)
    got = {(r["a"], r["b"]): r["together"] for r in events.coupling(df, "c", "p", 20).collect()}
    want = dict.fromkeys(combinations([f"f{k:03}" for k in range(230)], 2), 1)
    for pair in combinations(["f003", "f009", "f200", "f201"], 2):
        want[pair] += 1
    assert got == want
    left, right = events.units(df, "c", "p", 20)
    for side in (left, right):
        sizes = side.filter("commit = 'big'").groupBy("i", "j").agg(F.count("*").alias("n")).collect()
        assert len(sizes) == 12 * 13 / 2 and max(r["n"] for r in sizes) < 45
    assert {(r["a"], r["b"]): r["together"] for r in events.coupling(df, "c", "p").collect()} == want
