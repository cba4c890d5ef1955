"""Exact percentiles against Spark's own, which holds all values."""

import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators import selection

WANTED = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(8), []
    kinds = {"normal": lambda: rng.gauss(0, 1), "wide": lambda: rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300), "few": lambda: rng.choice((1.0, 2.0, -0.0, 0.0)), "close": lambda: 1 + rng.randrange(50) * 2.0**-52, "odd": lambda: rng.choice((float("inf"), float("-inf"), 3.0, 5e-324, -5e-324))}
    for name, make in kinds.items():
        out += [(name, make()) for _ in range(rng.randrange(400, 700))]
    out += [(None, float(k)) for k in range(7)] + [("one", 4.5)] + [("nulls", None)] * 3 + [("one", None)]
    rng.shuffle(out)
    return spark.createDataFrame(out, "g string, v double").repartition(4)


def test_percentiles_by_group(rows):
    got = {r["g"]: r for r in selection.percentiles(rows, "v", ["g"], WANTED).collect()}
    want = {r["g"]: r for r in rows.groupBy("g").agg(*[F.percentile("v", q).alias(c) for c, q in WANTED.items()]).collect()}
    assert got.keys() == want.keys() and len(got) == 8
    for g, r in want.items():
        for c in WANTED:
            assert got[g][c] == r[c] or got[g][c] == pytest.approx(r[c], rel=1e-12, nan_ok=True), (g, c)


def test_percentiles_of_all_rows_and_nearest_ranks(spark, rows):
    some = rows.filter("g IN ('normal', 'close')")
    got = selection.percentiles(some, "v", [], WANTED).collect()
    want = some.agg(*[F.percentile("v", q).alias(c) for c, q in WANTED.items()]).first()
    assert len(got) == 1 and all(got[0][c] == pytest.approx(want[c], rel=1e-12) for c in WANTED)
    xs = sorted(r["v"] for r in some.collect())
    near = selection.percentiles(some, "v", [], WANTED, nearest=True).first()
    assert all(near[c] == xs[round(q * (len(xs) - 1))] for c, q in WANTED.items())
    none = spark.createDataFrame([], "g string, v double")
    assert selection.percentiles(none, "v", ["g"], WANTED).count() == 0
    assert selection.percentiles(none, "v", [], WANTED).first()["p50"] is None


def test_no_buffer_holds_all_values(rows):
    plan = selection.percentiles(rows, "v", ["g"], WANTED)._jdf.queryExecution().toString()
    assert "percentile" not in plan
