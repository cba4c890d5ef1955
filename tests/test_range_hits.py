"""Hits of points in ranges (J14) without a row for each pair."""

import random

from pyspark.sql import functions as F

from driftloom.operators import events
from driftloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_hits_against_all_pairs(spark):
    rng = random.Random(3)
    points = [(k, rng.choice(("a", "b", None)), rng.choice((None, *range(-5, 30)))) for k in range(300)]
    ranges = [(rng.choice(("a", "b", "c", None)), rng.choice((None, *range(-5, 30))), rng.choice((None, *range(-5, 30)))) for _ in range(200)]
    p, r = spark.createDataFrame(points, "id long, file string, line long"), spark.createDataFrame(ranges, "file string, low int, high int")
    want = {k: sum(x is not None and x == f and None not in (a, b, at) and a <= at <= b for x, a, b in ranges) for k, f, at in points}
    got = events.range_hits(p, r, "file", "line", "low", "high").collect()
    assert {x["id"]: x["hits"] for x in got} == want and len(got) == 300 and max(want.values()) > 10
    assert events.range_hits(p, r.limit(0), "file", "line", "low", "high").agg(F.sum("hits")).first()[0] == 0


def test_many_ranges_on_one_line(spark):
    """Forty thousand million pairs."""
    n = 200_000
    p, r = spark.range(n).selectExpr("id", "'f' as file", "7 as line"), spark.range(n).selectExpr("'f' as file", "id % 8 as low", "7 + id % 3 as high")
    got = events.range_hits(p, r, "file", "line", "low", "high").agg(F.min("hits"), F.max("hits"), F.count("*")).first()
    assert tuple(got) == (n, n, n)


def test_the_query_forms_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(events, "in_ranges", None)
    assert catalog.queries()["j14_findings_in_hunks"](spark, SF).count() > 0
