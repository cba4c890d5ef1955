"""Parallel prefix over one hot series, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators import prefix, series

SCHEMA = "k string, t long, x double, d boolean"


@pytest.fixture(scope="module")
def rows(spark):
    """A hot key, some short ones, a null key, nulls among the values, one constant."""
    rng, out = random.Random(4), []
    for key, n in (("hot", 6000), ("a", 3), ("b", 1), (None, 40), ("c", 200), ("none", 5)):
        for k in range(n):
            x = rng.gauss(0 if k < n / 2 else 2, 1)
            x = None if key == "none" or (key in (None, "c") and rng.random() < 0.2) else x
            out.append((key, k * 3, 5.0 if key == "a" else x, rng.random() < 0.02))
    df = out[:]
    rng.shuffle(df)
    return spark.createDataFrame(df, SCHEMA).repartition(5), out


def by_key(rows):
    keys = {}
    for r in rows:
        keys.setdefault(r[0], []).append(r)
    return keys.values()


def close(got, want):
    assert got.keys() == want.keys()
    odd = [(k, got[k], want[k]) for k in got if got[k] != (pytest.approx(want[k], abs=1e-8) if isinstance(want[k], float) else want[k])]
    assert not odd, (len(odd), odd[:3])


def test_a_hot_key_is_in_many_blocks(rows):
    dealt = prefix.blocks(rows[0], "k", "t").groupBy("k").agg(F.count_distinct("_part").alias("n"))
    assert {r["k"]: r["n"] for r in dealt.collect()}["hot"] >= 4


@pytest.mark.parametrize("lam", [0.15, 0.9, 0.001])
def test_ewma(rows, lam):
    want = {}
    for part in by_key(rows[1]):
        m = None
        for k, t, x, _ in part:
            m = m if x is None else x if m is None else lam * x + (1 - lam) * m
            want[k, t] = m
    out = series.ewma(rows[0], "k", "t", "x", lam)
    assert out.columns == ["k", "t", "x", "d", "ewma"]
    close({(r["k"], r["t"]): r["ewma"] for r in out.collect()}, want)


def test_page_hinkley(rows):
    want = {}
    for part in by_key(rows[1]):
        n, total, c, low = 0, 0.0, 0.0, float("inf")
        for k, t, x, _ in part:
            if x is not None:
                n, total = n + 1, total + x
                c += x - total / n - 0.1
            low = min(low, c)
            want[k, t] = c - low
    out = series.page_hinkley(rows[0], "k", "t", "x", 0.1, 30.0).collect()
    close({(r["k"], r["t"]): r["ph"] for r in out}, want)
    assert all(r["drift"] == (r["ph"] > 30) for r in out) and any(r["drift"] for r in out)


@pytest.mark.parametrize("n", [0, 7, 2500])
def test_frozen(rows, n):
    held, value = {}, {}
    for part in by_key(rows[1]):
        since, last = n + 1, None
        for k, t, x, d in part:
            since = 0 if d else since + 1
            last = x if since > n and x is not None else last
            held[k, t], value[k, t] = since <= n, last
    out = series.frozen(rows[0], "k", "t", "x", "d", n).collect()
    close({(r["k"], r["t"]): r["held"] for r in out}, held)
    close({(r["k"], r["t"]): r["frozen"] for r in out}, value)


def test_running_sums(rows):
    want = {}
    for part in by_key(rows[1]):
        total = None
        for k, t, x, _ in part:
            total = total if x is None else (total or 0.0) + x
            want[k, t] = total
    out = series.ledger(rows[0], "k", "t", ["x", "t"]).collect()
    close({(r["k"], r["t"]): r["run_x"] for r in out}, want)
    assert max(r["run_t"] for r in out if r["k"] == "hot") == sum(3 * k for k in range(6000))


def test_empty_series(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [f.count() for f in (series.ewma(none, "k", "t", "x"), series.page_hinkley(none, "k", "t", "x", 1.0, 1.0), series.frozen(none, "k", "t", "x", "d", 3), series.ledger(none, "k", "t", ["x"]))] == [0] * 4
