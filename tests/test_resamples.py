"""Bootstrap resamples (A37) against real draws with replacement."""

import numpy as np
import pytest

from driftloom.operators import experiments, resamples

SCHEMA = "arm string, v double"


def real(xs, rounds=2000, seed=3):
    rng = np.random.default_rng(seed)
    draws = np.array([rng.choice(xs, len(xs)) for _ in range(rounds)])
    return draws.mean(axis=1), np.median(draws, axis=1)


@pytest.fixture(scope="module")
def arms():
    rng = np.random.default_rng(1)
    return {"few values": rng.integers(0, 5, 3000).astype(float), "all apart": rng.normal(3, 2, 1500), "heavy": rng.pareto(1.5, 400), None: rng.normal(0, 1, 9), "same": np.full(700, 2.5)}


@pytest.fixture(params=[512, 16])
def found(request, spark, arms, monkeypatch):
    """With trees of one level and of several."""
    monkeypatch.setattr(resamples, "LEAF", request.param)
    monkeypatch.setattr(resamples, "FANOUT", request.param)
    rows = [(a, float(x)) for a, xs in arms.items() for x in xs] + [("few values", None), ("no values", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df, *resamples.rounds_of(df, ["arm"], "v", 2000, 17)


def test_resamples_are_drawn_with_replacement(spark, arms, found):
    df, out, names = found
    key = {r[1]: r[0] for r in names.select("arm", "_arm").collect()}
    got = {}
    for r in out.collect():
        got.setdefault(key[r["_arm"]], []).append((r["drawn"], r["mean"], r["median"]))
    assert got.keys() == arms.keys()
    for a, rows in got.items():
        drawn, mean, median = map(np.array, zip(*rows, strict=True))
        xs = arms[a]
        assert len(rows) == 2000 and (drawn == len(xs)).all()  # in every round
        for mine, theirs in zip((mean, median), real(xs), strict=True):
            error = 4 * theirs.std() * np.sqrt(1 / 1000)
            assert abs(mine.mean() - theirs.mean()) <= error + 1e-12
            assert abs(mine.std() - theirs.std()) <= error + 1e-12
            for q in (0.025, 0.975):  # within four standard errors of the rank
                low, high = np.quantile(theirs, [max(0, q - 0.02), min(1, q + 0.02)])
                assert low - 1e-9 <= np.quantile(mine, q) <= high + 1e-9, (a, q)


def test_intervals_by_arm_and_of_all(spark, found):
    df, _, _ = found
    got = {r["arm"]: r for r in experiments.bootstrap(df, "arm", "v", 200).collect()}
    assert got["same"]["mean_low"] == got["same"]["median_high"] == 2.5
    assert got["no values"]["mean_low"] is None and len(got) == 6
    again = {r["arm"]: r for r in experiments.bootstrap(df.repartition(1), "arm", "v", 200).collect()}
    assert all(again[a]["median_low"] == r["median_low"] for a, r in got.items())
    none = experiments.bootstrap_ci(spark.createDataFrame([], SCHEMA), "v").collect()
    assert len(none) == 1 and none[0]["low"] is None
