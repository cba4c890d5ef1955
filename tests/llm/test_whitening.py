"""Whitening against numpy and exact sums, and eigenvectors of hard matrices."""

import math

import numpy as np
import pytest

from driftloom.llm import whiten

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"
rng = np.random.default_rng(5)
BASIS = np.linalg.qr(rng.standard_normal((48, 48)))[0]


def check(a):
    e, x = whiten.eigenvectors(a)
    size, wide = max(np.abs(a).max(), 1e-300), a.astype(np.longdouble)
    assert np.abs(wide @ x - x * e).max() <= 4e-15 * size
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 2e-15
    assert (np.diff(e) <= 0).all() and e.min(initial=0) >= 0
    np.testing.assert_allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size)
    return e, x


@pytest.mark.parametrize(
    "values",
    [np.r_[np.ones(24), np.full(24, 2.0)], 1 + 1e-9 * np.arange(48), 1 + 1e-13 * np.arange(48), 10.0 ** -np.arange(48), np.r_[3, 2, 1, np.zeros(45)], np.r_[5, 5 + 1e-7, 5 - 1e-7, np.linspace(1, 2, 45)], np.full(48, 7.0)],
    ids=["two equal", "near 1e-9", "near 1e-13", "graded", "rank 3", "three close", "all equal"],
)
def test_eigenvectors_of_clusters(values):
    a = (BASIS * values) @ BASIS.T
    check((a + a.T) / 2)


@pytest.mark.parametrize("d", [1, 2, 5, 64, 150])
def test_eigenvectors_of_samples(d):
    y = rng.standard_normal((d * 8, d)) * np.linspace(1, 5, d)
    check(y.T @ y / len(y))
    check(np.zeros((d, d)))
    check(np.diag(np.arange(1.0, d + 1)))


def test_float32_vectors_are_corrected():
    """From single precision, the iterations gain what a double holds."""
    y = rng.standard_normal((400, 40))
    a = y.T @ y / 400
    x32 = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    assert np.abs(x32.T @ x32 - np.eye(40)).max() > 1e-9
    x, e = whiten.refined(a, x32, np.float64)
    assert np.abs(a @ x - x * e).max() < 1e-13 and np.abs(x.T @ x - np.eye(40)).max() < 1e-13


def plain(vectors):
    """n, sums, deviations and leading components of whole vectors, with exact numbers."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[a - b / n for a, b in zip(v, s, strict=True)] for v in x])
    cov = y.T @ y / n
    e, vec = np.linalg.eigh(cov)
    return n, [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x], y, e[::-1], vec[:, ::-1], np.trace(cov)


def compare_rows(rows, vectors, ids):
    n, dev, y, e, vec, trace = plain(vectors)
    k = min(8, len(vectors[0]))
    got = {}
    for r in rows:
        got[r["vec_id"], r["component"]] = r
    assert len(got) == len(rows) == len(ids) * k
    for c in range(k):
        want = y @ vec[:, c] / np.sqrt(e[c])
        mine = np.array([got[i, c + 1]["whitened"] for i in ids])
        sign = 1 if (want * mine).sum() > 0 else -1
        gap = min([abs(e[c] - e[j]) for j in range(len(e)) if j != c] or [e[c]]) / e[0]
        np.testing.assert_allclose(mine * sign, want, atol=1e-12 / gap)
        for i, d in zip(ids, dev, strict=True):
            r = got[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, d)
            assert r["explained"] == pytest.approx(e[c] / trace, rel=1e-9) and 0 <= r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in rows}) == 1


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    compare_rows(whiten.whiten(df).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_whitening_of_odd_rows(spark):
    v = rng.standard_normal((60, 5)).astype(np.float32) * 3e2
    good = [(k, v[k].tolist(), 0, "x", "y") for k in range(60)]
    bad = [(100, None, 1, "", ""), (101, [], 1, "", ""), (102, [1.0, None, 2.0, 3.0, 4.0], 1, "", ""), (103, [float("nan")] * 5, 1, "", ""), (104, [float("inf"), 1.0, 1.0, 1.0, 1.0], 1, "", "")]
    df = spark.createDataFrame(good + bad, SCHEMA).repartition(4)
    out = whiten.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare_rows(out.collect(), v, list(range(60)))
    # other lengths are fits of their own; equal and single vectors have no variance
    mixed = [*good, (None, [1.0, 2.0], 0, "", ""), (7, [1.0, 2.0], 0, "", ""), (200, [9.0] * 3, 0, "", "")]
    rows = whiten.whiten(spark.createDataFrame(mixed, SCHEMA)).collect()
    compare_rows([r for r in rows if r["n"] == 60], v, list(range(60)))
    flat = [r for r in rows if r["n"] < 60]
    assert len(flat) == 2 * 2 + 3 and all(r["whitened"] is None and r["deviation"] == r["identity_error"] == r["explained"] == 0 for r in flat)
    # repeated rows and one direction only
    line = spark.createDataFrame([(1, [float(k), 2.0 * k], 0, "", "") for k in range(5) for _ in range(2)], SCHEMA)
    rows = whiten.whiten(line).collect()
    assert len(rows) == 20 and all((r["whitened"] is None) == (r["component"] == 2) for r in rows)


def test_whitening_of_large_entries_and_empty_tables(spark):
    assert whiten.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = whiten.whiten(spark.createDataFrame([(1, [3e38, 0.0], 0, "", ""), (2, [-3e38, 1.0], 0, "", ""), (3, [0.5, 2.0], 0, "", "")], SCHEMA)).collect()
    assert len(rows) == 6 and {r["deviation"] for r in rows} == {None, *[r["deviation"] for r in rows if r["vec_id"] == 3]}


def test_deviations_beyond_doubles_are_exact():
    x = np.array([[10**8, 3], [5, 7], [10**8 + 1, 1]], np.int64)
    s = x.sum(axis=0).tolist()
    assert whiten.deviation(x, 3, s) == [sum((3 * int(a) - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
