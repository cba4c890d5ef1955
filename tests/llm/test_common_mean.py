"""Filters on vectors with a common mean, as text embeddings have one."""

import numpy as np
import pytest

from driftloom.llm import embed

DIM = 64


def vectors(n, cosine, seed=3):
    """n unit vectors of this mean cosine, and partners of the first 200 at just above .93."""
    rng = np.random.default_rng(seed)
    mean = rng.standard_normal(DIM)
    x = np.sqrt(cosine) * mean / np.linalg.norm(mean) + np.sqrt((1 - cosine) / DIM) * rng.standard_normal((n, DIM))
    x = embed.units(x)
    away = rng.standard_normal((200, DIM))
    away = embed.units(away - (away * x[:200]).sum(axis=1, keepdims=True) * x[:200])
    return np.concatenate([x, 0.931 * x[:200] + np.sqrt(1 - 0.931**2) * away])


def filtered(x):
    sample = np.random.default_rng(1).permutation(len(x))[: embed.SAMPLE]
    shift, blocks, words, cap, at = embed.fitted(x[sample], len(x))
    code, rest, found = embed.product_code(DIM, blocks, words), embed.rests(x, shift), [set() for _ in x]
    for k in range(0, len(x), 256):
        for r, d in zip(*embed.list_decode(rest[k : k + 256], code, cap, at * embed.LEAST // embed.DIRECTIONS), strict=True):
            found[k + r].add(int(d))
    _, load = np.unique([d for one in found for d in one], return_counts=True)
    return found, float((load * (load - 1.0)).sum()) / (len(x) * (len(x) - 1))


@pytest.mark.parametrize("cosine", [0.0, 0.5, 0.8])
def test_recall_and_share_of_pairs(cosine):
    shares = []
    for n in (4000, 24000):
        x = vectors(n, cosine)
        found, share = filtered(x)
        shares.append(share)
        met = [bool(found[k] & found[n + k]) for k in range(200)]
        assert np.mean(met) >= 0.9
        pairs = [(k + i, j) for k in range(0, len(x), 1000) for i, j in zip(*np.nonzero(x[k : k + 1000] @ x.T >= embed.COSINE), strict=True) if k + i < j]
        assert np.mean([bool(found[i] & found[j]) for i, j in pairs]) >= 0.9
    assert shares[1] < shares[0]


def test_links_of_a_label_with_a_mean_and_of_one_tight_cluster(spark):
    """Label 1 has a mean, label 2 is one cluster whose vectors all link, label 3 one vector."""
    rng = np.random.default_rng(5)
    x = vectors(700, 0.6)
    tight = embed.units(np.ones(DIM) + 0.05 * rng.standard_normal((150, DIM)))
    rows = [(k, 1, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, 2, v.tolist()) for k, v in enumerate(tight)] + [(5000, 3, tight[0].tolist())]
    got = {r["vec_id"]: r for r in embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    links = (x @ x.T >= embed.COSINE).sum(axis=1) - 1
    assert sum(got[k]["n_links"] for k in range(len(x))) >= 0.9 * links.sum()
    assert all(got[k]["n_links"] <= links[k] for k in range(len(x)))
    assert sum(got[1000 + k]["n_links"] for k in range(150)) >= 0.9 * 150 * 149
    assert {got[1000 + k]["component_id"] for k in range(150)} == {1000}
    assert tuple(got[5000]) == (5000, 0, 5000, True)
