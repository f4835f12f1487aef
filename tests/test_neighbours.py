"""Pruned neighbours against comparing everything."""

from __future__ import annotations

import numpy as np
import pytest

from tremorlake.operators import neighbours, screening

SCHEMA = "key long, vector array<double>, label string"


def table(spark, x, labels, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v], str(n)) for i, (v, n) in enumerate(zip(x, labels, strict=True))], SCHEMA).repartition(4)


def brute(x, keys, y, others, k, exclude):
    out = {}
    for v, key in zip(x, keys, strict=True):
        d = np.sqrt(((v - y) ** 2).sum(1))
        out[key] = np.sort(d[others != key] if exclude else d)[:k]
    return out


def same(found, want):
    assert found.keys() == want.keys()
    for key in want:
        assert len(found[key]) == len(want[key]) and np.allclose(found[key], want[key], rtol=0, atol=1e-12), key


def clustered(seed, n, centres=40, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, 9))[rng.integers(0, centres, n)] * 10 + rng.normal(size=(n, 9))
    x[:copies] = x[0]
    return x, rng.integers(0, 3, n)


@pytest.mark.parametrize("seed, n, copies, block, cell", [(1, 900, 0, 20_000, 20), (2, 700, 250, 30, 90), (3, 5, 0, 2, 500), (4, 60, 60, 7, 3)])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, seed, n, copies, block, cell):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    x, labels = clustered(seed, n, copies=copies)
    keys = np.arange(n)
    df = table(spark, x, labels)
    same({r["key"]: r["distances"] for r in screening.knn(df, df, 6).collect()}, brute(x, keys, x, keys, 6, True))
    own, own_labels = clustered(seed + 10, 50)
    far = np.vstack([own, own[:3] * 1e4])
    q = table(spark, far, [0] * 53, first=10_000)
    same({r["key"]: r["distances"] for r in screening.knn(q, df, 4, exclude_self=False).collect()}, brute(far, range(10_000, 10_053), x, keys, 4, False))
    each = screening.knn(q, df, 4, exclude_self=False, per_label=True).collect()
    for name in set(labels.tolist()):
        same({r["key"]: r["distances"] for r in each if r["label"] == str(name)}, brute(far, range(10_000, 10_053), x[labels == name], keys[labels == name], 4, False))


def test_a_tenth_of_the_pairs_is_compared(spark):
    x, _ = clustered(5, 6000, centres=60)
    df = table(spark, x, [0] * 6000).selectExpr("key", "vector", "'' AS space")
    search = neighbours.Search(df, 50)
    pairs = search.pairs(df.select("key", "vector"), 5)
    assert pairs < 6000 * 6000 / 10, pairs / 6000**2
    some = {r["key"]: r["distances"] for r in search.nearest(df.where("key < 40").select("key", "vector"), 5).collect()}
    same(some, brute(x[:40], range(40), x, np.arange(6000), 5, True))


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_nearest_by_products_are_those_by_differences(monkeypatch, far):
    """Copies, and points so far from the origin that a product alone tells them apart by 1e-3 at best."""
    monkeypatch.setattr(neighbours, "LEAD", 7)
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.normal(size=(200, 6)), np.zeros((30, 6))]) + far
    x = np.concatenate([y[150:], rng.normal(size=(20, 6)) + far])
    full = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    assert np.allclose(neighbours.distances(x, y), full, rtol=1e-9, atol=1e-12)
    same = np.zeros(full.shape, bool)
    same[np.arange(80), np.arange(150, 230)] = True
    for apart, want in ((None, full), (same, np.where(same, np.inf, full))):
        got = neighbours.nearest_of(x, y, 5, np.full(len(x), np.inf), apart)
        assert np.array_equal(np.array(got), np.sort(want, 1)[:, :5])
