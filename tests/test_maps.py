"""Scores of whole maps: those of the written permutations, with nothing of the sensors' number in the driver."""

from __future__ import annotations

import numpy as np
import pytest

from tests.test_scan import scattered
from tremorlake.operators import inference, maps, spatial
from tremorlake.plans import time_space


@pytest.mark.parametrize("most", [5, 3000])
def test_scores_equal_those_of_the_matrix_of_permutations(spark, monkeypatch, most):
    monkeypatch.setattr(maps, "ROWS", 16)
    monkeypatch.setattr(maps, "WIDE", 3)
    rng = np.random.default_rng(most)
    index = np.sort(rng.choice(10**12, 50, replace=False))
    kinds = rng.integers(0, 4, 50)
    nodes = spark.createDataFrame([(int(v), f"p{k}") for v, k in zip(index, kinds)], "node long, pool string")
    pairs = [(i, j) for i in range(50) for j in range(i + 1, 50) if rng.random() < (0.9 if i == 7 else 0.1)]
    edges = spark.createDataFrame([(int(index[i]), int(index[j])) for i, j in pairs], "node_i long, node_j long")
    counts = spark.createDataFrame([(w, int(v), int(rng.integers(1, most))) for w in (0, 1, 5, 8) for v in index if rng.random() < 0.6], "window_id long, node long, n long")
    matrix = inference.seeded_permutations([np.flatnonzero(kinds == k).tolist() for k in range(4)], 50, 1200, 11)
    want = {r[0]: r[1] for r in inference.permutation_scores(counts, index, np.array(pairs), matrix).collect()}
    got = {r[0]: r[1] for r in maps.map_scores(counts, nodes, edges, "pool", 1200, 11).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[w], want[w], rtol=0, atol=1e-12) for w in want)
    drawn = inference.hashed_permutations(nodes, "pool", 7)
    where = {v: i for i, v in enumerate(index)}
    matrix = np.zeros((8, 50), int)
    for r in drawn.collect():
        matrix[r["perm_id"], where[r["node"]]] = where[r["source"]]
    want = {r[0]: r[1] for r in inference.permutation_scores(counts, index, np.array(pairs), matrix).collect()}
    got = {r[0]: r[1] for r in maps.map_scores(counts, nodes, edges, "pool", 7, drawn=drawn).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[w], want[w], rtol=0, atol=1e-12) for w in want)


@pytest.mark.parametrize("name", ["full_permutation_scan", "full_null_summary"])
def test_full_scans_write_no_matrix_in_the_driver(spark, tmp_path, monkeypatch, name):
    def refused(*_):
        raise AssertionError("a matrix of sensors by permutations")

    scattered(spark, tmp_path)
    for made in ("seeded_permutations", "permutation_scores"):
        monkeypatch.setattr(inference, made, refused)
    assert time_space.QUERIES[name](spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("name", ["permutation_scan", "null_summary", "scan_episodes"])
def test_scans_take_any_number_of_sensors(spark, tmp_path, monkeypatch, name):
    scattered(spark, tmp_path)
    monkeypatch.setattr(inference, "SENSORS", 10)
    assert time_space.QUERIES[name](spark, str(tmp_path)).count() > 0


def test_moran_makes_no_row_for_an_edge_in_a_window(spark, tmp_path, monkeypatch):
    def refused(*_):
        raise AssertionError("counts joined with edges")

    scattered(spark, tmp_path)
    n = time_space.nodes(spark, str(tmp_path))
    want = spatial.moran(time_space.window_node_counts(spark, str(tmp_path)), spatial.radius_graph(n, time_space.RADIUS), n.count())
    want = {r[0]: r[1] for r in want.where("moran_i is not null").collect()}
    monkeypatch.setattr(spatial, "moran", refused)
    got = {r[0]: r[1] for r in time_space.QUERIES["moran_windows"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-6 for w in want)
