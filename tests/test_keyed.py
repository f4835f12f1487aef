"""Keyed permutations: bijections on pools of any size, and scores as by the matrix of permutations."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import inference, keyed


def placed(spark, sizes):
    nodes = [(i, f"p{p}") for p, n in enumerate(sizes) for i in range(1000 * p, 1000 * p + n)]
    return spark.createDataFrame(nodes, "node long, group string")


def drawn(spark, sizes, count, seed=3):
    known = keyed.pools(placed(spark, sizes), "group").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(count))))
    rows = known.select("pool", "size", "perm", "rank", keyed.permuted(F.col("rank"), F.col("perm"), seed).alias("to"), "a", "b")
    return rows.withColumn("back", keyed.permuted(F.col("to"), F.col("perm"), seed, True)).collect()


def test_permutations_are_bijections_of_their_pools(spark):
    sizes = [1, 2, 3, 5, 7, 12, 13, 31, 100, 127]
    told = {}
    for r in drawn(spark, sizes, 12):
        assert r["back"] == r["rank"] and (r["perm"] or r["to"] == r["rank"])
        assert r["size"] <= r["a"] * r["b"]
        told.setdefault((r["pool"], r["size"], r["perm"]), []).append(r["to"])
    assert all(sorted(v) == list(range(size)) for (_, size, _), v in told.items()) and len(told) == 13 * len(sizes)
    own = [tuple(v) for (_, size, perm), v in told.items() if size == 127 and perm]
    assert len(set(own)) == 12


def test_small_pools_take_every_order_alike(spark):
    orders = {}
    for r in sorted(drawn(spark, [2, 3, 4], 2400), key=lambda r: r["rank"]):
        if r["perm"]:
            orders.setdefault((r["size"], r["perm"]), []).append(r["to"])
    for size, kinds in ((2, 2), (3, 6), (4, 24)):
        seen = Counter(tuple(v) for (n, _), v in orders.items() if n == size)
        assert len(seen) == kinds and all(abs(c - 2400 / kinds) < 6 * (2400 / kinds) ** 0.5 for c in seen.values()), seen


def test_draws_are_about_even(spark):
    to = np.zeros((7, 7))
    for r in drawn(spark, [7], 1400):
        to[r["rank"], r["to"]] += r["perm"] > 0
    assert (np.abs(to - 200) < 70).all(), to


@pytest.mark.parametrize("sizes", [[9], [4, 6, 3]])
def test_scores_equal_those_of_the_written_permutations(spark, sizes):
    rng, count = np.random.default_rng(len(sizes)), 9
    nodes = placed(spark, sizes)
    index = [r[0] for r in nodes.orderBy("node").collect()]
    n = len(index)
    edges = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
    counts = [(w, index[i], int(v)) for w in range(5) for i in range(n) if (v := rng.integers(0, 4))] + [(9, i, 2) for i in index]
    table = spark.createDataFrame(counts, "window_id long, node long, n long")
    pairs = spark.createDataFrame([(index[i], index[j]) for i, j in edges], "node_i long, node_j long")
    got = {(r["window_id"], r["perm_id"]): r["score"] for r in keyed.edge_scores(table, nodes, pairs, "group", count, 3).collect()}
    # the same permutations, written out: node takes the history of its source
    known = {(r["pool"], r["rank"]): r["node"] for r in keyed.pools(nodes, "group").collect()}
    matrix = np.zeros((count + 1, n), dtype=int)
    for r in drawn(spark, sizes, count):
        matrix[r["perm"], index.index(known[r["pool"], r["rank"]])] = index.index(known[r["pool"], r["to"]])
    want = {(r["window_id"], k): s for r in inference.permutation_scores(table, index, np.array(edges), matrix).collect() for k, s in enumerate(r["scores"])}
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert v is None if want[k] is None or not np.isfinite(want[k]) else v == pytest.approx(want[k], abs=1e-10), k


def test_a_million_sensors(spark):
    """Neighbours along a line; a window of few records under two permutations, nothing collected but the scores."""
    nodes = spark.range(1_000_000).select(F.col("id").alias("node"), (F.col("id") % 2).alias("half"))
    edges = spark.range(999_999).select(F.col("id").alias("node_i"), (F.col("id") + 1).alias("node_j"))
    counts = spark.range(3000).select(F.lit(1).cast("long").alias("window_id"), (F.col("id") + 5).alias("node"), F.lit(1).cast("long").alias("n"))
    got = {r["perm_id"]: r["score"] for r in keyed.edge_scores(counts, nodes, edges, "half", 2).collect()}
    # 2,999 of the pairs are of records, which a permutation scatters
    assert got[0] == pytest.approx(1, abs=0.01) and abs(got[1]) < 0.05 and abs(got[2]) < 0.05
