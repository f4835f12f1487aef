"""Permutations as column expressions, and scan scores over edges: for sensors of any number.

A permutation of a pool is a keyed bijection of ranks: rank = left x b + right on a grid of a x b cells, in rounds that
add to one half a hash of the other, walked on from cells that the pool doesn't fill.  Where a history stands under a
permutation follows from its rank and the permutation's number alone, so no permutation is ever written out, and a
score is a join of the placed histories with the edges.  (inference.permutation_scores is quicker where all
permutations fit beside every task.)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.operators.temporal import numbered
from tremorlake.sources.shared import cut

ROUNDS = 6
#: Grids that are tried for the one with the fewest cells to spare.
GRIDS = 64


def pools(nodes: DataFrame, pool: str, key: str = "node") -> DataFrame:
    """key, pool, rank, size, a, b: each node's rank in its pool, and the pool's grid."""
    placed = cut(numbered(nodes.select(F.col(key).alias("node"), F.col(pool).alias("pool")), ["pool", "node"], "g"))
    each = placed.groupBy(F.col("pool").alias("_pool")).agg(F.min("g").alias("first"), F.count("*").alias("size"))
    near = F.floor(F.sqrt("size")).cast("long")
    grid = lambda a: F.struct((a * F.ceil(F.col("size") / a) - F.col("size")).alias("spare"), a.alias("a"))
    # both sides of the grid must mix: one of a single row would only turn the ranks around
    least = F.greatest(near - GRIDS // 2, F.ceil(near / 2), F.when(F.col("size") > 2, 2).otherwise(1)).cast("long")
    tried = F.filter(F.sequence(least, near + GRIDS // 2), lambda a: (a <= F.greatest(2 * near, least)))
    best = each.withColumn("grid", F.array_min(F.transform(tried, grid)))
    best = best.select("_pool", "first", "size", F.col("grid.a").alias("a"), F.ceil(F.col("size") / F.col("grid.a")).alias("b"))
    return placed.join(best, F.col("pool").eqNullSafe(F.col("_pool"))).select("node", "pool", (F.col("g") - F.col("first")).alias("rank"), "size", "a", "b")


def _round(x: Column, i: int, back: bool, perm: Column, seed: int) -> Column:
    """One half moved by a hash of the other.  x: struct of left and right."""
    left, right, a, b = x["left"], x["right"], F.col("a"), F.col("b")
    told = lambda half, n: F.pmod(F.xxhash64(F.lit(seed), F.col("pool").cast("string"), perm.cast("long"), F.lit(i), half.cast("long")), n)
    if i % 2:
        moved = F.pmod(right - told(left, b) if back else right + told(left, b), b)
        return F.struct(left.alias("left"), moved.alias("right"))
    moved = F.pmod(left - told(right, a) if back else left + told(right, a), a)
    return F.struct(moved.alias("left"), right.alias("right"))


def permuted(rank: Column, perm: Column, seed: int = 0, back: bool = False) -> Column:
    """The rank whose history stands at that rank under a permutation, or with back where a rank's history stands.

    Reads pool, size, a and b of the row; permutation 0 is the identity.  A walk leaves the cells to spare after as
    many steps as there are at most."""
    order = list(reversed(range(ROUNDS))) if back else list(range(ROUNDS))

    def once(v: Column) -> Column:
        x = F.struct(F.floor(v / F.col("b")).cast("long").alias("left"), F.pmod(v, F.col("b")).alias("right"))
        steps = F.array(*[F.lit(i) for i in order])
        # the round's number picks one of the few expressions
        moved = F.aggregate(steps, x, lambda s, i: _pick(s, i, back, perm, seed))
        return moved["left"] * F.col("b") + moved["right"]

    spare = F.col("a") * F.col("b") - F.col("size")
    walked = F.aggregate(F.sequence(F.lit(0).cast("long"), spare), F.struct(rank.cast("long").alias("v"), F.lit(False).alias("done")), lambda s, _: F.when(s["done"], s).otherwise(_step(once(s["v"]))))
    return F.when(perm == 0, rank).otherwise(walked["v"])


def _step(v: Column) -> Column:
    return F.struct(v.alias("v"), (v < F.col("size")).alias("done"))


def _pick(s: Column, i: Column, back: bool, perm: Column, seed: int) -> Column:
    out = s
    for k in range(ROUNDS):
        out = F.when(i == k, _round(s, k, back, perm, seed)).otherwise(out)
    return out


def edge_scores(counts: DataFrame, nodes: DataFrame, edges: DataFrame, pool: str, count: int, seed: int = 0) -> DataFrame:
    """window_id, perm_id, score: Moran's I of every window under the permutations 0 (as it is) to count.

    counts: window_id, node, n, sparse.  nodes: node and its pool.  edges: node_i, node_j, each once.  Deviations from
    the mean are sums over what is there: of products over edges, of values by their nodes' degrees, of squares."""
    known = cut(pools(nodes, pool))
    n, e = known.count(), edges.count()
    own = counts.join(known, "node").withColumn("perm_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count).cast("long"))))
    moved = own.select("window_id", "perm_id", F.col("n").cast("double").alias("x"), F.col("pool").alias("_pool"), permuted(F.col("rank"), F.col("perm_id"), seed, True).alias("_rank"))
    there = known.select("node", "pool", "rank")
    placed = cut(moved.join(there, F.col("_pool").eqNullSafe(F.col("pool")) & (F.col("_rank") == F.col("rank"))).select("window_id", "perm_id", "node", "x"))
    ends = edges.select(F.explode(F.array("node_i", "node_j")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    sums = placed.join(ends, "node", "left").groupBy("window_id", "perm_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum(F.col("x") * F.coalesce("degree", F.lit(0))).alias("d"))
    left = placed.join(edges, F.col("node") == F.col("node_i")).select("window_id", "perm_id", F.col("node_j").alias("node"), F.col("x").alias("y"))
    met = left.join(placed, ["window_id", "perm_id", "node"]).groupBy("window_id", "perm_id").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    mean = F.col("s") / n
    up = F.coalesce("p", F.lit(0.0)) - mean * F.col("d") + e * mean * mean
    return sums.join(met, ["window_id", "perm_id"], "left").select("window_id", "perm_id", F.try_divide(n / F.lit(max(e, 1)) * up, F.col("q") - n * mean * mean).alias("score"))
