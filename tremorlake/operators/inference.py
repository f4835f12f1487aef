"""Permutation inference for scans: constrained permutations, their scores, max statistics, Holm, episodes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.checks import DataError
from tremorlake.operators.temporal import islands
from tremorlake.sources.shared import cut

TIE = 1e-12
#: Sensors of a scan, whose permutations and edges go along with every task.
SENSORS = 50_000


def hashed_permutations(nodes: DataFrame, pool: str, count: int, key: str = "node") -> DataFrame:
    """perm_id, node, source: within each pool the nodes in order take the histories of the nodes in md5 order.

    perm_id 0 is the identity.  Any engine with md5 draws the same."""
    spread = nodes.select(key, pool).withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(count)).cast("array<bigint>")))
    w = Window.partitionBy("perm_id", pool)
    placed = spread.withColumns({
        "i": F.row_number().over(w.orderBy(key)),
        "j": F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", "perm_id", key)), key)),
    })
    left = placed.select("perm_id", pool, F.col("i").alias("r"), F.col(key).alias("node"))
    right = placed.select("perm_id", pool, F.col("j").alias("r"), F.col(key).alias("source"))
    drawn = left.join(right, ["perm_id", pool, "r"]).select("perm_id", "node", "source")
    return drawn.unionByName(nodes.select(F.lit(0).cast("long").alias("perm_id"), F.col(key).alias("node"), F.col(key).alias("source")))


def seeded_permutations(pools: Sequence[Sequence[int]], node_count: int, count: int, seed: int) -> np.ndarray:
    """(count + 1) x node_count, the identity first: one draw for each permutation and each pool of two or more."""
    rng = np.random.default_rng(seed)
    out = np.tile(np.arange(node_count), (count + 1, 1))
    for row in out[1:]:
        for pool in pools:
            if len(pool) > 1:
                row[list(pool)] = rng.permutation(np.asarray(pool))
    return out


def permutation_scores(counts: DataFrame, node_index: Sequence[int], edges: np.ndarray, permutations: np.ndarray) -> DataFrame:
    """window_id, scores: Moran's I of each window under every permutation.

    counts: window_id, node, n, sparse.  A window needs all its scores for its own standardisation and none
    of another's, so blocks of windows are the partitions; permutations and edges are of a size set by the
    study (nodes x permutations) and go along with the function."""
    if len(node_index) > SENSORS:
        raise DataError(f"over {SENSORS} sensors: {len(node_index)}")
    where = {int(v): i for i, v in enumerate(node_index)}
    n, left, right = len(node_index), edges[:, 0], edges[:, 1]
    # a permuted map's edge sum is a quadratic form of the permuted adjacency: for a dense enough graph one
    # small matrix product a permutation, else a gather over the edges
    dense = n * n <= 32 * len(left)
    adjacency = np.zeros((n, n))
    adjacency[left, right] = 0.5
    adjacency += adjacency.T
    inverse = np.argsort(permutations, 1)
    # a named number of partitions: the rows are few and small but the work on each is not, so AQE must not
    # put them together by their size; by a key of its own, as a dealing that is there already would be kept
    tasks = 2 * counts.sparkSession.sparkContext.defaultParallelism
    per_window = counts.groupBy("window_id").agg(F.collect_list("node").alias("nodes"), F.collect_list("n").alias("ns"))
    per_window = per_window.repartition(tasks, F.xxhash64("window_id"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                x = np.zeros((len(part), n))
                for i, (nodes, ns) in enumerate(zip(part["nodes"], part["ns"], strict=True)):
                    x[i, [where[int(v)] for v in nodes]] = ns
                x -= x.mean(1, keepdims=True)
                down = (x * x).sum(1)
                out = np.empty((len(part), len(permutations)))
                for k, p in enumerate(permutations):
                    if dense:
                        back = inverse[k]
                        out[:, k] = np.einsum("wn,wn->w", x @ adjacency[back][:, back], x)
                    else:
                        out[:, k] = (x[:, p[left]] * x[:, p[right]]).sum(1)
                out *= n / len(left)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out /= down[:, None]
                yield pd.DataFrame({"window_id": part["window_id"], "scores": list(out)})

    return per_window.mapInPandas(score, "window_id long, scores array<double>")


def scan_statistics(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """max_scan for whole rows of scores: what a window needs is in its row, and a partition gives the other
    windows only its largest z for each permutation, so no score is ever exploded or shuffled."""
    kept = cut(scores)

    def standard(batch: pd.DataFrame) -> tuple[np.ndarray, ...]:
        s = np.array(batch["scores"].tolist()).reshape(len(batch), -1)
        center, scale = s.mean(1), s.std(1, ddof=1)
        ok = scale > 1e-12
        z = np.where(ok[:, None], (s - center[:, None]) / np.where(ok, scale, 1)[:, None], 0.0)
        return s[:, 0], center, scale, ok, z

    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            if len(batch):
                _, _, _, ok, z = standard(batch)
                if ok.any():
                    top = z[ok].max(0)
                    best = top if best is None else np.maximum(best, top)
        if best is not None:
            yield pd.DataFrame({"perm_id": np.arange(len(best)), "m": best})

    tops = kept.mapInPandas(largest, "perm_id long, m double").groupBy("perm_id").agg(F.max("m").alias("m"))
    found = tops.orderBy("perm_id").toPandas()["m"].to_numpy()  # a row a permutation
    null = np.sort(found[1:])
    p_global = float((1 + (null >= found[0] - TIE).sum()) / len(found)) if len(found) else 1.0
    critical = float(null[int(np.ceil((len(null) - 1) * (1 - alpha) - 1e-9))]) if len(null) else 0.0

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            observed, center, scale, ok, z = standard(batch)
            p = (1 + len(null) - np.searchsorted(null, z[:, 0] - TIE)) / (len(null) + 1)
            yield pd.DataFrame({"window_id": batch["window_id"], "observed": observed, "center": center, "scale": scale, "informative": ok, "scan_z": z[:, 0], "p_window": np.where(ok, p, 1.0), "p_global": p_global, "critical": critical})

    return kept.mapInPandas(judge, "window_id long, observed double, center double, scale double, informative boolean, scan_z double, p_window double, p_global double, critical double")


def long_scores(scores: DataFrame) -> DataFrame:
    return scores.select("window_id", F.posexplode("scores").alias("perm_id", "score")).withColumn("perm_id", F.col("perm_id").cast("long"))


def max_scan(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """scores: window_id, perm_id (0 observed), score.  Every window's observed z, its p over the scan, and the global p.

    Standardisation takes all rows, the observed one too; the maximum over informative windows is one row per
    permutation; ties count against rejection."""
    stats = scores.groupBy("window_id").agg(F.avg("score").alias("center"), F.stddev_samp("score").alias("scale"))
    stats = stats.withColumn("informative", F.coalesce(F.col("scale") > 1e-12, F.lit(False)))
    z = scores.join(stats, "window_id").withColumn("z", F.when(F.col("informative"), (F.col("score") - F.col("center")) / F.col("scale")).otherwise(0.0))
    maxima = z.where("informative").groupBy("perm_id").agg(F.max("z").alias("m"))
    # one array of as many maxima as there are permutations
    null = maxima.agg(F.sort_array(F.collect_list(F.when(F.col("perm_id") > 0, F.col("m")))).alias("null"), F.max(F.when(F.col("perm_id") == 0, F.col("m"))).alias("top"))
    seen = z.where("perm_id = 0").select("window_id", F.col("score").alias("observed"), "center", "scale", "informative", F.col("z").alias("scan_z"))
    full = seen.join(F.broadcast(null), how="left", on=F.lit(True))
    reach = lambda v: F.size(F.filter("null", lambda m: m >= v - TIE))
    size = F.size("null") + 1
    return full.select(
        "window_id",
        "observed",
        "center",
        "scale",
        "informative",
        "scan_z",
        F.when(F.col("informative"), (1 + reach(F.col("scan_z"))) / size).otherwise(1.0).alias("p_window"),
        F.when(F.col("top").isNotNull(), (1 + reach(F.col("top"))) / size).otherwise(1.0).alias("p_global"),
        F.coalesce(quantile_higher("null", 1 - alpha), F.lit(0.0)).alias("critical"),
    )


def quantile_higher(sorted_array: str, q: float) -> Column:
    """The smallest element at or above position (n - 1) q of a sorted array."""
    return F.get(F.col(sorted_array), F.ceil((F.size(sorted_array) - 1) * F.lit(q) - 1e-9).cast("int"))


def null_summary(scores: DataFrame) -> DataFrame:
    """Mean, sample deviation and the 2.5 and 97.5 percent points over the random rows."""
    s = scores.where("perm_id > 0").groupBy("window_id")
    return s.agg(F.avg("score").alias("null_mean"), F.stddev_samp("score").alias("null_sd"), F.percentile("score", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("window_id", "null_mean", "null_sd", F.col("q")[0].alias("null_q025"), F.col("q")[1].alias("null_q975"))


def null_statistics(scores: DataFrame) -> DataFrame:
    """null_summary for whole rows of scores."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = np.array(batch["scores"].tolist()).reshape(len(batch), -1)[:, 1:]
            low, high = np.quantile(s, [0.025, 0.975], axis=1)
            yield pd.DataFrame({"window_id": batch["window_id"], "null_mean": s.mean(1), "null_sd": s.std(1, ddof=1), "null_q025": low, "null_q975": high})

    return scores.mapInPandas(summed, "window_id long, null_mean double, null_sd double, null_q025 double, null_q975 double")


def holm(tests: DataFrame, p: str = "p", key: str = "test", family: int | None = None) -> DataFrame:
    """Step-down adjusted p: running maximum of min(1, (m - rank + 1) p).  The list of tests is short."""
    everything = Window.partitionBy()
    order = Window.orderBy(p, key)
    m = F.lit(family) if family else F.count("*").over(everything)
    ranked = tests.withColumns({"rank": F.row_number().over(order), "__m": m})
    raw = ranked.withColumn("__a", F.least(F.lit(1.0), (F.col("__m") - F.col("rank") + 1) * F.col(p)))
    return raw.withColumn("p_adjusted", F.max("__a").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__a", "__m")


def episodes(windows: DataFrame, alpha: float, p: str = "p_window") -> DataFrame:
    """Unions of overlapping or touching significant windows, each spoken for by its strongest."""
    placed = islands(windows.where(F.col(p) <= alpha), [], "start_us", "end_us", ["window_id"], name="episode_id")
    best = F.struct(-F.col("scan_z"), F.col("duration_us"), F.col("start_us"))
    return placed.groupBy("episode_id").agg(
        F.min_by("window_id", best).alias("representative_window_id"),
        F.max("scan_z").alias("scan_z"),
        F.min("start_us").alias("support_start_us"),
        F.max("end_us").alias("support_end_us"),
        F.count("*").alias("significant_window_count"),
    )


def scan(spark: SparkSession, counts: DataFrame, node_index: Sequence[int], edges: np.ndarray, pools: Sequence[Sequence[int]], simulations: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """The whole scan over eligible windows' counts."""
    permutations = seeded_permutations(pools, len(node_index), simulations, seed)
    return scan_statistics(permutation_scores(counts, node_index, edges, permutations), alpha)
