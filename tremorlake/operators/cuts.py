"""Groups cut greedily along an order, of any size: where a group ends follows from where it began.

The next cut behind a row depends on that row alone, whatever was cut before.  Rows are numbered in their order and
dealt into blocks of so many; a block, with the rows behind it that its last groups can reach, gives every row its
next cut and the first cut of its chain that lies outside the block.  These pointers are doubled over the few rows
that blocks point to, which says in log rounds where the chain enters each block, and every block then walks its
own part of it.  No task holds more than a block and its reach, however large a component is."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.operators.temporal import numbered
from tremorlake.sources.shared import cut

BLOCK_ROWS = 100_000

#: Rows of one component in order -> for each the position of the next cut, or their number where none is seen.
NextCut = Callable[[pd.DataFrame], np.ndarray]


def next_cuts(rows: pd.DataFrame, by: str, goes_on: tuple[object, int] | None, next_cut: NextCut) -> np.ndarray:
    """The number g of every row's next cut, -1 where its component ends first.  rows: in order of g, whole
    components but for the last one, of which goes_on tells the component and its last g."""
    g, names = rows["g"].to_numpy(), rows[by].to_numpy()
    out = np.full(len(rows), -1, dtype=np.int64)
    edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]])) if len(rows) else []
    for a, b in zip(edges, edges[1:], strict=False):
        further = goes_on is not None and names[a] == goes_on[0] and goes_on[1] > g[b - 1]
        if b - a == 1 and not further:
            continue
        at = next_cut(rows.iloc[a:b]) + a
        seen = at < b
        out[a:b][seen] = g[at[seen]]
        if further:  # what lies behind all that is seen is out of reach
            out[a:b][~seen] = g[b - 1] + 1
    return out


def exits(g: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The first g of each row's chain that lies behind the last one here, or -1."""
    first, last = int(g[0]), int(g[-1])
    out = following.copy()
    for i in range(len(g) - 1, -1, -1):
        if 0 <= out[i] <= last:
            out[i] = out[out[i] - first]
    return out


def entered(steps: DataFrame) -> DataFrame:
    """g of the rows at which chains enter a block, by doubling.  steps: g, exit, first."""
    edges = steps.where("exit >= 0").select("g", "exit", "first")
    targets = edges.select(F.col("exit").alias("target")).distinct()
    jumps = cut(edges.join(targets, F.col("g") == F.col("target"), "left").where("first OR target IS NOT NULL").select("g", F.col("exit").alias("to"), "first"))
    marked, n = cut(jumps.where("first").select(F.col("to").alias("g")).distinct()), -1
    jumps = jumps.select("g", "to")
    while True:
        now = marked.count()
        if now == n:
            return marked
        n = now
        marked = cut(marked.unionByName(marked.join(jumps, "g").select(F.col("to").alias("g"))).distinct())
        further = jumps.select(F.col("g").alias("to"), F.col("to").alias("end"))
        jumps = cut(jumps.join(further, "to").select("g", F.col("end").alias("to")))


def greedy_parts(rows: DataFrame, by: str, time: str, key: str, reach: int, columns: Sequence[str], next_cut: NextCut, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, by, part: parts of every component from 0, in the order of time and key.

    A row more than reach behind another one is never in its part.  next_cut reads time and the columns."""
    kinds = dict(rows.dtypes)
    names = list(dict.fromkeys([key, by, time, *columns]))
    placed = cut(numbered(rows.select(*names), [by, time, key], "g").withColumn("block", F.floor(F.col("g") / block_rows).cast("long")))
    last = F.max_by(F.struct(by, time, "g"), "g").alias("last")
    blocks = placed.groupBy("block").agg(last).select(F.col("block").alias("target"), F.col(f"last.{by}").alias("_by"), F.col(f"last.{time}").alias("_time"), F.col("last.g").alias("_g"))
    ends = placed.groupBy(by).agg(F.max("g").alias("last_g"))
    blocks = cut(blocks.join(ends, F.col("_by").eqNullSafe(F.col(by))).drop(by))
    # rows behind a block that its last component can reach, in buckets of the time
    width = max(1, reach)
    bucket = lambda c: F.floor(c / width).cast("long")
    open_ = blocks.where("last_g > _g").withColumn("_b", F.explode(F.sequence(bucket(F.col("_time")), bucket(F.col("_time") + reach))))
    behind = placed.withColumn("_b2", bucket(F.col(time))).join(open_, (F.col("_b2") == F.col("_b")) & F.col(by).eqNullSafe(F.col("_by")))
    behind = behind.where((F.col("g") > F.col("_g")) & (F.col(time) <= F.col("_time") + reach)).select(*names, "g", "block", "target")
    spread = placed.withColumn("target", F.col("block")).select(*names, "g", "block", "target").unionByName(behind)

    def step(group: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("g", ignore_index=True)
        own = (group["block"] == group["target"]).to_numpy()
        following = next_cuts(group, by, (info["_by"].iloc[0], int(info["last_g"].iloc[0])), next_cut)[own]
        mine = group[own]
        name = mine[by].to_numpy()
        g = mine["g"].to_numpy()
        return pd.DataFrame({key: mine[key].to_numpy(), by: name, "block": mine["block"].to_numpy(), "g": g, "following": following, "exit": exits(g, following)})

    steps = spread.groupBy("target").cogroup(blocks.groupBy("target")).applyInPandas(step, f"`{key}` {kinds[key]}, `{by}` {kinds[by]}, block long, g long, following long, exit long")
    begins = placed.groupBy(by).agg(F.min("g").alias("_first")).select("_first")
    steps = cut(steps.join(begins, F.col("g") == F.col("_first"), "left").select(key, by, "block", "g", "following", "exit", F.col("_first").isNotNull().alias("first")))
    gates = entered(steps).select(F.col("g").alias("gate"), F.floor(F.col("g") / block_rows).cast("long").alias("block"))

    def walk(group: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("g", ignore_index=True)
        g, following = group["g"].to_numpy(), group["following"].to_numpy()
        marks = np.zeros(len(g), dtype=np.int64)
        for at in [*g[group["first"].to_numpy()], *entries["gate"]]:
            while 0 <= at <= g[-1]:
                marks[at - g[0]] = 1
                at = following[at - g[0]]
        name = group[by].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        total = np.cumsum(marks)
        before = np.repeat(total[starts] - marks[starts], np.diff([*starts, len(g)]))
        return pd.DataFrame({key: group[key], by: name, "block": group["block"], "cuts": total - before})

    walked = cut(steps.groupBy("block").cogroup(gates.groupBy("block")).applyInPandas(walk, f"`{key}` {kinds[key]}, `{by}` {kinds[by]}, block long, cuts long"))
    earlier = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    base = walked.groupBy(by, "block").agg(F.max("cuts").alias("n")).select(F.col(by).alias("_by"), F.col("block").alias("_block"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    both = walked.join(base, (F.col("block") == F.col("_block")) & F.col(by).eqNullSafe(F.col("_by")))
    return both.select(key, by, (F.col("base") + F.col("cuts") - 1).cast("int").alias("part"))
