"""Greedy groups in blocks against one plain pass."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tremorlake.operators import cuts, features, merge

SCHEMA = "key long, component long, peak_us long, start_us long, end_us long, channel long"


def plain(rows, rules):
    out, now = {}, None
    for key, component, _, s, e, c in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if component != now:
            now, part = component, 0
            start, end, low, high = s, e, c, c
        elif max(end, e) - min(start, s) > rules.span or max(high, c) - min(low, c) > rules.channel_span:
            part += 1
            start, end, low, high = s, e, c, c
        else:
            start, end, low, high = min(start, s), max(end, e), min(low, c), max(high, c)
        out[key] = (component, part)
    return out


def detections(seed, sizes, gap, channels):
    rng, rows, key = random.Random(seed), [], 0
    for component, n in enumerate(sizes):
        at = rng.randrange(1000)
        for _ in range(n):
            at += rng.choice([0, 0, 1, rng.randrange(gap), rng.randrange(20 * gap) if rng.random() < 0.02 else 0])
            rows.append((key, component * 7, at, at - rng.randrange(30), at + rng.randrange(60), rng.randrange(channels)))
            key += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, sizes, gap, channels, block", [(1, [700], 9, 30, 16), (2, [1, 1, 300, 2, 1, 90, 40, 1], 40, 5, 11), (3, [500, 500], 2, 3, 1), (4, [60] * 9, 30, 40, 100_000)])
def test_a_component_over_many_blocks_is_cut_as_in_one_pass(spark, seed, sizes, gap, channels, block):
    rows, rules = detections(seed, sizes, gap, channels), merge.MergeRules(span=200, channel_span=20)
    out = merge.greedy_split(spark.createDataFrame(rows, SCHEMA).repartition(5), rules, block)
    assert {r["key"]: (r["component"], r["part"]) for r in out.collect()} == plain(rows, rules)


def test_peaks_outside_their_detections(spark):
    rows = [(i, 1, i * 10, i * 10 + 500, i * 10 + 520, 1) for i in range(80)] + [(90 + i, 1, i * 7, -900, -880 + i, 1) for i in range(40)]
    rules = merge.MergeRules(span=200, channel_span=20)
    out = merge.greedy_split(spark.createDataFrame(rows, SCHEMA), rules, 8)
    assert {r["key"]: (r["component"], r["part"]) for r in out.collect()} == plain(rows, rules)


def test_no_rows(spark):
    assert merge.greedy_split(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block", [3, 100_000])
def test_anchors_of_many_tasks(spark, block):
    rng = random.Random(block)
    tasks = [(i, rng.choice(["a", "b", "b", None]), rng.randrange(4000)) for i in range(400)]
    want = {}
    for name in ("a", "b", None):
        anchor = None
        for i, _, t in sorted((x for x in tasks if x[1] == name), key=lambda x: x[2]):
            anchor = t if anchor is None or t - anchor > 50 else anchor
            want[i] = anchor
    out = features.anchors(spark.createDataFrame(tasks, "task long, file_name string, time_us long"), 50, block)
    assert {r["task"]: r["anchor_us"] for r in out.collect()} == want


def test_a_large_component_runs_in_many_tasks(spark):
    """300,000 detections of one component: parts are of one span, and blocks of 10,000 rows."""
    rows = spark.range(300_000).select(F.col("id").alias("key"), F.lit(5).cast("long").alias("component"), (F.col("id") * 10).alias("peak_us"), (F.col("id") * 10).alias("start_us"), (F.col("id") * 10 + 1).alias("end_us"), F.lit(1).cast("long").alias("channel"))
    rules = merge.MergeRules(span=95, channel_span=9)
    out = merge.greedy_split(rows, rules, 10_000)
    # ten detections span 91, eleven 101
    assert out.where(F.col("part") != F.expr("key div 10")).count() == 0 and out.count() == 300_000
