"""Signal types of a table in many small partitions."""

from __future__ import annotations

import random

from tremorlake.operators import ml


def test_tasks_of_a_fit_go_by_rows_and_not_by_partitions(spark):
    rng = random.Random(3)
    rows = [(i, 9.0 * (i % 2) + rng.random(), rng.random()) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, a double, b double").repartition(40)
    placed, scores = ml.signal_types(events, ["a", "b"], ["a"], most=2, starts=1)
    assert placed.rdd.getNumPartitions() == 1
    assert {r["event_id"]: r["signal_type"] for r in placed.collect()} == {i: "Type B" if i % 2 else "Type A" for i in range(400)}
    assert [k for k, _ in scores] == [2]
