"""A study from events to corrected episodes, and the commands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tremorlake.__main__ import main
from tremorlake.plans import study
from tremorlake.spec import ExperimentSpec, ScanSettings

S = 1_000_000


def inputs(spark):
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(i, 20.0 * (i % 5), 20.0 * (i // 5), 0.0, f"g{i % 2}") for i in range(25)], "node long, x_cm double, y_cm double, z_cm double, permutation_group string")
    rows, e = [], 0
    for i in range(25):
        for t in rng.integers(0, 3600, 40):
            rows.append((e, i, int(t) * S, int(t) * S + S // 2, int(t) * S + S, float(rng.random())))
            e += 1
        if i in (6, 7, 11, 12):
            for t in range(1200, 1500, 4):
                rows.append((e, i, t * S, t * S + S, t * S + 2 * S, 1.0))
                e += 1
    return spark.createDataFrame(rows, "event_id long, node long, start_us long, peak_us long, end_us long, activity double"), nodes


def test_scan_finds_the_planted_patch(spark):
    events, nodes = inputs(spark)
    spec = ExperimentSpec("a", 0, 3600 * S, ScanSettings(simulations=199, window_minutes=(5, 10), family=1))
    found = study.run_scan(spec, events, nodes)
    assert found.p_global <= 0.05
    best = found.windows.orderBy(F.desc("scan_z")).first()
    assert best["start_us"] < 1500 * S and best["end_us"] > 1200 * S
    adjusted, episodes = study.correct_studies({"a": found}, 0.05)
    assert adjusted.count() == 1 and episodes["a"].count() >= 1


def test_scan_command(spark, tmp_path):
    events, nodes = inputs(spark)
    events.write.parquet(str(tmp_path / "e"))
    nodes.write.parquet(str(tmp_path / "n"))
    assert main(["scan", "--study", "a", str(tmp_path / "e"), str(tmp_path / "n"), "0", str(3600 * S), "--simulations", "19", "--output", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "studies")).count() == 1
    assert (tmp_path / "out" / "report.md").exists()


def test_activity_reads_the_gauge(spark):
    blocks = spark.createDataFrame([("f", c, 0, [float(c)] * 100) for c in range(3, 8)], "file_name string, channel long, start_sample long, samples array<double>")
    events = spark.createDataFrame([(1, 5, 10, 29)], "event_id long, channel long, first long, last long")
    layout = spark.createDataFrame([(c,) for c in (4, 5, 7)], "channel long")
    got = study.run_activity(blocks, events, layout, 20.0).first()
    assert (got["rms_median"], got["gauge_channels"], got["samples"]) == (5.0, 3, 20)


def test_screening_votes(spark):
    rng = np.random.default_rng(1)
    rows, key = [], 0
    for scale in range(3):
        for kind in ("stable_rain", "personnel"):
            for _ in range(40):
                rows.append((key, None, scale, kind, *map(float, rng.normal(0, 1, 2))))
                key += 1
        for event, shift in ((1, 0.0), (2, 9.0)):
            rows.append((key, event, scale, "candidate", shift, shift))
            key += 1
    tasks = spark.createDataFrame(rows, "key long, event_id long, scale int, task_class string, a double, b double")
    got = {r["event_id"]: r for r in study.run_screening(tasks, ["a", "b"]).collect()}
    assert got[1]["novel_scale_count"] == 0 and got[2]["max_consecutive"] == 3


def test_quality_study(spark):
    rows = [("f", c, i, 0.0 if c == 3 else float((i * (c % 3 + 2)) % 7)) for c in range(10) for i in range(50)]
    samples = spark.createDataFrame(rows, "file string, channel long, sample long, v double")
    layout = spark.range(10).select(F.col("id").alias("channel"), F.lit("g").alias("qc_group"))
    classed, summary, files = study.run_quality(samples, layout)
    assert classed.where("channel = 3").first()["qc_class"] == "HARD_BAD"
    assert summary.where("fixed_bad").count() == 1 and files.first()["quality_status"] == "WARN"
