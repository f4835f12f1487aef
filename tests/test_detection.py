"""From waveforms to a catalog: planted bursts are found, a stopped run goes on, a changed file alone is made again."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import detect, features, merge
from tremorlake.plans import detection
from tremorlake.sources import incremental

FS, SECONDS, BLOCK, CHANNELS = 200.0, 60, 10, 14
#: file, second, channel of bursts, of which the last lies in a time of pumping.
BURSTS = [(0, 12.4, 4), (1, 33.7, 6), (2, 47.2, 5), (1, 8.3, 4)]
SETTINGS = detection.CatalogSettings(
    detector=detect.DetectorRules(scales=(0.1, 0.2, 0.4), half=1, apart=2, expanded=6.0, strict=9.0),
    merging=merge.MergeRules(),
    tasks=features.FeatureRules(scales=(0.1, 0.2, 0.4), context=2.0, low=5.0, high=90.0, bands=8, half=1, apart=2, peers=2),
    calibration_step_us=2_000_000, edge_us=2_000_000, reference_times=12, reference_sensors=4, k=5, class_k=3, quantile=0.99, compared=("local_gain", "locality", "correlation"),
)


def record(number, bursts, seed=0):
    rng = np.random.default_rng(100 * number + seed)
    x = rng.normal(0, 1, (int(SECONDS * FS), CHANNELS))
    for file, second, channel in bursts:
        if file == number:
            a = int(second * FS)
            x[a : a + 40, channel - 1 : channel + 2] += 14 * np.sin(2 * np.pi * 40 * np.arange(40) / FS)[:, None]
    return x


def blocks_of(spark, files):
    rows = []
    for number, x in files.items():
        for at in range(0, len(x), int(BLOCK * FS)):
            rows += [("e", f"f{number}", c, int((number * SECONDS + at / FS) * 1e9), FS, x[at : at + int(BLOCK * FS), c].tolist()) for c in range(CHANNELS)]
    return spark.createDataFrame(rows, "experiment string, file_name string, channel int, block_start_ns long, fs double, samples array<float>")


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("waves")
    for number in range(3):
        blocks_of(spark, {number: record(number, BURSTS)}).coalesce(1).write.parquet(f"{folder}/f{number}")
    layout = spark.createDataFrame([(c, 2.0, "ring", "control" if c > 11 else "target", "s", float(10 * c), 0.0) for c in range(CHANNELS)], "channel long, burial_depth_cm double, geometry_type string, analysis_role string, segment_id string, x_cm double, y_cm double")
    records = spark.createDataFrame([(f"f{n}", n * SECONDS * 1_000_000, (n + 1) * SECONDS * 1_000_000 - 1) for n in range(3)], "file_name string, start_us long, end_us long")
    nuisance = spark.createDataFrame([("pumping", 62_000_000, 78_000_000), ("stable_rain", 20_000_000, 40_000_000), ("stable_rain", 130_000_000, 150_000_000)], "kind string, start_us long, end_us long")
    read = lambda: spark.read.option("recursiveFileLookup", "true").parquet(str(folder))
    return folder, lambda: detection.Inputs(read(), records, layout, nuisance)


def run(spark, given, out):
    inputs = given()
    catalog, made, log = detection.run_catalog(spark, inputs, detection.stored_units(inputs.blocks), out, SETTINGS)
    return catalog, {r["unit"]: r["reason"] for r in made.collect()}, log


def test_bursts_become_events_and_stages_are_kept(spark, given, tmp_path, monkeypatch):
    folder, inputs = given
    out = str(tmp_path / "out")
    # the run stops while tasks are made
    whole = detection.tasks
    monkeypatch.setattr(detection, "tasks", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(spark, inputs, out)
    monkeypatch.setattr(detection, "tasks", whole)
    asked = []
    for stage in ("models", "primitives", "merged"):
        monkeypatch.setattr(detection, stage, lambda *_, stage=stage: asked.append(stage))
    catalog, made, log = run(spark, inputs, out)
    monkeypatch.undo()
    assert not asked and not made and [x["state"] for x in log.stages] == ["done"] * 5
    rows = catalog.collect()
    for file, second, channel in BURSTS:
        middle = (file * SECONDS + second + 0.1) * 1e6
        near = [r for r in rows if abs(r["peak_us"] - middle) < 300_000 and abs(r["channel"] - channel) <= 1]
        assert near, (file, second)
        best = max(near, key=lambda r: r["max_score"])
        assert best["operation"] == (second == 8.3)
        assert best["label"] == ("nuisance_like" if second == 8.3 else "effective_candidate"), best
    assert len({r["event_id"] for r in rows}) == len(rows)
    assert sum(r["label"] == "effective_candidate" for r in rows) <= 6
    # another record of the second file: it alone is detected again, and its burst moves
    moved = [(f, s, c) if (f, s) != (1, 33.7) else (1, 51.5, 9) for f, s, c in BURSTS]
    blocks_of(spark, {1: record(1, moved, seed=0)}).coalesce(1).write.mode("overwrite").parquet(f"{folder}/f1")
    changed = lambda: {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "out" / "primitives").rglob("data/unit=*/*.parquet")}
    before = changed()
    monkeypatch.setattr(detection, "tasks", lambda *_: 1 / 0)  # the later stages follow as before
    with pytest.raises(ZeroDivisionError):
        run(spark, inputs, out)
    monkeypatch.undo()
    after = changed()
    assert {u for u in after if after[u] != before.get(u)} == {"unit=f1"}
    again = spark.read.parquet(f"{out}/events/data").collect()
    assert any(abs(r["peak_us"] - 111.6e6) < 300_000 for r in again) and not any(abs(r["peak_us"] - 93.8e6) < 200_000 and r["max_score"] > 20 for r in again)
    # the kept detections are those of a run from the start
    fitted = spark.read.parquet(next(str(p) for p in (tmp_path / "out" / "models").iterdir()) + "/data")
    fresh = detection.primitives(inputs(), fitted, detection.stored_units(inputs().blocks), SETTINGS)
    kept = incremental.refresh(spark, f"{out}/primitives", detection.stored_units(inputs().blocks), {"settings": detection.asdict(SETTINGS), "layout": detection._digest(inputs().layout), "nuisance": detection._digest(inputs().nuisance)}, detection.PRIMITIVES, lambda _: 1 / 0)
    columns = ["file_name", "core", "scale", "channel", "window", "score"]
    assert sorted(map(tuple, kept.table.select(columns).collect())) == sorted(map(tuple, fresh.select(columns).collect())) and kept.made.count() == 0
