"""The detector and the six-scale features on a planted burst."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import signal
from tremorlake.operators import detect, features
from tremorlake.sources import waveform as blocks_of

FS = 500.0
RULES = detect.DetectorRules(scales=(0.1, 0.5), half=1, apart=2)


def waveform():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (2000, 16))
    x[900:960, 4:7] += 15 * np.sin(2 * np.pi * 60 * np.arange(60) / FS)[:, None]
    return x


def tables(spark):
    x = waveform()
    blocks = spark.createDataFrame([("f", 0, c, FS, x[:, c].tolist()) for c in range(16)], "file_name string, core long, channel long, fs double, samples array<double>")
    layout = spark.createDataFrame([(c, 2.0, "ring", "control" if c > 13 else "target") for c in range(16)], "channel long, burial_depth_cm double, geometry_type string, analysis_role string")
    return x, blocks, layout


def test_levels_equal_direct_rms():
    x = np.random.default_rng(1).normal(size=300)
    x[5] = np.nan
    clean = np.where(np.isfinite(x), x, 0)
    clean = clean - np.median(clean)
    at, width = detect.window_starts(300, 100.0, 0.2)
    assert np.allclose(detect.levels(x, 100.0, (0.2,))[0], [np.sqrt((clean[a : a + width] ** 2).mean()) for a in at])


def test_a_burst_is_one_primitive_of_its_sensor(spark):
    _, blocks, layout = tables(spark)
    f = detect.sensor_features(blocks, layout, RULES)
    model = f.groupBy("scale", "channel").agg(*[F.median(n).alias(f"m_{n}") for n in detect.FEATURES], *[(F.stddev(n) / 3).alias(f"s_{n}") for n in detect.FEATURES])
    scored = f.join(model, ["scale", "channel"])
    for k, n in enumerate(detect.FEATURES):
        scored = scored.withColumn(f"z{k}", (F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}"))
    found = detect.detections(scored, detect.DetectorRules(scales=(0.1, 0.5), expanded=9.0))
    top = found.where("scale = 0.1").orderBy(F.desc("score")).first()
    assert 4 <= top["channel"] <= 6
    assert 900 - 50 <= top["window"] * 0.025 * FS <= 960
    signed = detect.signatures(found, blocks, RULES).collect()
    assert len(signed) == found.count()
    for r in signed:
        assert np.linalg.norm(r["env"]) == pytest.approx(1) and sum(r["psd"]) == pytest.approx(1)


def test_features_point_at_the_burst(spark):
    x, _, _ = tables(spark)
    rules = features.FeatureRules(scales=(0.1, 0.2), context=2.0, low=5.0, high=240.0, bands=8)
    middle = 930
    rows = [("t", c, "gauge" if 4 <= c <= 6 else "control" if c > 13 else "distant", FS, -1.0, x[middle - 500 : middle + 500, c].tolist()) for c in range(16)]
    got = features.extract(spark.createDataFrame(rows, "task_id string, channel long, role string, fs double, first_s double, samples array<double>"), rules).collect()
    assert len(got) == 2
    for r in got:
        assert abs(r["best_offset_s"]) <= 0.06 and r["locality"] > 1.5 and r["support"] == 1.0
        assert r["correlation"] > 0.9 and sum(r["psd"]) == pytest.approx(1) and 0 <= r["entropy"] <= 1


def test_a_task_without_a_gauge_has_no_features(spark):
    rows = [("t", 1, "distant", FS, -1.0, [0.0] * 1000)]
    assert features.extract(spark.createDataFrame(rows, "task_id string, channel long, role string, fs double, first_s double, samples array<double>")).count() == 0


def test_levels_take_the_median_of_core_and_pad(spark):
    x = np.arange(30.0)
    rows = spark.createDataFrame([("f", 0, 1, 10.0, x[10:20].tolist(), x[:10].tolist(), [100.0] * 9)], "file_name string, core long, channel long, fs double, samples array<double>, before array<double>, after array<double>")
    got = detect.block_levels(rows, detect.DetectorRules(scales=(0.5,))).first()["levels"][0]
    middle = np.median(np.concatenate([x[:20], [100.0] * 9]))
    at, width = detect.window_starts(10, 10.0, 0.5)
    assert np.allclose(got, [np.sqrt(((x[10 + a : 10 + a + width] - middle) ** 2).mean()) for a in at])


def test_neighbourhoods_equal_sensor_by_sensor(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), float(rng.choice([2, 20])), str(rng.choice(["ring", "line"])), "Control" if c % 11 == 0 else "target") for c in range(0, 60, 2)]
    layout = spark.createDataFrame(rows, "channel long, burial_depth_cm double, geometry_type string, analysis_role string")
    rules = detect.DetectorRules(half=2, apart=6)
    around = detect.Neighbourhood.of(layout, rules)
    channels = np.array([c for c in range(60) if c % 13 != 5])
    level = rng.random((7, len(channels))) + 0.1
    local, distant, control, support = around.levels(level, channels)
    targets = [r for r in rows if r[3] == "target"]
    own = {t[0]: [i for i, c in enumerate(channels) if abs(c - t[0]) <= 2] for t in targets}
    for j, t in enumerate(targets):
        assert np.allclose(local[:, j], np.median(level[:, own[t[0]]], 1))
        peers = [p for p in targets if p[1:3] == t[1:3] and abs(p[0] - t[0]) > 6]
        if len(peers) < 4:
            peers = [p for p in targets if abs(p[0] - t[0]) > 12]
        far = np.median([np.median(level[:, own[p[0]]], 1) for p in peers], 0)
        assert np.allclose(distant[:, j], far)
        assert np.allclose(support[:, j], (level[:, own[t[0]]] > 1.1 * far[:, None]).mean(1))
    assert np.allclose(control[:, 0], np.median(level[:, [i for i, c in enumerate(channels) if c % 22 == 0]], 1))


def test_roles_fall_back_to_all_far_targets(spark):
    rows = [(c, 2.0 if c < 30 else 20.0, "Ring", "target" if c % 10 else "leadin_control") for c in range(50)]
    layout = spark.createDataFrame(rows, "channel long, burial_depth_cm double, geometry_type string, analysis_role string")
    tasks = spark.createDataFrame([("many", 5, 2.0, "ring"), ("few", 1, 20.0, "line")], "task_id string, channel long, burial_depth_cm double, geometry_type string")
    got = features.roles(tasks, layout, 50).collect()
    of = lambda t, r: sorted(x["channel"] for x in got if x["task_id"] == t and x["role"] == r)
    assert of("many", "gauge") == list(range(1, 10)) and of("few", "gauge") == list(range(6))
    assert of("many", "distant") == [c for c in range(14, 30) if c % 10]
    assert of("few", "distant") == [c for c in range(18, 50) if c % 10]
    assert of("few", "control") == [0, 10, 20, 30, 40]


def test_anchors_and_context(spark):
    times = [0, 10_000, 30_000, 30_001, 60_001, 60_002, 500_000]
    tasks = spark.createDataFrame([("f", i, t) for i, t in enumerate(times)] + [("g", 9, 30_000)], "file_name string, task long, time_us long")
    got = {r["task"]: r["anchor_us"] for r in features.anchors(tasks).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 30_001, 4: 30_001, 5: 60_002, 6: 500_000, 9: 30_000}
    one = spark.createDataFrame([(1.0,), (5.0,), (9.9,)], "s double").select(*features.context_bounds((F.col("s") * 1e9).cast("long"), F.lit(0), F.lit(1000), F.lit(100.0)))
    assert [tuple(r) for r in one.collect()] == [(0, 250), (350, 650), (840, 1000)]


def test_halo_reaches_over_short_blocks(spark):
    rows = [("e", "f", 1, k * 2, 1.0, [float(2 * k), float(2 * k + 1)]) for k in range(5)] + [("e", "f", 1, 10, 1.0, [10.0])]
    b = spark.createDataFrame(rows, "experiment string, file_name string, channel long, block_start_ns long, fs double, samples array<float>")
    for pad in (1, 3, 5, 50):
        for r in blocks_of.with_halo(b, pad).collect():
            at = r["block_start_ns"]
            assert r["before"] == [float(v) for v in range(max(0, at - pad), at)]
            assert r["after"] == [float(v) for v in range(at + len(r["samples"]), min(11, at + len(r["samples"]) + pad))]


def test_the_dataset_and_its_axes_are_found():
    shapes = {"default": ((3000, 501), "f"), "names": ((501, 2), "S"), "times": ((3000,), "i")}
    assert blocks_of.find_dataset(shapes) == "default"
    with pytest.raises(ValueError):
        blocks_of.find_dataset(shapes | {"other": ((2, 2), "i")})
    assert blocks_of.channel_axis((3000, 501)) == 1 and blocks_of.channel_axis((501, 3000)) == 0
    assert blocks_of.channel_axis((400, 501), 501) == 1 and blocks_of.channel_axis((501, 400), 501) == 0
    with pytest.raises(ValueError):
        blocks_of.channel_axis((3000, 400), 501)


def test_shapes_of_windows_against_direct_sums():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(83, 4))
    x[:, 3] = 2.0
    c = np.corrcoef(x[:, :3], rowvar=False)
    assert signal.coherence(x) == pytest.approx(np.median(np.abs([c[0, 1], c[0, 2], c[1, 2]])))
    assert signal.coherence(x[:7]) == 0.0 and signal.coherence(x[:, 2:]) == 0.0
    k = []
    for col in x[:, :3].T:
        n, d = len(col), col - col.mean()
        g = (d**4).mean() / (d**2).mean() ** 2 - 3
        k.append((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))
    assert signal.excess(x) == pytest.approx(np.median(k)) and signal.excess(x[:3]) == 0.0
    env, bands = signal.signature(x, 5000.0)
    d = x - np.median(x, 0)
    frames = np.array([np.sqrt((d[10 * i : 10 * i + 10] ** 2).mean()) for i in range(8)])
    assert np.allclose(env, frames / np.linalg.norm(frames))
    t = np.median(d, 1) - np.median(d, 1).mean()
    f = np.arange(42) * 5000 / 83
    power = np.array([abs(sum(t * np.exp(-2j * np.pi * j * np.arange(83) / 83))) ** 2 / 83**2 * (2 if j else 1) for j in range(42)])
    e = np.geomspace(20, 2000, 13)
    direct = np.maximum([power[(f >= e[i]) & (f < e[i + 1])].sum() for i in range(12)], 1e-20)
    assert np.allclose(bands, direct / direct.sum())
