"""Signals, activity and the tables' rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake import checks, functions as fn, spec
from tremorlake.functions import signal
from tremorlake.operators import activity, merge, qc, sampling
from tremorlake.plans import signals
from tremorlake.sources import sinks, tables
from tremorlake.streaming import activity as streams


def test_overlap_does_not_duplicate_samples(spark):
    blocks = spark.createDataFrame([("a", 0, 0, [float(i) for i in range(10)]), ("b", 0, 8, [float(i) for i in range(8, 18)])], "file_name string, channel int, start_sample long, samples array<double>")
    wanted = spark.createDataFrame([(1, 6, 12, [0])], "request long, first long, last long, channels array<int>")
    got = activity.stitched(blocks, wanted, 16).first()
    assert got["samples"] == [float(i) for i in range(6, 13)]


def test_gauge_median_has_expected_units(spark):
    rows = [(1, c, [float(v)] * 10) for c, v in ((1, 2), (2, 4), (3, 6))]
    got = activity.gauge_metrics(spark.createDataFrame(rows, "request long, channel int, samples array<double>"), 10.0).first()
    assert got["rms_median"] == pytest.approx(4) and got["integral_median"] == pytest.approx(16)


def test_preprocessing_takes_off_a_line():
    x = np.stack([np.linspace(0, 5, 200), np.linspace(3, -2, 200)], 1)
    assert np.abs(signal.preprocess(x, 5000.0, None)).max() < 2e-12


def test_detrend_within_the_jvm(spark):
    got = spark.createDataFrame([([1.0, 3.0, 5.0, 7.0],)], "x array<double>").select(fn.detrend(F.col("x"))).first()[0]
    assert np.abs(got).max() < 1e-12


def test_samples_that_are_not_finite_are_refused():
    with pytest.raises(signal.SignalError):
        signal.preprocess(np.array([0.0, np.nan, 1.0]), 5000.0)
    with pytest.raises(signal.SignalError):
        signal.butterworth(4, 20.0, 3000.0, 5000.0)


def test_band_pass_keeps_the_band_without_delay():
    fs, t = 5000.0, np.arange(5000) / 5000
    kept = signal.zero_phase(np.sin(2 * np.pi * 200 * t)[:, None], signal.butterworth(4, 20.0, 2000.0, fs))[:, 0]
    assert np.abs(kept - np.sin(2 * np.pi * 200 * t))[500:-500].max() < 1e-2
    gone = signal.zero_phase(np.sin(2 * np.pi * 2 * t)[:, None], signal.butterworth(4, 20.0, 2000.0, fs))[:, 0]
    assert np.abs(gone)[500:-500].max() < 1e-2


def test_greedy_split_cuts_at_the_span(spark):
    rows = [(i, 1, i * 1_000_000, i * 1_000_000, i * 1_000_000 + 500_000, 5) for i in range(5)]
    placed = spark.createDataFrame(rows, "key long, component long, peak_us long, start_us long, end_us long, channel long")
    parts = {r["key"]: r["part"] for r in merge.greedy_split(placed).collect()}
    assert parts == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}


def test_empty_merge_gives_no_event(spark):
    p = spark.createDataFrame([], "key long, depth double, peak_us long, start_us long, end_us long, channel int, segment_id string, x_cm double, y_cm double, env array<double>, psd array<double>, score double")
    events, members = merge.merge_primitives(p)
    assert events.count() == 0 and members.count() == 0


def test_block_moments_merge_like_one_array(spark):
    x = np.random.default_rng(1).normal(1e6, 2, 300)
    rows = [(0, x[i : i + 70].tolist()) for i in range(0, 300, 70)]
    got = qc.block_moments(spark.createDataFrame(rows, "c long, a array<double>"), ["c"], "a").first()
    d = x - x.mean()
    assert got["variance"] == pytest.approx(x.var(), rel=1e-9)
    assert got["kurtosis"] == pytest.approx((d**4).mean() / (d**2).mean() ** 2, rel=1e-7)


def test_rules_and_settings(spark):
    df = spark.createDataFrame([(1, 0, 5, 3, 1.0), (1, 0, 1, 3, -1.0)], "k long, start_us long, peak_us long, end_us long, activity double")
    with pytest.raises(checks.DataError):
        checks.require(checks.violations(df, **checks.event_rules()))
    with pytest.raises(checks.DataError):
        checks.require(checks.duplicates(df, ["k"]))
    with pytest.raises(checks.DataError):
        checks.require_columns(df, ["z"])
    with pytest.raises(spec.SettingsError):
        spec.ScanSettings(alpha=2).checked()
    assert spec.deep_get({"a": {"b": 3}}, ("a", "b")) == 3 and spec.deep_get({}, ("a",), 1) == 1


def test_csv_with_a_byte_order_mark_and_layout_offset(spark, tmp_path):
    path = str(tmp_path / "layout.csv")
    sinks.write_small_csv(spark.createDataFrame([("3000", "seg", "1.5", "true"), ("3001", "seg", "", "no")], "channel string, segment_id string, x_cm string, listed string"), path)
    got = tables.read_csv(spark, path, "channel int, segment_id string, x_cm double, listed boolean", ["channel", "x_cm"])
    assert [tuple(r) for r in got.orderBy("channel").collect()] == [(3000, "seg", 1.5, True), (3001, "seg", None, False)]
    placed = tables.layout_with_offset(got, 3000, 10).orderBy("data_channel").collect()
    assert [(r["data_channel"], r["coordinate_valid"]) for r in placed] == [(0, True), (1, False)]
    assert tables.all_channels(tables.layout_with_offset(got, 3000, 10).drop("channel", "listed"), 4).count() == 4
    with pytest.raises(checks.DataError):
        tables.layout_with_offset(got, 0, 10)


def test_name_timestamps_and_location(spark):
    n = spark.createDataFrame([("x_2025-07-07T140654.123456789+08.h5",)], "name string").select(tables.name_timestamp_ns(F.col("name"))).first()[0]
    assert n == 1751897214 * 1_000_000_000 + 123456789
    records = spark.createDataFrame([("a", 0), ("b", 600_000_000_000)], "file_name string, start_ns long")
    times = spark.createDataFrame([(-1,), (5,), (600_000_000_001,), (9_000_000_000_000,)], "time_ns long")
    assert [r["file_name"] for r in tables.locate(times, records).orderBy("time_ns").collect()] == [None, "a", "b", None]


def test_manifest_and_snapshots(spark, tmp_path):
    sinks.write_manifest(spark, str(tmp_path / "m.json"), {"a": 1})
    assert tables.read_json(spark, str(tmp_path / "m.json")) == {"a": 1}
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 1 / 3)], "snapshot_us long, x_cm double, y_cm double, z_cm double, value double")
    sinks.write_snapshots(df, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()[0].startswith("1.0\t2.0\t3.0\t0.33333333333")


def test_streams(spark, tmp_path):
    rows = [(0, "2024-01-01 00:00:05", 1.0), (0, "2024-01-01 00:00:40", 2.0), (1, "2024-01-01 00:02:00", 4.0), (0, "2024-01-01 03:00:00", 1.0)]
    df = spark.createDataFrame(rows, "node long, t string, value double").select("node", F.col("t").cast("timestamp").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("minutes", streams.minute_activity(stream)), ("sessions", streams.island_sessions(stream.withColumnsRenamed({"ts": "start_time"}).withColumn("duration_s", F.lit(35))))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = {str(r["minute_time"])[11:16]: (r["event_count"], r["activity"]) for r in spark.table("minutes").collect()}
    assert got == {"00:00": (2, 3.0), "00:02": (1, 4.0)}
    assert spark.table("sessions").where("node = 0 and source_records = 2").count() == 1


def test_feature_tasks_hold_every_candidate(spark, tmp_path):
    e = spark.range(230).selectExpr("id AS event_id", "timestamp_ntz'2024-01-03 00:00:00' + make_dt_interval(0, 0, id) AS ts", "id % 7 AS user_id", "IF(id % 40 = 0, 'purchase', 'view') AS event_type", "IF(id % 40 = 0, 150.0D, 1.0D) AS value")
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = {r["task_class"]: (r["n"], r["ids"]) for r in signals.QUERIES["feature_tasks"](spark, str(tmp_path)).collect()}
    assert got["candidate"] == (230, 230)
    assert sum(n for k, (n, _) in got.items() if k != "candidate") == 12 * 6


def test_a_limit_of_feature_tasks_is_an_even_sample(spark):
    e = spark.range(9).selectExpr("id AS event_id", "id AS peak_us", "id AS channel")
    none = spark.createDataFrame([], "kind string, time_us long")
    tasks = lambda *limit: sorted(r["task_id"] for r in sampling.feature_tasks(e, none, e, *limit).collect())
    assert tasks(3) == ["candidate:0", "candidate:4", "candidate:8"]
    assert tasks() == [f"candidate:{i}" for i in range(9)]


def test_stitches_reach_the_last_vector_and_show_a_hole(spark, tmp_path):
    v = spark.range(600).where("id <> 300").selectExpr("id AS vec_id", "array_repeat(CAST(1 AS FLOAT), 64) AS embedding", "1 AS label")
    v.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["request"]: r for r in signals.QUERIES["stitched_read"](spark, str(tmp_path)).collect()}
    there = np.zeros(599 * 56 + 64)
    for i in range(600):
        if i != 300:
            there[i * 56 : i * 56 + 64] = 1
    want = {k: there[k * 97 : k * 97 + 100].sum() for k in range(-(-len(there) // 97))}
    assert {k: r["n"] for k, r in got.items()} == {k: n for k, n in want.items() if n}
    assert [k for k in sorted(got) if not got[k]["complete"]] == [k for k in want if want[k] < 100]


def choose(available, plan, seed):
    """Family quotas one time after the other."""
    import hashlib

    draw = lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest()
    lists = {f: sorted({k for g, k in available if g == f}, key=lambda k: (draw(k), k)) for f in plan}
    want, used, out = sum(plan.values()), set(), []
    for f in sorted(plan, key=lambda f: (len(lists[f]), f)):
        for k in [k for k in lists[f] if k not in used][: min(plan[f], want - len(out))]:
            used.add(k)
            out.append((f, k))
    moved = True
    while len(out) < want and moved:
        moved = False
        for f in plan:
            rest = [k for k in lists[f] if k not in used]
            if rest and len(out) < want:
                used.add(rest[0])
                out.append((f, rest[0]))
                moved = True
    pool = sorted(used)
    of = {k: f for f, k in out}
    for i in range(want - len(out) if pool else 0):
        k = pool[int(hashlib.md5(f"{seed}:again:{i}".encode()).hexdigest(), 16) % len(pool)]
        out.append((of[k], k))
    return sorted(out)


@pytest.mark.parametrize("plan", [{"a": 3, "b": 2}, {"a": 4, "b": 30, "c": 3}, {"a": 100, "b": 1, "z": 5}, {"z": 4}, {"a": 0}])
def test_family_quotas_fill_up_in_turn_and_then_again(spark, plan):
    from tremorlake.operators import sampling

    rows = [("a", k) for k in range(10)] + [("b", k) for k in range(5, 30)] + [("c", k) for k in (1, 2, 40)] + [("a", 3)]
    got = sampling.family_quotas(spark.createDataFrame(rows, "family string, time_us long"), plan, "family", "time_us", 7)
    assert sorted((r["family"], r["time_us"]) for r in got.collect()) == choose(rows, plan, 7)


def test_the_preferred_file_gives_all_it_has(spark):
    value = {"a": 0.0, "b": 100.0, "c": 200.0}
    spans = {"a": [(0, 9), (10, 19)], "b": [(6, 13), (14, 24)], "c": [(18, 40)]}
    rows = [(f, 0, s, [value[f] + i for i in range(s, e + 1)]) for f, own in spans.items() for s, e in own]
    blocks = spark.createDataFrame(rows, "file_name string, channel int, start_sample long, samples array<double>")
    wanted = spark.createDataFrame([(1, 2, 30, [0], "b"), (2, 2, 30, [0], "c"), (3, 2, 30, [0], None), (4, 8, 12, [0], "b"), (5, 2, 30, [0], "other")], "request long, first long, last long, channels array<int>, preferred string")
    got = {r["request"]: r["samples"] for r in activity.stitched(blocks, wanted, 16).collect()}
    in_order = sorted((s, e, f) for f, own in spans.items() for s, e in own)
    first = lambda chosen: [value[next(f for s, e, f in sorted(in_order, key=lambda x: x[2] != chosen) if s <= i <= e)] + i for i in range(2, 31)]
    assert got[1] == first("b") and got[2] == first("c") and got[3] == got[5] == first(None)
    assert got[4] == [108.0, 109.0, 110.0, 111.0, 112.0]
    plain = {r["request"]: r["samples"] for r in activity.stitched(blocks, wanted.drop("preferred"), 16).collect()}
    assert plain[1] == first(None)


def test_records_and_their_declared_band(spark):
    rows = [("f", 5000.0, 501, 3000, '{"bandpass_hz": [20, 2000]}'), ("g", 5000.0, 501, 3000, '{"bandpass_hz": [20.0, 2000.0], "x": 1}'), ("h", None, 501, 3001, '{"bandpass_hz": [20]}'), ("i", 4000.0, 501, 3000, None)]
    r = spark.createDataFrame(rows, "file_name string, fs double, channel_count int, start_channel int, p string").withColumn("band", tables.declared_band(F.col("p")))
    assert [x["band"] for x in r.orderBy("file_name").collect()] == [[20.0, 2000.0]] * 2 + [None] * 2
    got = {x["check"]: x["violations"] for x in tables.check_records(r, 5000.0, (20.0, 2000.0)).collect()}
    assert got == {"fs": 1, "channel_count": 0, "start_channel": 1, "fs_declared": 1, "fs_expected": 2, "band_declared": 2, "band_expected": 2}
    assert all(x["violations"] == 0 for x in tables.check_records(r.limit(0).drop("band")).collect())


def test_array_functions_take_time_by_their_length(spark):
    """Means and slopes are worked out once for an array and not for each of its elements."""
    import time

    x = F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.sin(i * F.col("id")) + i * 0.5)
    rows = spark.range(1, 11, 1, 1).select(x.alias("x")).localCheckpoint()
    began = time.perf_counter()
    c = F.col("x")
    got = rows.select(fn.detrend(c).alias("d"), fn.kurtosis_pearson(c).alias("k"), fn.support_fraction(F.slice(c, 1, 300), F.slice(c, 301, 300)).alias("s"), fn.temporal_concentration(c, 8).alias("t"), "x").collect()
    assert time.perf_counter() - began < 10
    for r in got:
        v = np.array(r["x"])
        i = np.arange(600)
        assert np.allclose(r["d"], v - np.polyval(np.polyfit(i, v, 1), i), atol=1e-8)
        f = np.sqrt((v.reshape(8, 75) ** 2).mean(1))
        assert np.isclose(r["t"], f.max() / f.mean()) and r["s"] == 0.0
