"""Whole studies: the spatial scan from events to corrected episodes, event activity, screening, quality control."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.checks import DataError, event_rules, require, unmatched, violations
from tremorlake.operators import activity, inference, qc, robust, screening, spatial, temporal
from tremorlake.sources.shared import cut
from tremorlake.spec import ExperimentSpec

SECOND = 1_000_000


@dataclass(frozen=True)
class ScanResult:
    merged: DataFrame
    membership: DataFrame
    windows: DataFrame
    episodes: DataFrame
    edges: DataFrame
    pools: DataFrame
    p_global: float


def run_scan(spec: ExperimentSpec, events: DataFrame, nodes: DataFrame) -> ScanResult:
    """events: event_id, node, start_us, peak_us, end_us, activity.  nodes: node, x_cm, y_cm, z_cm, permutation_group."""
    s = spec.scan.checked()
    require(violations(events, **event_rules()).unionByName(unmatched(events, nodes, ["node"], "node_listed")))
    inside = events.where(F.col("peak_us").between(spec.start_us, spec.end_us))
    merged, membership = temporal.merge_overlapping(inside)
    merged = cut(merged)
    edges = cut(spatial.radius_graph(nodes, s.radius_cm))
    pools = spatial.permutation_pools(nodes, merged, "permutation_group")
    windows = temporal.candidate_windows(events.sparkSession, spec.start_us, spec.end_us, [round(m * 60 * SECOND) for m in s.window_minutes], s.step_s * SECOND)
    windows = cut(windows)  # read five times
    counts = cut(temporal.window_counts(merged, windows, spec.end_us, s.step_s * SECOND))
    sensors = nodes.select("node", "permutation_group").orderBy("node").collect()  # the sensor dimension
    index = [r["node"] for r in sensors]
    ok = cut(temporal.eligibility(counts, windows, len(index), s.min_records, s.min_active))
    where = {v: i for i, v in enumerate(index)}
    pairs = np.array([(where[r[0]], where[r[1]]) for r in edges.select("node_i", "node_j").collect()])
    groups: dict[str, list[int]] = {}
    for r in sensors:
        groups.setdefault(r["permutation_group"], []).append(where[r["node"]])
    usable = counts.join(ok.where("eligible").select("window_id"), "window_id", "left_semi")
    told = cut(inference.scan(events.sparkSession, usable, index, pairs, [groups[g] for g in sorted(groups)], s.simulations, s.seed, s.alpha))
    first = told.first()
    full = cut(windows.join(ok, "window_id").join(told, "window_id", "left"))
    return ScanResult(merged, membership, full, inference.episodes(full.where("p_window is not null"), s.alpha), edges, pools, first["p_global"] if first else 1.0)


def run_scans(studies: dict[str, tuple[ExperimentSpec, DataFrame, DataFrame]], at_once: int = 4) -> dict[str, ScanResult]:
    """run_scan of each study (spec, events, nodes), some at once: their small stages fill the cluster together."""
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(studies)))) as pool:
        running = {name: pool.submit(run_scan, *told) for name, told in studies.items()}
        return {name: job.result() for name, job in running.items()}


def correct_studies(results: dict[str, ScanResult], alpha: float) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Holm over the studies' global p, and each study's episodes at its own step's level."""
    any_result = next(iter(results.values()))
    spark = any_result.windows.sparkSession
    adjusted = inference.holm(spark.createDataFrame([(k, r.p_global) for k, r in results.items()], "test string, p double"))
    told = adjusted.collect()  # a row a study
    steps = {r["test"]: len(results) - r["rank"] + 1 for r in told}
    allowed = {r["test"]: r["p_adjusted"] <= alpha for r in told}
    out = {}
    for k, r in results.items():
        study = r.windows.where("p_window is not null").withColumn("p_study", F.when(F.lit(allowed[k]), F.least(F.lit(1.0), F.col("p_window") * steps[k])).otherwise(1.0))
        out[k] = inference.episodes(study, alpha, "p_study")
    return adjusted, out


def run_activity(blocks: DataFrame, events: DataFrame, layout: DataFrame, fs: float, half: int = 4, width: int = 60_000) -> DataFrame:
    """Gauge metrics of every event from its samples.  events: event_id, channel, first, last (sample numbers)."""
    around = spatial.gauge_channels(events.select(F.col("event_id").alias("request"), "channel", "first", "last"), layout, half)
    asked = around.groupBy("request", "first", "last").agg(F.sort_array(F.collect_set("gauge_channel")).alias("channels"))
    read = activity.stitched(blocks, asked, width)
    require(activity.complete(read).agg(F.count("*").alias("violations")).select(F.lit("samples_missing").alias("check"), "violations"))
    return activity.gauge_metrics(read, fs).withColumnRenamed("request", "event_id")


def select_events(events: DataFrame, policy: str, cutoff_us: int | None = None, most: int | None = None) -> DataFrame:
    """The policy's events that peak before the cutoff; with most, the first so many of them (for trials).

    events: event_id, peak_us and what the policy asks for: label, manual_label or include."""
    label = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    rules = {
        "auto_effective": lambda: label("label") == "effective_candidate",
        "auto_effective_plus_uncertain": lambda: label("label").isin("effective_candidate", "uncertain"),
        "manual_effective": lambda: label("manual_label") == "effective",
        "include_flag": lambda: label("include").isin("true", "1", "yes", "y"),
    }
    if policy not in rules:
        raise DataError(f"unknown policy {policy}: one of {', '.join(rules)}")
    kept = events.where(rules[policy]())
    if cutoff_us is not None:
        kept = kept.where(F.col("peak_us") < cutoff_us)
    return kept if most is None else kept.orderBy("peak_us", "event_id").limit(most)


@dataclass(frozen=True)
class ActivityResult:
    events: DataFrame
    minutes: DataFrame
    snapshots: DataFrame
    positions: DataFrame


def accumulate(events: DataFrame, positions: DataFrame, start_us: int, end_us: int, snapshot_minutes: int = 1, unit: str = "microstrain_per_second", exclude_before_us: int | None = None) -> ActivityResult:
    """Activity by event, minute, snapshot and position.  events: event_id, position, peak_us, activity; positions: position.

    The unit is a label of the result and changes no number."""
    minute = 60 * SECOND
    first = start_us // minute * minute
    excluded = F.lit(False) if exclude_before_us is None else F.col("minute_us") < exclude_before_us
    inside = events.where((F.col("peak_us") >= start_us) & (F.col("peak_us") < end_us))
    counted = inside if exclude_before_us is None else inside.where(F.col("peak_us") >= -(-exclude_before_us // minute) * minute)
    minutes = temporal.spined_activity(inside, first, (end_us - 1) // minute * minute, minute, excluded)
    snaps = temporal.snapshots(counted, positions, "position", first, end_us, snapshot_minutes * minute)
    total = counted.groupBy("position").agg(F.count("*").alias("event_count"), F.sum("activity").alias("activity"))
    whole = positions.join(total, "position", "left").na.fill({"event_count": 0, "activity": 0.0}).withColumn("unit", F.lit(f"({unit})^2 s"))
    running = temporal.cumulative(counted, ["peak_us", "event_id"], {"position_activity": "activity"}, ["position"])
    return ActivityResult(running, minutes, snaps, whole)


def run_refinement(tasks: DataFrame, features: Sequence[str], detail: Sequence[str], k: int = 10, class_k: int = 5, quantile: float = 0.995) -> DataFrame:
    """run_screening from raw features: each is first put on the scale of the references of its scale and detail."""
    references = cut(tasks.where("task_class <> 'candidate'"))
    full = tasks
    for f in features:
        full = robust.standardize(full, references, "scale", detail, f, f"{f}_z")
    return run_screening(full, [f"{f}_z" for f in features], k, class_k, quantile)


def peaks_by_start(windows: DataFrame, value: str = "scan_z") -> DataFrame:
    """start_us, the largest value over all durations that start there."""
    return windows.groupBy("start_us").agg(F.max(value).alias(value))


def frames(windows: DataFrame, critical: float | None, duration_us: int = 600 * SECOND) -> dict[str, DataFrame]:
    """What figures of a saved scan show: one duration's statistic with its null, in time, and the scan's maxima."""
    middle = (F.col("start_us") + F.col("end_us")) / 2
    upper = F.lit(None).cast("double") if critical is None else F.col("center") + critical * F.col("scale")
    series = windows.where(F.col("duration_us") == duration_us).select(middle.alias("time_us"), "observed", "center", "scale", upper.alias("upper"), *[c for c in ("null_q025", "null_q975") if c in windows.columns])
    return {"series": series, "maxima": peaks_by_start(windows)}


def run_screening(tasks: DataFrame, features: Sequence[str], k: int = 10, class_k: int = 5, quantile: float = 0.995) -> DataFrame:
    """Per scale: candidates against the pooled noise references; then the votes of each event.

    tasks: key, event_id, scale, task_class, and the features, already standardised."""
    # read for every scale, and several times in each
    ready = cut(tasks.select("key", "event_id", "scale", "task_class", F.array(*[F.col(f).cast("double") for f in features]).alias("vector")))
    scored = None
    for (scale,) in ready.select("scale").distinct().orderBy("scale").collect():  # a handful of scales
        own = ready.where(F.col("scale") == scale)
        c = own.where("task_class = 'candidate'").select("key", "vector", F.col("task_class").alias("label"))
        r = own.where("task_class <> 'candidate'").select("key", "vector", F.col("task_class").alias("label"))
        part = screening.noise_distances(c, r, k, class_k, quantile).where("not is_reference").join(own.select("key", "event_id", "scale"), "key")
        scored = part if scored is None else scored.unionByName(part)
    return screening.event_votes(scored)


def run_quality(samples: DataFrame, layout: DataFrame, limits: qc.Limits = qc.Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classified channels of every file, the channels' summary and the files'.  samples: file, channel, sample, v."""
    moments = qc.channel_moments(samples, ["file", "channel"], ["sample"], "v")
    classed = cut(qc.classify(qc.flag_channels(moments, "file", limits), layout, "file", "channel", "qc_group", limits))
    return classed, qc.channel_summary(classed, "channel", F.lit(False), limits), qc.file_summary(classed, "file")
