"""From waveform blocks to a screened catalog, in stages that are kept: a run that stops goes on where it was.

Detection is made file by file, so of a changed record only that file's detections are made again; models are
fitted once for given settings and stay; merging and screening follow the detections that they were made of."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators import detect, features, merge, robust, sampling, screening, temporal
from tremorlake.operators.activity import stitched
from tremorlake.plans.study import run_refinement
from tremorlake.sources import incremental
from tremorlake.sources.cache import StageLog, cached
from tremorlake.sources.shared import cut
from tremorlake.sources.sinks import stable_digest

SECOND = 1_000_000
PRIMITIVES = "file_name STRING, core BIGINT, scale DOUBLE, channel BIGINT, window INT, score DOUBLE, secondary DOUBLE, strict BOOLEAN, support DOUBLE, common_mode BOOLEAN, active_fraction DOUBLE, windows BIGINT, start_us BIGINT, peak_us BIGINT, end_us BIGINT, correlation DOUBLE, env ARRAY<DOUBLE>, psd ARRAY<DOUBLE>"
MODELS = "scale DOUBLE, channel BIGINT, " + ", ".join(f"center_{n} DOUBLE, spread_{n} DOUBLE" for n in detect.FEATURES)
EVENTS = "event_id STRING, start_us BIGINT, peak_us BIGINT, end_us BIGINT, channel BIGINT, primitive_count BIGINT, source_channels STRING, max_score DOUBLE"
#: Features of tasks that are numbers.
COMPARED = ("local_gain", "nonlocal_gain", "locality", "control_gain", "support", "correlation", "entropy", "js_to_flank", "concentration")
TASKS = "task_id STRING, task_class STRING, event_id STRING, scale DOUBLE, burial_depth_cm DOUBLE, geometry_type STRING, " + ", ".join(f"{c} DOUBLE" for c in COMPARED)
CATALOG = EVENTS + ", novel_scale_count BIGINT, max_consecutive INT, max_ratio DOUBLE, median_ratio DOUBLE, best_scale DOUBLE, best_nearest_class STRING, coherent BOOLEAN, local BOOLEAN, operation BOOLEAN, human BOOLEAN, label STRING, score DOUBLE"


@dataclass(frozen=True)
class CatalogSettings:
    """The detector's, the merging's and the features' rules, and how references are sampled."""

    detector: detect.DetectorRules = field(default_factory=detect.DetectorRules)
    merging: merge.MergeRules = field(default_factory=merge.MergeRules)
    tasks: features.FeatureRules = field(default_factory=features.FeatureRules)
    calibration_times: int = 48
    calibration_step_us: int = 10 * SECOND
    edge_us: int = 5 * SECOND
    reference_times: int = 60
    reference_sensors: int = 12
    shrink_us: int = 0
    k: int = 10
    class_k: int = 5
    quantile: float = 0.995
    seed: int = 0
    #: The features that tasks are compared by.
    compared: tuple[str, ...] = COMPARED


@dataclass(frozen=True)
class Inputs:
    """blocks: WAVEFORM_BLOCK.  records: file_name, start_us, end_us.  layout: channel, burial_depth_cm,
    geometry_type, analysis_role, segment_id, x_cm, y_cm.  nuisance: kind, start_us, end_us."""

    blocks: DataFrame
    records: DataFrame
    layout: DataFrame
    nuisance: DataFrame


def stored_units(blocks: DataFrame) -> DataFrame:
    """unit, fingerprint of each record by the stored files that hold its blocks; no sample is read."""
    parts = blocks.select("file_name", F.concat_ws("|", "_metadata.file_name", F.col("_metadata.file_size").cast("string"), F.col("_metadata.file_modification_time").cast("string")).alias("part")).distinct()
    return parts.groupBy(F.col("file_name").alias("unit")).agg(F.md5(F.concat_ws(";", F.sort_array(F.collect_set("part")))).alias("fingerprint"))


def cores(blocks: DataFrame) -> DataFrame:
    """A core is a block's time."""
    return blocks.select("file_name", F.col("block_start_ns").alias("core"), F.col("channel").cast("long").alias("channel"), "fs", F.col("samples").cast("array<double>").alias("samples"))


def models(given: Inputs, s: CatalogSettings) -> DataFrame:
    """Centre and spread of every feature, scale and sensor over the blocks of sampled calm times."""
    grid = sampling.time_grid(given.records, s.calibration_step_us, s.edge_us).select("time_us").distinct()
    calm = sampling.outside(grid, given.nuisance, 600 * SECOND).orderBy(sampling.draw("time_us", seed=s.seed), "time_us").limit(s.calibration_times)
    spans = given.blocks.groupBy("file_name", "block_start_ns").agg(F.max(F.size("samples") / F.col("fs")).alias("seconds"))
    spans = spans.select("file_name", "block_start_ns", F.expr("block_start_ns div 1000").alias("start_us"), (F.expr("block_start_ns div 1000") + F.floor(F.col("seconds") * SECOND) - 1).alias("end_us"))
    chosen = temporal.stab(calm, spans, "time_us", "start_us", "end_us", 60 * SECOND).select("file_name", "block_start_ns").distinct()
    rows = cut(detect.sensor_features(cores(given.blocks.join(chosen, ["file_name", "block_start_ns"])), given.layout, s.detector))
    placed = cut(rows.join(given.layout.select("channel", "burial_depth_cm", "geometry_type"), "channel"))
    out = None
    for name in detect.FEATURES:
        own = robust.calibration(placed, ["scale", "burial_depth_cm", "geometry_type"], "channel", name).select("scale", "channel", F.col("center").alias(f"center_{name}"), F.col("spread").alias(f"spread_{name}"))
        out = own if out is None else out.join(own, ["scale", "channel"])
    return out


def primitives(given: Inputs, fitted: DataFrame, todo: DataFrame, s: CatalogSettings) -> DataFrame:
    """The detections of the files in todo, with their signatures and times."""
    blocks = cut(cores(given.blocks.join(todo.select(F.col("unit").alias("file_name")), "file_name")))
    scored = detect.sensor_features(blocks, given.layout, s.detector).join(fitted, ["scale", "channel"], "left")
    for i, name in enumerate(detect.FEATURES):
        scored = scored.withColumn(f"z{i}", F.coalesce(F.try_divide(F.col(name) - F.col(f"center_{name}"), F.col(f"spread_{name}")), F.lit(0.0)))
    found = cut(detect.detections(scored, s.detector))
    signed = detect.signatures(found, blocks, s.detector).withColumnRenamed("target", "channel")
    start = F.expr("core div 1000") + F.rint(F.col("window") * F.greatest(F.lit(0.025), F.col("scale") / 4) * SECOND).cast("long")
    width = F.rint(F.col("scale") * SECOND).cast("long")
    timed = found.withColumns({"start_us": start, "peak_us": start + F.floor(width / 2), "end_us": start + width})
    return timed.join(signed, ["file_name", "core", "scale", "window", "channel"]).withColumn("unit", F.col("file_name"))


def merged(found: DataFrame, layout: DataFrame, s: CatalogSettings) -> DataFrame:
    """Events of all detections that aren't in common mode, numbered by time."""
    places = layout.select("channel", F.col("burial_depth_cm").alias("depth"), "segment_id", "x_cm", "y_cm")
    rows = found.where("NOT common_mode").join(places, "channel")
    keyed = cut(temporal.numbered(rows.select("file_name", "core", "scale", "channel", "window", "depth", "segment_id", "x_cm", "y_cm", "start_us", "peak_us", "end_us", "score", "env", "psd"), ["file_name", "core", "scale", "channel", "window"], "key"))
    events, _ = merge.merge_primitives(keyed, s.merging)
    return merge.numbered_events(events, "EV", ["peak_us", "representative"])


def tasks(given: Inputs, events: DataFrame, s: CatalogSettings) -> DataFrame:
    """Features of every event and of the references: sampled nuisance times at sampled sensors."""
    targets = given.layout.where(~F.coalesce(F.lower("analysis_role").contains("control"), F.lit(False)))
    times = sampling.admissible_times(given.records, given.nuisance, s.calibration_step_us, s.edge_us, s.shrink_us, 600 * SECOND)
    sensors = sampling.round_robin(targets, ["burial_depth_cm", "geometry_type"], "channel", s.reference_sensors, s.seed)
    asked = sampling.feature_tasks(events, sampling.quota_sample(times, "kind", "time_us", s.reference_times, s.seed), sensors)
    asked = cut(asked.join(given.layout.select("channel", "burial_depth_cm", "geometry_type"), "channel"))
    cable = (given.layout.agg(F.max("channel")).first()[0] or 0) + 1
    parts = cut(features.roles(asked, given.layout, cable, s.tasks))
    fs = given.blocks.agg(F.max("fs")).first()[0] or 1.0
    half = round(s.tasks.context * fs / 2)
    middle = F.rint(F.col("time_us") / SECOND * fs).cast("long")
    requests = asked.join(parts.groupBy("task_id").agg(F.sort_array(F.collect_set("channel")).alias("channels")), "task_id")
    requests = requests.select(F.col("task_id").alias("request"), (middle - half).alias("first"), (middle + half - 1).alias("last"), "channels")
    clock = given.blocks.select("file_name", F.col("channel").cast("long").alias("channel"), F.rint(F.col("block_start_ns") / 1e9 * fs).cast("long").alias("start_sample"), "samples")
    whole = stitched(clock, requests, max(2 * half, 1)).where(F.size("samples") == F.col("last") - F.col("first") + 1)
    samples = whole.select(F.col("request").alias("task_id"), "channel", "samples").join(parts, ["task_id", "channel"])
    told = features.extract(samples.select("task_id", "channel", "role", F.lit(fs).alias("fs"), F.lit(-half / fs).alias("first_s"), "samples"), s.tasks)
    named = asked.select("task_id", "task_class", "burial_depth_cm", "geometry_type", F.when(F.col("task_class") == "candidate", F.expr("substring(task_id, 11)")).alias("event_id"))
    return told.join(named, "task_id")


def screened(events: DataFrame, measured: DataFrame, nuisance: DataFrame, s: CatalogSettings) -> DataFrame:
    """The catalog: votes over scales, coherence and locality above the references' quantiles, operations, label."""
    references = measured.where("task_class <> 'candidate'")
    votes = run_refinement(measured.withColumn("key", F.concat_ws("@", "task_id", F.col("scale").cast("string"))), s.compared, ["burial_depth_cm", "geometry_type"], s.k, s.class_k, s.quantile)
    limit = lambda c, q: robust.exact_quantile(references, [], c, q, f"q_{c}").first()[0]
    coherence, locality = limit("correlation", 0.75), limit("locality", 0.9)
    own = measured.where("task_class = 'candidate'").groupBy("event_id").agg((F.max("correlation") >= F.lit(coherence)).alias("coherent"), (F.max("locality") >= F.lit(locality)).alias("local"))
    full = events.join(votes.drop("flags"), "event_id").join(own, "event_id")
    full = temporal.interval_first(full, nuisance.withColumn("ord", F.col("start_us")), "event_id", "peak_us", "start_us", "end_us", "ord", "kind", 600 * SECOND)
    human = F.col("best_nearest_class").isin("personnel", "pumping") & (F.col("max_ratio") <= 1)
    full = full.withColumns({"operation": F.col("kind").isNotNull(), "human": human, **{c: F.coalesce(c, F.lit(False)) for c in ("coherent", "local")}})
    label = screening.screening_label("novel_scale_count", "max_consecutive", F.col("coherent"), F.col("local"), F.col("operation"), F.col("human"))
    score = screening.screening_score("max_ratio", "novel_scale_count", "max_consecutive", F.col("coherent"), F.col("local"), F.lit(False))
    return full.withColumns({"label": label, "score": score}).drop("kind")


def run_catalog(spark: SparkSession, given: Inputs, units: DataFrame, output: str, s: CatalogSettings = CatalogSettings()) -> tuple[DataFrame, DataFrame, StageLog]:
    """The catalog, what was detected anew (unit, reason), and the stages' times.  units: of stored_units, or made by
    the caller from what it knows of its records."""
    log, told = StageLog(), asdict(s)
    whole = {"settings": told, "layout": _digest(given.layout), "nuisance": _digest(given.nuisance)}
    with log.stage("models"):
        fitted = cached(spark, f"{output}/models/{stable_digest(whole)}", whole, MODELS, lambda: models(given, s))
    rules: dict[str, Column] = {"own_file": F.col("file_name") == F.col("unit"), "ordered": (F.col("start_us") <= F.col("peak_us")) & (F.col("peak_us") <= F.col("end_us"))}
    with log.stage("detection"):
        found = incremental.refresh(spark, f"{output}/primitives", units, whole, PRIMITIVES, lambda todo: primitives(given, fitted, todo, s), rules)
    version = whole | {"units": units.agg(F.md5(F.concat_ws(";", F.sort_array(F.collect_list(F.concat_ws(":", "unit", "fingerprint"))))).alias("v")).first()[0]}
    with log.stage("merging"):
        events = cached(spark, f"{output}/events", version, EVENTS, lambda: merged(found.table, given.layout, s))
    with log.stage("features"):
        measured = cached(spark, f"{output}/tasks", version, TASKS, lambda: tasks(given, events, s))
    with log.stage("screening"):
        catalog = cached(spark, f"{output}/catalog", version, CATALOG, lambda: screened(events, measured, given.nuisance, s))
    return catalog, found.made, log


def _digest(table: DataFrame) -> str:
    """Of a dimension table's rows in any order."""
    return str(table.agg(F.count("*"), F.sum(F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)"))).first())
