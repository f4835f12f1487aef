"""Queries and oracles of signals, merging, quality control, activity and sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake import checks, functions as fn
from tremorlake.functions import signal
from tremorlake.operators import activity, merge, qc, sampling
from tremorlake.plans.das import DAS, DAY, HOUR, MINUTE, NODES, T0, das, nodes, table

FS = 64.0
BAND_EDGES = (1.0, 4.0, 8.0, 16.0, 32.5)
BUCKET = 6 * HOUR


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a window of 64 samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def js_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's absolute values as shares against those of its class's first vector."""
    w = windows(spark, sf_dir).withColumn("p", F.transform("x", lambda v: F.abs(v)))
    first = w.groupBy("label").agg(F.min_by("p", "vec_id").alias("q"))
    return w.join(F.broadcast(first), "label").select("vec_id", F.round(fn.js_distance(F.col("p"), F.col("q")), 6).alias("js"))


def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fn.normalised(F.transform("x", lambda v: F.abs(v)))
    return windows(spark, sf_dir).withColumn("p", p).select("vec_id", F.round(fn.entropy(F.col("p")), 6).alias("entropy"))


def abs_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median absolute correlation of consecutive vectors within groups of nine: a gauge of nine channels."""
    w = windows(spark, sf_dir).withColumn("g", F.expr("vec_id div 9"))
    a, b = w.select("g", F.col("vec_id").alias("i"), F.col("x").alias("a")), w.select("g", F.col("vec_id").alias("j"), F.col("x").alias("b"))
    pairs = a.join(b, "g").where("i < j").select("g", F.abs(fn.correlation(F.col("a"), F.col("b"))).alias("c"))
    return pairs.groupBy("g").agg(F.round(F.median("c"), 6).alias("correlation"))


def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = signal.band_fractions("x", FS, np.array(BAND_EDGES))
    out = windows(spark, sf_dir).select("vec_id", shares.alias("s"))
    return out.select("vec_id", *[F.round(F.col("s")[i], 6).alias(f"band_{i}") for i in range(len(BAND_EDGES) - 1)])


def linear_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows(spark, sf_dir).select("vec_id", F.posexplode(fn.detrend(F.col("x"))).alias("i", "v"))
    return out.select("vec_id", "i", F.round("v", 6).alias("v"))


def sliding_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows(spark, sf_dir).select("vec_id", F.posexplode(fn.window_rms(F.col("x"), 16, 8)).alias("i", "r"))
    return out.select("vec_id", "i", F.round("r", 6).alias("rms"))


def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return windows(spark, sf_dir).select("vec_id", F.round(fn.temporal_concentration(x, 8), 6).alias("concentration"), F.round(fn.kurtosis_pearson(x), 5).alias("kurtosis"), F.round(fn.support_fraction(F.slice(x, 1, 9), F.slice(x, 10, 55)), 6).alias("support"))


def packed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir).withColumn("packed", F.concat_ws(";", "node", "event_type", F.col("event_id") % 7, F.lit(" 12 "), F.lit("")))
    return e.select("event_id", F.concat_ws(";", fn.parse_ints(F.col("packed"))).alias("ints"), fn.truthy(F.when(F.col("event_id") % 2 == 0, " Yes ").otherwise("off")).alias("flag"))


def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred, detrended and band-passed windows; a recursive filter has no SQL form."""
    @F.pandas_udf("array<double>")
    def clean(column: pd.Series) -> pd.Series:
        return pd.Series([signal.preprocess(a, FS, (2.0, 20.0))[:, 0] for a in column])

    return windows(spark, sf_dir).select("vec_id", clean("x").alias("x"))


def primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections: time in quarter hours for seconds, envelopes and spectra from the id."""
    e = das(spark, sf_dir)
    i = F.col("event_id")
    env = F.array(*[((i * (k + 3)) % 17).cast("double") for k in range(8)])
    psd = F.array(*[(1 + (i * (k + 5)) % 13).cast("double") for k in range(12)])
    return e.select(
        i.alias("key"),
        (F.col("node") % 4).alias("depth"),
        F.col("peak_us"),
        "start_us",
        "end_us",
        F.col("node").alias("channel"),
        F.concat(F.lit("seg"), F.col("node") % 5).alias("segment_id"),
        F.when(F.col("node") % 11 != 0, ((F.col("node") % 10) * 20).cast("double")).alias("x_cm"),
        (F.expr("node div 10") * 20).cast("double").alias("y_cm"),
        env.alias("env"),
        psd.alias("psd"),
        F.col("activity").alias("score"),
    )


RULES = merge.MergeRules(gap=HOUR, channels=8, distance=45.0, envelope=0.4, spectrum=0.15, span=8 * HOUR, channel_span=16)


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.similarity_pairs(primitives(spark, sf_dir), RULES)


def gauge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.gauge_pairs(primitives(spark, sf_dir), 10 * MINUTE, 8)


def similarity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = primitives(spark, sf_dir)
    return merge.label_components(p, merge.similarity_pairs(p, RULES)).select("key", "component")


def similarity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.numbered_events(merge.merge_primitives(primitives(spark, sf_dir), RULES)[0], "EV", ["peak_us", "representative"])


def batched_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_in_batches(primitives(spark, sf_dir), 2 * DAY, 9 * HOUR, RULES, T0)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples of a channel (part of the supplier) within a file (return flag)."""
    t = table(spark, sf_dir, "lineitem")
    v = F.when(F.col("l_orderkey") % 97 == 0, F.lit(None)).when(F.col("l_suppkey") % 13 == 0, F.lit(5.0)).otherwise(F.col("l_quantity") - 20)
    return t.select(F.col("l_returnflag").alias("file"), (F.col("l_suppkey") % 40).alias("channel"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", v.cast("double").alias("v"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.channel_moments(samples(spark, sf_dir), ["file", "channel"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "v", -19.0, 29.5)


def qc_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = ["file", "channel", "sample_count", "finite_count"]
    return moments(spark, sf_dir).select(*whole, *[F.round(c, 6).alias(c) for c in ("mean", "std", "rms", "kurtosis", "nonfinite_fraction", "zero_fraction", "saturation_fraction", "flat_fraction", "difference_rms", "max_jump")])


def qc_layout(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(F.col("id").alias("channel"), F.concat(F.lit("group_"), F.col("id") % 3).alias("qc_group"))


LIMITS = qc.Limits(saturation=0.05, std_z=2.0, kurtosis=2.2, jump=3.0, nonfinite=0.012)


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = qc.flag_channels(moments(spark, sf_dir), "file", LIMITS)
    return qc.classify(flagged, qc_layout(spark), "file", "channel", "qc_group", LIMITS)


def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(spark, sf_dir).select("file", "channel", "qc_group", "bad_reasons", F.concat_ws(";", "hard_reasons").alias("hard_reasons"), F.concat_ws(";", "review_reasons").alias("review_reasons"), "qc_class", F.round("std_z", 4).alias("std_z"), F.round("group_z", 4).alias("group_z"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.channel_summary(classed(spark, sf_dir), "channel", F.col("file") == "N", LIMITS)


def qc_channel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("review_fraction", "median_rms", "median_std")})


def qc_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qc.group_summary(summary(spark, sf_dir), qc_layout(spark), "channel", "qc_group")
    return out.withColumns({c: F.round(c, 6) for c in ("valid_rate", "median_rms")})


def qc_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.file_summary(classed(spark, sf_dir), "file").withColumn("mean_nonfinite", F.round("mean_nonfinite", 8))


def block_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each class merged from its vectors' own."""
    out = qc.block_moments(windows(spark, sf_dir), ["label"], "x")
    return out.select("label", "n", F.round("mean", 8).alias("mean"), F.round("variance", 8).alias("variance"), F.round("kurtosis", 5).alias("kurtosis"))


def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir).select("event_id", F.concat(F.lit("Dir/F"), "event_id").alias("path"), F.concat(F.lit("F"), "event_id").alias("name"))
    m = das(spark, sf_dir).where("event_id % 3 = 0").select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("DIR/f"), "event_id")).otherwise("elsewhere").alias("path"), F.concat(F.lit("f"), "event_id").alias("name"), "event_type")
    return qc.with_metadata(e, m, "path", "name").select("event_id", F.col("metadata.event_type").alias("event_type"))


def told_stitches(s: DataFrame) -> DataFrame:
    return s.select("request", F.size("samples").cast("long").alias("n"), F.round(fn.total(F.col("samples")), 6).alias("total"), (F.size("samples") == 100).alias("complete"))


def stitched_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of 100 samples every 97, from the first sample of the table's vectors to the last."""
    w = windows(spark, sf_dir)
    blocks = w.select(F.concat(F.lit("f"), "vec_id").alias("file_name"), F.lit(0).alias("channel"), (F.col("vec_id") * 56).alias("start_sample"), F.col("x").alias("samples"))
    last = w.agg(F.max("vec_id")).first()[0]
    requests = spark.range(0 if last is None else (last * 56 + 63) // 97 + 1).select(F.col("id").alias("request"), (F.col("id") * 97).alias("first"), (F.col("id") * 97 + 99).alias("last"), F.array(F.lit(0)).alias("channels"))
    return told_stitches(activity.stitched(blocks, requests, 1024))


def gauge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows(spark, sf_dir).select(F.expr("vec_id div 9").alias("request"), (F.col("vec_id") % 9).alias("channel"), F.col("x").alias("samples"))
    out = activity.gauge_metrics(w, FS)
    return out.withColumns({c: F.round(c, 6) for c in ("rms_median", "rms_min", "rms_max", "integral_median", "integral_sum")})


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir).select(F.expr(f"peak_us div {DAY}").alias("day"), "node", "activity")
    return activity.rollup(e, "day", "node", "activity")


def activity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolled(spark, sf_dir).withColumn("total", F.round("total", 4))


def activity_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.invariants(das(spark, sf_dir), rolled(spark, sf_dir), "activity")


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir)
    report = checks.violations(e, **checks.event_rules(), type_known=F.col("event_type").isin("view", "click"))
    return report.unionByName(checks.duplicates(e, ["node"])).unionByName(checks.unmatched(e, nodes(spark, sf_dir).where("node % 2 = 0"), ["node"], "node_listed"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording each day, from its first event to its last one."""
    return das(spark, sf_dir).groupBy(F.expr(f"peak_us div {DAY}").alias("day")).agg(F.min("peak_us").alias("start_us"), F.max("peak_us").alias("end_us"))


def strong(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """Spans of the strong effective events, their kind by the node."""
    e = das(spark, sf_dir).where((F.col("label") == "effective_candidate") & (F.col("activity") > least))
    return e.select(F.concat(F.lit("kind_"), F.col("node") % 4).alias("kind"), "start_us", "end_us")


def reference_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.admissible_times(files(spark, sf_dir), strong(spark, sf_dir, 100), 10 * MINUTE, 5 * MINUTE, 2 * MINUTE, BUCKET)


def calibration_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 48 times a stage, away from the strongest events."""
    grid = sampling.time_grid(files(spark, sf_dir), 10 * MINUTE, 5 * MINUTE).select("time_us").distinct()
    free = sampling.outside(grid, strong(spark, sf_dir, 250), BUCKET).withColumn("stage", F.expr(f"(time_us - {T0}) div {5 * DAY}"))
    w = Window.partitionBy("stage").orderBy(sampling.draw("time_us"), "time_us")
    return free.withColumn("r", F.row_number().over(w)).where("r <= 48").select("stage", "time_us")


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_sample(reference_grid(spark, sf_dir), "kind", "time_us", 50, 7).select("kind", "time_us")


def sensor_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(nodes(spark, sf_dir), ["burial_depth_cm", "geometry_type"], "node", 13).select("node")


def family_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.family_quotas(reference_grid(spark, sf_dir), {"kind_0": 20, "kind_1": 400, "kind_2": 30, "kind_3": 10}, "kind", "time_us", 3).select("kind", "time_us")


def early_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir).withColumn("stratum", F.col("node") % 5)
    return sampling.early_references(e, T0, T0 + 3 * DAY, ["stratum"], 9, 40).select("event_id")


def feature_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir).select("event_id", "peak_us", F.col("node").alias("channel"))
    times = sampling.quota_sample(reference_grid(spark, sf_dir), "kind", "time_us", 12, 1)
    sensors = sampling.round_robin(nodes(spark, sf_dir), ["stratum"], "node", 6).select(F.col("node").alias("channel"))
    return sampling.feature_tasks(e, times, sensors).groupBy("task_class").agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("ids"), F.sum("channel").alias("channels"))


def row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the table's rows in order of their key, for cache signatures: 256 buckets of md5, folded."""
    e = das(spark, sf_dir)
    own = F.md5(F.concat_ws("|", "event_id", "node", "peak_us", "event_type"))
    per = e.select(F.substring(own, 1, 2).alias("b"), own.alias("h")).groupBy("b").agg(F.md5(F.concat_ws("", F.sort_array(F.collect_list("h")))).alias("h"), F.count("*").alias("n"))
    return per.agg(F.md5(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]))).alias("digest"), F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (js_distance, spectral_entropy, abs_correlation, band_power, linear_detrend, sliding_rms, concentration, packed_lists, preprocessed, similarity_pairs, gauge_pairs, similarity_components, similarity_merge, batched_merge, qc_moments, qc_flags, qc_channel_summary, qc_group_summary, qc_file_summary, block_kurtosis, metadata_join, stitched_read, gauge_metrics, activity_rollup, activity_invariants, integrity, reference_grid, calibration_times, quota_sample, sensor_round_robin, family_sample, early_references, feature_tasks, row_digest)}

X = "w AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
LONG = "l AS (SELECT vec_id, label, i - 1 AS i, x[i] AS v FROM w, range(1, 65) t(i))"
PRIM = """p AS (SELECT event_id AS key, node % 4 AS depth, peak_us, start_us, end_us, node AS channel, 'seg' || (node % 5) AS segment_id,
    CASE WHEN node % 11 <> 0 THEN CAST((node % 10) * 20 AS DOUBLE) END AS x_cm, CAST((node // 10) * 20 AS DOUBLE) AS y_cm,
    list_transform(range(8), lambda k: CAST((event_id * (k + 3)) % 17 AS DOUBLE)) AS env, list_transform(range(12), lambda k: CAST(1 + (event_id * (k + 5)) % 13 AS DOUBLE)) AS psd FROM das)"""
PAIRS = f"""cand AS (SELECT a.key AS a, b.key AS b, a.env AS ea, b.env AS eb, list_transform(a.psd, lambda v: v / list_sum(a.psd)) AS pa, list_transform(b.psd, lambda v: v / list_sum(b.psd)) AS pb
    FROM p a JOIN p b ON a.depth = b.depth AND (a.peak_us < b.peak_us OR (a.peak_us = b.peak_us AND a.key < b.key)) AND b.peak_us - a.peak_us <= {HOUR}
    AND abs(a.channel - b.channel) <= 8 AND (a.segment_id = b.segment_id OR a.x_cm IS NULL OR b.x_cm IS NULL OR sqrt((a.x_cm - b.x_cm) ** 2 + (a.y_cm - b.y_cm) ** 2) <= 45)
    AND greatest(a.end_us, b.end_us) - least(a.start_us, b.start_us) <= {8 * HOUR}),
cc AS (SELECT a, b, corr(x, y) AS c, sqrt(greatest(sum(0.5 * u * ln(2 * u / (u + v)) + 0.5 * v * ln(2 * v / (u + v))), 0)) AS js FROM (
    SELECT a, b, unnest(list_concat(ea, [NULL, NULL, NULL, NULL])) AS x, unnest(list_concat(eb, [NULL, NULL, NULL, NULL])) AS y, unnest(pa) AS u, unnest(pb) AS v FROM cand) GROUP BY a, b),
pairs AS (SELECT a, b FROM cc WHERE coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0) >= 0.4 OR js <= 0.15)"""
SAMPLES = """s AS (SELECT l_returnflag AS file, l_suppkey % 40 AS channel, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_suppkey % 13 = 0 THEN 5.0 ELSE l_quantity - 20 END AS v FROM lineitem),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY file, channel ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS d FROM s),
m AS (SELECT file, channel, count(*) AS sample_count, count(v) AS finite_count, avg(v) AS mean, stddev_pop(v) AS std, sqrt(avg(v * v)) AS rms, kurtosis_pop(v) + 3 AS kurtosis,
    1 - count(v) / count(*) AS nonfinite_fraction, count(*) FILTER (WHERE v = 0) / count(*) AS zero_fraction, count(*) FILTER (WHERE v <= -19 OR v >= 29.5) / count(*) AS saturation_fraction,
    coalesce(count(*) FILTER (WHERE d = 0) / nullif(count(d), 0), 1) AS flat_fraction, sqrt(avg(d * d)) AS difference_rms, coalesce(max(abs(d)), 0) AS max_jump FROM d GROUP BY ALL)"""


def _z(source: str, keys: str, name: str, at_least: int) -> str:
    return f"""{source}_1 AS (SELECT *, median(log_std) OVER (PARTITION BY {keys}) AS m1, count(*) OVER (PARTITION BY {keys}) AS n1 FROM {source}),
{source}_2 AS (SELECT *, median(abs(log_std - m1)) OVER (PARTITION BY {keys}) AS d1 FROM {source}_1),
{name} AS (SELECT * EXCLUDE (m1, n1, d1), CASE WHEN n1 >= {at_least} AND d1 > 0 THEN 0.67448975 * (log_std - m1) / d1 ELSE 0 END AS {name}_v FROM {source}_2)"""


def _reasons(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL)"


HARD = (("nonfinite_fraction > 0.012", "NONFINITE"), ("zero_fraction > 0.99", "ZERO_OR_DEAD"), ("saturation_fraction > 0.05", "SATURATED"), ("flat_fraction > 0.99", "FLATLINE"), ("coalesce(std = 0, true)", "NO_VARIANCE"))
CLASSED = f"""lm AS (SELECT *, log10(greatest(coalesce(std, 0), 2.2250738585072014e-308)) AS log_std, 'group_' || (channel % 3) AS qc_group FROM m),
{_z("lm", "file", "fz", 3)}, {_z("fz", "file, qc_group", "gz", 8)},
c AS (SELECT *, {_reasons(*HARD, ("std > 0 AND fz_v < -2", "LOW_NOISE_OUTLIER"), ("std > 0 AND fz_v > 2", "HIGH_NOISE_OUTLIER"), ("kurtosis > 2.2", "IMPULSIVE_KURTOSIS"), ("std > 0 AND max_jump / std > 3", "ABRUPT_JUMP"))} AS bad,
    {_reasons(*HARD)} AS hard, {_reasons(("gz_v < -2", "LOW_STD_WITHIN_LAYOUT_GROUP"), ("gz_v > 2", "HIGH_STD_WITHIN_LAYOUT_GROUP"), ("kurtosis > 2.2", "HIGH_KURTOSIS_REVIEW"), ("std > 0 AND max_jump / std > 3", "ABRUPT_JUMP_REVIEW"))} AS review FROM gz)"""
SUMMARY = """cs AS (SELECT channel, count(*) AS files, count(*) FILTER (WHERE len(hard) > 0) AS hard_bad_files, count(*) FILTER (WHERE len(hard) > 0) / count(*) >= 0.5 AS fixed_bad,
    array_to_string(list_sort(list_distinct(flatten(list(hard)))), ';') AS hard_reasons, count(*) FILTER (WHERE file = 'N') AS stable_files,
    CASE WHEN stable_files > 0 THEN count(*) FILTER (WHERE file = 'N' AND len(review) > 0) / stable_files ELSE count(*) FILTER (WHERE len(review) > 0) / count(*) END AS review_fraction,
    median(rms) AS median_rms, median(std) AS median_std FROM c GROUP BY channel)"""
GRID = f"""fl AS (SELECT min(peak_us) AS fs, max(peak_us) AS fe FROM das GROUP BY peak_us // {DAY}),
grid AS (SELECT DISTINCT unnest(range(fs + {5 * MINUTE}, fe - {5 * MINUTE} + 1, {10 * MINUTE})) AS time_us FROM fl),
strong AS (SELECT 'kind_' || (node % 4) AS kind, activity, start_us AS s, end_us AS e FROM das WHERE label = 'effective_candidate'),
adm AS (SELECT DISTINCT time_us, kind FROM grid JOIN strong ON activity > 100 AND time_us BETWEEN s + {2 * MINUTE} AND e - {2 * MINUTE})"""


def _quota(n: int, seed: int) -> str:
    return f"""g{n} AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT kind FROM adm)),
q{n} AS (SELECT kind, time_us FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(concat_ws(':', '{seed}', kind, time_us)), time_us) AS r FROM adm) JOIN g{n} USING (kind)
    WHERE r <= {n} // c + CASE WHEN i < {n} % c THEN 1 ELSE 0 END)"""


def _even(k: int, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT * FROM (SELECT *, row_number() OVER ({part} ORDER BY peak_us, event_id) - 1 AS i, count(*) OVER ({part}) AS n FROM %s)
    WHERE n <= {k} OR list_contains(list_transform(range({k}), lambda k: CAST(round_even(k * (n - 1) / {k - 1}, 0) AS BIGINT)), i)"""


ORACLES = {
    "js_distance": f"""WITH {X}, s AS (SELECT vec_id, label, list_transform(x, lambda v: greatest(abs(v), 1e-15)) AS p FROM w),
    f AS (SELECT label, arg_min(p, vec_id) AS q FROM s GROUP BY 1), z AS (SELECT vec_id, unnest(list_transform(p, lambda v: v / list_sum(p))) AS u, unnest(list_transform(q, lambda v: v / list_sum(q))) AS v FROM s JOIN f USING (label))
    SELECT vec_id, round(sqrt(greatest(sum(0.5 * u * ln(2 * u / (u + v)) + 0.5 * v * ln(2 * v / (u + v))), 0)), 6) AS js FROM z GROUP BY 1""",
    "spectral_entropy": f"WITH {X}, {LONG}, t AS (SELECT vec_id, abs(v) / sum(abs(v)) OVER (PARTITION BY vec_id) AS p FROM l) SELECT vec_id, round(-sum(p * ln(greatest(p, 1e-15))) / ln(64), 6) AS entropy FROM t GROUP BY 1",
    "abs_correlation": f"""WITH {X}, {LONG}, c AS (SELECT a.vec_id // 9 AS g, abs(corr(a.v, b.v)) AS c FROM l a JOIN l b ON a.i = b.i AND a.vec_id // 9 = b.vec_id // 9 AND a.vec_id < b.vec_id GROUP BY a.vec_id, b.vec_id)
    SELECT g, round(median(c), 6) AS correlation FROM c GROUP BY 1""",
    "band_power": f"""WITH {X}, {LONG}, h AS (SELECT vec_id, i, (v - avg(v) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS v FROM l),
    f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * i / 64)) ** 2 + sum(v * sin(2 * pi() * k * i / 64)) ** 2 AS p FROM h, range(1, 33) t(k) GROUP BY ALL)
    SELECT vec_id, """ + ", ".join(f"round(sum(p) FILTER (WHERE k >= {a} AND k < {b}) / sum(p), 6) AS band_{i}" for i, (a, b) in enumerate(zip(BAND_EDGES, BAND_EDGES[1:], strict=False))) + " FROM f GROUP BY 1",
    "linear_detrend": f"WITH {X}, {LONG}, r AS (SELECT vec_id, regr_slope(v, i) AS s, regr_intercept(v, i) AS c FROM l GROUP BY 1) SELECT vec_id, CAST(i AS INT) AS i, round(v - c - s * i, 6) AS v FROM l JOIN r USING (vec_id)",
    "sliding_rms": f"WITH {X}, {LONG} SELECT vec_id, CAST(k AS INT) AS i, round(sqrt(avg(v * v)), 6) AS rms FROM l JOIN range(7) t(k) ON l.i >= 8 * k AND l.i < 8 * k + 16 GROUP BY vec_id, k",
    "concentration": f"""WITH {X}, {LONG}, f AS (SELECT vec_id, i // 8 AS f, sqrt(avg(v * v)) AS r FROM l GROUP BY ALL), c AS (SELECT vec_id, max(r) / avg(r) AS c FROM f GROUP BY 1),
    m AS (SELECT vec_id, avg(v) AS m FROM l GROUP BY 1), k AS (SELECT vec_id, avg((v - m) ** 2) AS m2, avg((v - m) ** 4) AS m4 FROM l JOIN m USING (vec_id) GROUP BY 1),
    o AS (SELECT vec_id, median(v) AS md FROM l WHERE i >= 9 GROUP BY 1), o2 AS (SELECT vec_id, md + greatest(1.4826 * median(abs(v - md)), 0.05) AS t FROM l JOIN o USING (vec_id) WHERE i >= 9 GROUP BY vec_id, md),
    s AS (SELECT vec_id, count(*) FILTER (WHERE v > t) / 9 AS s FROM l JOIN o2 USING (vec_id) WHERE i < 9 GROUP BY 1)
    SELECT vec_id, round(c, 6) AS concentration, round(63.0 / (62 * 61) * (65 * m4 / (m2 * m2) - 3 * 63) + 3, 5) AS kurtosis, round(s, 6) AS support FROM c JOIN k USING (vec_id) JOIN s USING (vec_id)""",
    "packed_lists": "SELECT event_id, concat_ws(';', user_id, event_id % 7, 12) AS ints, event_id % 2 = 0 AS flag FROM events",
    "similarity_pairs": f"WITH {DAS}, {PRIM}, {PAIRS} SELECT a, b FROM pairs",
    "gauge_pairs": f"WITH {DAS}, {PRIM} SELECT a.key AS a, b.key AS b FROM p a JOIN p b ON (a.peak_us < b.peak_us OR (a.peak_us = b.peak_us AND a.key < b.key)) AND b.peak_us - a.peak_us <= {10 * MINUTE} AND abs(a.channel - b.channel) <= 8",
    "similarity_components": f"""WITH RECURSIVE {DAS}, {PRIM}, {PAIRS}, both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    r AS (SELECT key AS a, key AS b FROM p UNION SELECT r.a, e.b FROM r JOIN both_ways e ON r.b = e.a) SELECT a AS key, min(b) AS component FROM r GROUP BY a""",
    "qc_moments": f"WITH {SAMPLES} SELECT file, channel, sample_count, finite_count, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "std", "rms", "kurtosis", "nonfinite_fraction", "zero_fraction", "saturation_fraction", "flat_fraction", "difference_rms", "max_jump")) + " FROM m",
    "qc_flags": f"""WITH {SAMPLES}, {CLASSED} SELECT file, channel, qc_group, array_to_string(bad, ';') AS bad_reasons, array_to_string(hard, ';') AS hard_reasons, array_to_string(review, ';') AS review_reasons,
    CASE WHEN len(hard) > 0 THEN 'HARD_BAD' WHEN len(review) > 0 THEN 'REVIEW' ELSE 'PASS' END AS qc_class, round(fz_v, 4) AS std_z, round(gz_v, 4) AS group_z FROM c""",
    "qc_channel_summary": f"WITH {SAMPLES}, {CLASSED}, {SUMMARY} SELECT * REPLACE (round(review_fraction, 6) AS review_fraction, round(median_rms, 6) AS median_rms, round(median_std, 6) AS median_std) FROM cs",
    "qc_group_summary": f"""WITH {SAMPLES}, {CLASSED}, {SUMMARY} SELECT 'group_' || (channel % 3) AS qc_group, count(*) AS channels, count(*) FILTER (WHERE fixed_bad) AS fixed_bad_channels,
    round(1 - count(*) FILTER (WHERE fixed_bad) / count(*), 6) AS valid_rate, round(median(median_rms), 6) AS median_rms FROM cs GROUP BY 1""",
    "qc_file_summary": f"""WITH {SAMPLES}, {CLASSED} SELECT file, count(*) FILTER (WHERE len(hard) > 0) AS hard_bad_channels, count(*) FILTER (WHERE len(review) > 0) AS review_channels,
    round(avg(nonfinite_fraction), 8) AS mean_nonfinite, CASE WHEN count(*) FILTER (WHERE len(hard) > 0) > 0 THEN 'WARN' ELSE 'PASS' END AS quality_status FROM c GROUP BY 1""",
    "block_kurtosis": f"WITH {X}, {LONG} SELECT label, count(*) AS n, round(avg(v), 8) AS mean, round(var_pop(v), 8) AS variance, round(kurtosis_pop(v) + 3, 5) AS kurtosis FROM l GROUP BY 1",
    "metadata_join": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS event_type FROM events",
    "stitched_read": f"""WITH {X}, b AS (SELECT vec_id, vec_id * 56 + i AS pos, x[i + 1] AS v FROM w, range(64) t(i)),
    u AS (SELECT pos, arg_min(v, vec_id) AS v FROM b GROUP BY 1), q AS (SELECT unnest(range((SELECT max(pos) FROM u) // 97 + 1)) AS request)
    SELECT request, count(*) AS n, round(sum(v), 6) AS total, count(*) = 100 AS complete FROM q JOIN u ON pos BETWEEN request * 97 AND request * 97 + 99 GROUP BY 1""",
    "gauge_metrics": f"""WITH {X}, {LONG}, g AS (SELECT vec_id // 9 AS request, vec_id % 9 AS channel, sqrt(avg(v * v)) AS r, sum(v * v) / 64 AS q, count(*) AS n FROM l GROUP BY ALL)
    SELECT request, round(median(r), 6) AS rms_median, round(min(r), 6) AS rms_min, round(max(r), 6) AS rms_max, round(median(q), 6) AS integral_median, round(sum(q), 6) AS integral_sum,
    count(*) AS gauge_channels, max(n) AS samples, string_agg(channel, ';' ORDER BY channel) AS gauge_data_channels FROM g GROUP BY 1""",
    "activity_rollup": f"""WITH {DAS} SELECT peak_us // {DAY} AS day, node, CASE GROUPING(peak_us // {DAY}, node) WHEN 0 THEN 'cell' WHEN 1 THEN 'minute' WHEN 2 THEN 'position' ELSE 'all' END AS level,
    count(*) AS event_count, round(sum(activity), 4) AS total FROM das GROUP BY CUBE (peak_us // {DAY}, node)""",
    "activity_invariants": "SELECT 'sum_of_' || l AS \"check\", CAST(0 AS BIGINT) AS violations FROM (VALUES ('cell'), ('minute'), ('position'), ('all')) t(l)",
    "integrity": f"""WITH {DAS} SELECT 'peak_within' AS "check", count(*) FILTER (WHERE NOT (start_us <= peak_us AND peak_us <= end_us)) AS violations FROM das
    UNION ALL SELECT 'positive_duration', count(*) FILTER (WHERE end_us <= start_us) FROM das UNION ALL SELECT 'activity_sane', count(*) FILTER (WHERE NOT activity >= 0) FROM das
    UNION ALL SELECT 'type_known', count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) FROM das UNION ALL SELECT 'unique_node', count(*) - count(DISTINCT node) FROM das
    UNION ALL SELECT 'node_listed', count(*) FILTER (WHERE node % 2 <> 0) FROM das""",
    "reference_grid": f"WITH {DAS}, {GRID} SELECT * FROM adm",
    "calibration_times": f"""WITH {DAS}, {GRID}, f AS (SELECT time_us, (time_us - {T0}) // {5 * DAY} AS stage FROM grid WHERE NOT EXISTS (SELECT 1 FROM strong WHERE activity > 250 AND time_us BETWEEN s AND e))
    SELECT stage, time_us FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY md5('0:' || time_us), time_us) AS r FROM f) WHERE r <= 48""",
    "quota_sample": f"WITH {DAS}, {GRID}, {_quota(50, 7)} SELECT * FROM q50",
    "sensor_round_robin": f"""WITH {NODES} SELECT node FROM (SELECT *, row_number() OVER (PARTITION BY burial_depth_cm, geometry_type ORDER BY md5('0:' || node), node) AS t FROM nodes ORDER BY t, burial_depth_cm, geometry_type LIMIT 13)""",
    "early_references": f"WITH {DAS}, e AS (SELECT *, node % 5 AS stratum FROM das WHERE peak_us >= {T0} AND peak_us < {T0 + 3 * DAY}), s AS ({_even(9, 'stratum') % 'e'}) SELECT event_id FROM (SELECT event_id FROM s ORDER BY md5('0:' || event_id), event_id LIMIT 40)",
    "feature_tasks": f"""WITH {DAS}, {NODES}, {GRID}, {_quota(12, 1)}, sn AS (SELECT node FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || node), node) AS t FROM nodes ORDER BY t, stratum LIMIT 6)),
    t AS (SELECT 'candidate' AS task_class, 'candidate:' || event_id AS task_id, node AS channel FROM das UNION ALL SELECT kind, concat_ws(':', kind, time_us, node), node FROM q12, sn)
    SELECT task_class, count(*) AS n, count(DISTINCT task_id) AS ids, CAST(sum(channel) AS BIGINT) AS channels FROM t GROUP BY 1""",
    "row_digest": f"""WITH {DAS}, h AS (SELECT md5(concat_ws('|', event_id, node, peak_us, event_type)) AS h FROM das), b AS (SELECT h[1:2] AS b, md5(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY 1)
    SELECT md5(string_agg(h, '' ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b""",
}
# the greedy cut, one detection of every component at a time
ORACLES["similarity_merge"] = f"""WITH RECURSIVE {DAS}, {PRIM}, {PAIRS}, both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r AS (SELECT key AS a, key AS b FROM p UNION SELECT r.a, e.b FROM r JOIN both_ways e ON r.b = e.a),
o AS MATERIALIZED (SELECT p.key, p.peak_us, p.start_us, p.end_us, channel, activity AS score, component, row_number() OVER (PARTITION BY component ORDER BY p.peak_us, p.key) AS i
    FROM p JOIN (SELECT a AS key, min(b) AS component FROM r GROUP BY a) USING (key) JOIN das ON event_id = key AND das.peak_us = p.peak_us),
f(key, component, i, part, s, e, lo, hi) AS (SELECT key, component, i, 0, start_us, end_us, channel, channel FROM o WHERE i = 1 UNION ALL
    SELECT key, component, i, part + away, CASE away WHEN 1 THEN start_us ELSE least(s, start_us) END, CASE away WHEN 1 THEN end_us ELSE greatest(e, end_us) END,
        CASE away WHEN 1 THEN channel ELSE least(lo, channel) END, CASE away WHEN 1 THEN channel ELSE greatest(hi, channel) END
    FROM (SELECT o.*, f.part, f.s, f.e, f.lo, f.hi, CASE WHEN greatest(f.e, o.end_us) - least(f.s, o.start_us) > {RULES.span} OR greatest(f.hi, o.channel) - least(f.lo, o.channel) > {RULES.channel_span} THEN 1 ELSE 0 END AS away
        FROM f JOIN o ON o.component = f.component AND o.i = f.i + 1)),
g AS (SELECT o.*, f.part, row_number() OVER (PARTITION BY o.component, f.part ORDER BY score DESC, peak_us, o.key) AS best FROM o JOIN f USING (key)),
m AS (SELECT component, part, min(start_us) AS start_us, max(end_us) AS end_us, max(peak_us) FILTER (WHERE best = 1) AS peak_us, max(key) FILTER (WHERE best = 1) AS representative,
    max(channel) FILTER (WHERE best = 1) AS channel, count(*) AS primitive_count, string_agg(DISTINCT channel, ';' ORDER BY channel) AS source_channels, max(score) AS max_score FROM g GROUP BY ALL)
SELECT *, printf('EV_%07d', row_number() OVER (ORDER BY peak_us, representative)) AS event_id FROM m"""
