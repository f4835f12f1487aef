"""Queries of layouts, files and the waveform detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake import functions as fn
from tremorlake.checks import violations
from tremorlake.operators import detect, features, spatial
from tremorlake.plans.das import DAS, DAY, HOUR, NODES, T0, das, nodes, table
from tremorlake.sources import tables

FS = 64.0
RULES = detect.DetectorRules(scales=(0.25, 0.5), half=1, apart=2, expanded=2.0)
FILE_HOURS = 10


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("node")
    role = F.when(n % 9 == 0, "leadin_control").when(n % 7 == 0, "deep_ring_unit").otherwise("target")
    return nodes(spark, sf_dir).select(n.alias("data_channel"), "geometry_type", "burial_depth_cm", role.alias("analysis_role"))


def target_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.target_sensors(sensors(spark, sf_dir), (2, 20, 80)).select("data_channel", "geometry_type", "burial_depth_cm")


def required_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cable ends at the last sensor."""
    s = sensors(spark, sf_dir)
    return spatial.required_channels(s, 4, s.agg(F.max("data_channel")).first()[0] or 0)


def attached_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their sensor's place, and how many disagree with it by more than a millionth."""
    e = das(spark, sf_dir).withColumn("x_seen", ((F.col("node") % 10) * 20).cast("double") + F.when(F.col("event_id") % 100 == 0, 1e-5).otherwise(1e-7))
    full = e.join(F.broadcast(nodes(spark, sf_dir)), "node", "left")
    return violations(full, sensor_known=F.col("x_cm").isNotNull(), place_agrees=F.abs(F.col("x_seen") - F.col("x_cm")) <= 1e-6)


def final_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that end and peak before the cutoffs, and the members that go with them."""
    e = das(spark, sf_dir)
    kept = e.where((F.col("end_us") <= T0 + 25 * DAY) & (F.col("peak_us") <= T0 + 24 * DAY))
    members = e.select("event_id", F.explode(F.array(F.col("event_id") * 2, F.col("event_id") * 2 + 1)).alias("primitive_id"))
    return members.join(kept.select("event_id"), "event_id", "left_semi")


def located_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each event: files of ten hours every twelve."""
    records = spark.range(60).select(F.concat(F.lit("file_"), "id").alias("file_name"), ((F.col("id") * 12 * HOUR + T0) * 1000).alias("start_ns"))
    times = das(spark, sf_dir).select("event_id", (F.col("peak_us") * 1000).alias("time_ns"))
    return tables.locate(times, records, limit_s=FILE_HOURS * 3600.0).select("event_id", "file_name")


def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each event lies from its follower by id."""
    e = das(spark, sf_dir).select("event_id", "start_us", "end_us")
    n = e.select((F.col("event_id") - 1).alias("event_id"), F.col("start_us").alias("s2"), F.col("end_us").alias("e2"))
    return e.join(n, "event_id").select("event_id", fn.interval_gap("start_us", "end_us", "s2", "e2").alias("gap_us"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen vectors are the channels of one file."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("f"), F.expr("vec_id div 16")).alias("file_name"), F.lit(0).cast("long").alias("core"), (F.col("vec_id") % 16).alias("channel"), F.lit(FS).alias("fs"), F.col("embedding").cast("array<double>").alias("samples"))


def cable(spark: SparkSession) -> DataFrame:
    c = F.col("id")
    return spark.range(16).select(c.alias("channel"), F.when(c % 2 == 0, 2.0).otherwise(20.0).alias("burial_depth_cm"), F.lit("ring").alias("geometry_type"), F.when(c > 13, "control").otherwise("target").alias("analysis_role"))


def window_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.block_levels(blocks(spark, sf_dir), RULES)
    each = out.select("file_name", "channel", F.posexplode("levels").alias("scale", "l")).select("file_name", "channel", "scale", F.posexplode("l").alias("window", "level"))
    return each.withColumn("level", F.round("level", 6))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = detect.sensor_features(blocks(spark, sf_dir), cable(spark), RULES)
    model = f.groupBy("scale", "channel").agg(*[F.median(n).alias(f"m_{n}") for n in detect.FEATURES], *[F.stddev_pop(n).alias(f"s_{n}") for n in detect.FEATURES])
    full = f.join(F.broadcast(model), ["scale", "channel"], "left")
    for k, n in enumerate(detect.FEATURES):
        full = full.withColumn(f"z{k}", F.coalesce(F.try_divide(F.col(n) - F.col(f"m_{n}"), F.col(f"s_{n}")), F.lit(0.0)))
    return full


def waveform_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detections(scored(spark, sf_dir), RULES)
    return found.withColumns({c: F.round(c, 5) for c in ("score", "secondary", "support", "active_fraction")})


def waveform_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.signatures(detect.detections(scored(spark, sf_dir), RULES), blocks(spark, sf_dir), RULES)


def sensor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = detect.sensor_features(blocks(spark, sf_dir), cable(spark), RULES)
    return f.select("file_name", "scale", "window", "channel", *[F.round(c, 6).alias(c) for c in (*detect.FEATURES, "support")])


TASK_RULES = features.FeatureRules(scales=(0.25, 0.5), context=1.0, edge=0.25, search=0.2, low=1.0, high=32.0, bands=6)


def task_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("channel")
    role = F.when(c.between(4, 6), "gauge").when(c > 13, "control").otherwise("distant")
    return blocks(spark, sf_dir).select(F.col("file_name").alias("task_id"), "channel", role.alias("role"), "fs", F.lit(-0.5).alias("first_s"), "samples")


def task_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = features.best_windows(features.channel_gains(task_samples(spark, sf_dir), TASK_RULES))
    return best.select("task_id", "scale", "offset", "low", "high", *[F.round(c, 6).alias(c) for c in ("local_gain", "nonlocal_gain", "control_gain", "support")])


def multiscale_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extract(task_samples(spark, sf_dir), TASK_RULES)


QUERIES = {f.__name__: f for f in (target_sensors, required_channels, attached_layout, final_cutoff, located_files, interval_gaps, window_levels, sensor_features, waveform_detector, waveform_signatures, task_windows, multiscale_features)}

SENSORS = """sensors AS (SELECT node AS data_channel, geometry_type, burial_depth_cm,
    CASE WHEN node % 9 = 0 THEN 'leadin_control' WHEN node % 7 = 0 THEN 'deep_ring_unit' ELSE 'target' END AS analysis_role FROM nodes)"""

LEVELS = """w AS (SELECT 'f' || (vec_id // 16) AS file_name, vec_id % 16 AS channel, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    v AS (SELECT file_name, channel, i, x[i + 1] - list_aggregate(x, 'median') AS v FROM w, range(64) t(i)), s(scale, width, step, n) AS (VALUES (0.25, 16, 4, 13), (0.5, 32, 8, 5)),
    l AS MATERIALIZED (SELECT file_name, channel, scale, CAST(k AS INT) AS "window", sqrt(avg(v * v)) AS level FROM v, s, range(13) t(k) WHERE k < n AND i >= k * step AND i < k * step + width GROUP BY ALL),
    g AS MATERIALIZED (SELECT l.file_name, l.scale, l."window", t.c AS channel, list(level) AS own, median(level) AS local FROM l JOIN range(14) t(c) ON abs(l.channel - t.c) <= 1 GROUP BY ALL),
    d AS (SELECT g.file_name, g.scale, g."window", t.c AS channel, median(local) AS distant FROM g JOIN range(14) t(c) ON g.channel % 2 = t.c % 2 AND abs(g.channel - t.c) > 2 GROUP BY ALL),
    q AS (SELECT file_name, scale, "window", coalesce(median(level) FILTER (WHERE channel > 13), 1) AS quiet, median(level) AS every FROM l GROUP BY ALL),
    f AS (SELECT g.*, coalesce(distant, every) AS far, quiet FROM g LEFT JOIN d USING (file_name, scale, "window", channel) JOIN q USING (file_name, scale, "window"))"""

ORACLES = {
    "target_sensors": f"WITH {NODES}, {SENSORS} SELECT data_channel, geometry_type, burial_depth_cm FROM sensors WHERE analysis_role NOT LIKE '%control%' AND burial_depth_cm IN (2, 20, 80)",
    "required_channels": f"""WITH {NODES}, {SENSORS}
    SELECT data_channel FROM sensors WHERE analysis_role LIKE '%control%'
    UNION SELECT unnest(range(greatest(data_channel - 4, 0), least(data_channel + 4, (SELECT max(data_channel) FROM sensors)) + 1)) FROM sensors WHERE analysis_role NOT LIKE '%control%'""",
    "attached_layout": f"""WITH {DAS} SELECT 'sensor_known' AS "check", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'place_agrees', count(*) FILTER (WHERE event_id % 100 = 0) FROM das""",
    "final_cutoff": f"""WITH {DAS} SELECT event_id, unnest([event_id * 2, event_id * 2 + 1]) AS primitive_id FROM das WHERE end_us <= {T0 + 25 * DAY} AND peak_us <= {T0 + 24 * DAY}""",
    "located_files": f"""WITH {DAS}, p AS (SELECT event_id, (peak_us - {T0}) // {12 * HOUR} AS f, (peak_us - {T0}) % {12 * HOUR} AS o FROM das)
    SELECT event_id, CASE WHEN o < {FILE_HOURS * HOUR} THEN 'file_' || f END AS file_name FROM p""",
    "interval_gaps": f"WITH {DAS} SELECT a.event_id, greatest(0, b.start_us - a.end_us, a.start_us - b.end_us) AS gap_us FROM das a JOIN das b ON b.event_id = a.event_id + 1",
    "window_levels": """WITH w AS (SELECT 'f' || (vec_id // 16) AS file_name, vec_id % 16 AS channel, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    l AS (SELECT file_name, channel, i, x[i + 1] - list_median(x) AS v FROM w, range(64) t(i)), s(scale, width, step, n) AS (VALUES (0, 16, 4, 13), (1, 32, 8, 5))
    SELECT file_name, channel, scale, CAST(k AS INT) AS "window", round(sqrt(avg(v * v)), 6) AS level FROM l, s, range(13) t(k) WHERE k < n AND i >= k * step AND i < k * step + width GROUP BY ALL""".replace("list_median(x)", "list_aggregate(x, 'median')"),
    "sensor_features": f"""WITH {LEVELS}
    SELECT file_name, CAST(scale AS DOUBLE) AS scale, "window", channel, round(ln(local), 6) AS log_local, round(ln(local / far), 6) AS locality, round(ln(local / quiet), 6) AS local_control,
      round(len(list_filter(own, lambda x: x > 1.1 * far)) / len(own), 6) AS support FROM f""",
    "waveform_detector": f"""WITH {LEVELS},
    x AS (SELECT file_name, scale, "window", channel, ln(local) AS f0, ln(local / far) AS f1, ln(local / quiet) AS f2, len(list_filter(own, lambda x: x > 1.1 * far)) / len(own) AS support FROM f),
    mm AS (SELECT scale, channel, median(f0) AS m0, median(f1) AS m1, median(f2) AS m2, stddev_pop(f0) AS s0, stddev_pop(f1) AS s1, stddev_pop(f2) AS s2 FROM x GROUP BY ALL),
    z AS (SELECT x.*, coalesce((f0 - m0) / nullif(s0, 0), 0) AS z0, coalesce((f1 - m1) / nullif(s1, 0), 0) AS z1, coalesce((f2 - m2) / nullif(s2, 0), 0) AS z2 FROM x JOIN mm USING (scale, channel)),
    e AS (SELECT *, greatest(z0, z1, z2) AS score, list_sort([z0, z1, z2])[2] AS secondary, greatest(z0, z1, z2) >= 2 AND (z0 > 0 OR z1 > 0) AS expanded FROM z),
    c AS (SELECT *, avg(CASE WHEN expanded THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY file_name, scale, "window") AS active FROM e),
    r AS (SELECT *, "window" - row_number() OVER (PARTITION BY file_name, scale, channel ORDER BY "window") AS run FROM c WHERE expanded),
    b AS (SELECT *, row_number() OVER (PARTITION BY file_name, scale, channel, run ORDER BY score DESC, "window") AS k, count(*) OVER (PARTITION BY file_name, scale, channel, run) AS windows FROM r)
    SELECT file_name, CAST(0 AS BIGINT) AS core, CAST(scale AS DOUBLE) AS scale, channel, "window", round(score, 5) AS score, round(secondary, 5) AS secondary, score >= 5 AND secondary >= 2 AS strict,
      round(support, 5) AS support, active > 0.25 OR z2 < -4 AS common_mode, round(active, 5) AS active_fraction, windows FROM b WHERE k = 1""",
    "task_windows": """WITH w AS (SELECT 'f' || (vec_id // 16) AS task_id, vec_id % 16 AS channel, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    v AS (SELECT task_id, channel, CASE WHEN channel BETWEEN 4 AND 6 THEN 'gauge' WHEN channel > 13 THEN 'control' ELSE 'distant' END AS role, i, -0.5 + i / 64.0::DOUBLE AS t,
      x[i + 1] - list_aggregate(x, 'median') AS v FROM w, range(64) r(i)),
    c AS (SELECT task_id, channel, sqrt(avg(v * v) + 1e-20) AS calm FROM v WHERE abs(t) >= 0.25 GROUP BY ALL),
    o(scale, "offset", half, o) AS (SELECT 0, k, 0.125::DOUBLE, -0.2::DOUBLE + k * 0.0625::DOUBLE FROM range(7) r(k) UNION ALL SELECT 1, k, 0.25::DOUBLE, -0.2::DOUBLE + k * 0.125::DOUBLE FROM range(4) r(k)),
    g AS (SELECT task_id, channel, role, scale, "offset", min(i) AS low, max(i) + 1 AS high, ln(greatest(sqrt(avg(v * v) + 1e-20) / any_value(calm), 1e-12)) AS gain
      FROM v JOIN c USING (task_id, channel), o WHERE t >= o - half AND t < o + half GROUP BY ALL HAVING count(*) >= CASE scale WHEN 0 THEN 16 ELSE 26 END),
    m AS (SELECT task_id, scale, "offset", low, high, median(gain) FILTER (WHERE role = 'gauge') AS l, coalesce(median(gain) FILTER (WHERE role = 'distant'), 0) AS f, median(gain) FILTER (WHERE role = 'control') AS q,
      list(gain) FILTER (WHERE role = 'gauge') AS own, list(gain) FILTER (WHERE role = 'distant') AS others FROM g GROUP BY ALL HAVING l IS NOT NULL),
    b AS (SELECT *, row_number() OVER (PARTITION BY task_id, scale ORDER BY l + 0.5 * greatest(l - f, 0) DESC, "offset") AS r, list_aggregate(list_transform(others, lambda x: abs(x - f)), 'median') AS mad FROM m)
    SELECT task_id, scale, CAST("offset" AS INT) AS "offset", CAST(low AS INT) AS low, CAST(high AS INT) AS high, round(l, 6) AS local_gain, round(f, 6) AS nonlocal_gain, round(q, 6) AS control_gain,
      round(len(list_filter(own, lambda x: x > f + greatest(1.4826 * coalesce(mad, 0), 0.05))) / len(own), 6) AS support FROM b WHERE r = 1""",
}
