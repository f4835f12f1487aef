"""Queries and oracles of time, space and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators import inference, maps, spatial, temporal
from tremorlake.plans.das import DAS, DAY, HOUR, MINUTE, NODES, T0, das, nodes
from tremorlake.plans.study import peaks_by_start
from tremorlake.sources.shared import cut
from tremorlake.spec import ScanSettings

CUTOFF = T0 + 28 * DAY
EXCLUDED_UNTIL = T0 + 12 * HOUR
RADIUS = 35.0
DURATIONS = (6 * HOUR, 12 * HOUR, 24 * HOUR)
STEP = 6 * HOUR
SCAN_END = T0 + 29 * DAY + 23 * HOUR
#: Of the queries that have an oracle; the full_ ones draw as many as a study.
PERMUTATIONS = 19


def minute_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = das(spark, sf_dir).where((F.col("label") == "effective_candidate") & (F.col("peak_us") < CUTOFF) & (F.col("peak_us") >= T0))
    out = temporal.spined_activity(events, T0, CUTOFF - MINUTE, MINUTE, F.col("minute_us") < EXCLUDED_UNTIL)
    return out.select("minute_us", "event_count", F.round("activity_increment", 4).alias("activity_increment"), "excluded", "cumulative_count", F.round("cumulative_activity", 4).alias("cumulative_activity"), F.round("trailing_mean", 6).alias("trailing_mean"))


def policies(events: DataFrame) -> DataFrame:
    """Each policy's events: effective only, effective and uncertain, or by the include flag."""
    label = F.col("label")
    listed = F.filter(
        F.array(
            F.when(label == "effective_candidate", "auto_effective"),
            F.when(label.isin("effective_candidate", "uncertain"), "auto_effective_plus_uncertain"),
            F.when(F.lower(F.trim(F.col("event_type"))).isin("purchase"), "include_flag"),
        ),
        lambda p: p.isNotNull(),
    )
    return events.withColumn("policy", F.explode(listed))


def event_policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies(das(spark, sf_dir)).where(F.col("peak_us") < CUTOFF).groupBy("policy").agg(F.count("*").alias("n"), F.round(F.sum("activity"), 4).alias("activity"))


def range_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of the range stay; what lies outside is counted."""
    p = F.col("peak_us")
    a, b = T0 + 2 * DAY, T0 + 20 * DAY
    return das(spark, sf_dir).agg(F.count_if(p < a).alias("before"), F.count_if(p > b).alias("after"), F.count_if(p.between(a, b)).alias("kept"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return das(spark, sf_dir).groupBy("label", "event_type").agg(F.count("*").alias("n"))


def position_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positions stand, those without an effective event with zeros."""
    own = das(spark, sf_dir).where("label = 'effective_candidate' AND activity > 100").groupBy("node").agg(F.count("*").alias("n"), F.sum("activity").alias("a"))
    return nodes(spark, sf_dir).join(own, "node", "left").select("node", "x_cm", "y_cm", "z_cm", F.coalesce("n", F.lit(0)).alias("event_count"), F.round(F.coalesce("a", F.lit(0.0)), 4).alias("activity"))


def position_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.snapshots(das(spark, sf_dir), nodes(spark, sf_dir), "node", T0, SCAN_END, 2 * DAY)
    return out.withColumn("cumulative_activity", F.round("cumulative_activity", 4))


def position_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = das(spark, sf_dir).groupBy("node", F.expr(f"peak_us div {DAY}").alias("day")).agg(F.count("*").alias("n"), F.sum("activity").alias("a"))
    out = temporal.cumulative(daily, ["day"], {"cn": "n", "ca": "a"}, ["node"])
    return out.select("node", "day", "n", "cn", F.round("ca", 4).alias("ca"))


def merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return temporal.merge_overlapping(das(spark, sf_dir))


def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir)[0]


def merge_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir)[1]


def study_windows(spark: SparkSession) -> DataFrame:
    return temporal.candidate_windows(spark, T0, SCAN_END, DURATIONS, STEP)


def scan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a study, from its first event to its last one."""
    spans = das(spark, sf_dir).groupBy("label").agg(F.min("peak_us").alias("start_us"), F.max("peak_us").alias("end_us"))
    return temporal.study_windows(spans, DURATIONS, STEP, ["label"])


def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.running_totals(das(spark, sf_dir).select("event_id", "peak_us", "activity"), ["peak_us", "event_id"], {"cumulative_activity": "activity"}, "cumulative_count")
    return out.select("event_id", "cumulative_count", F.round("cumulative_activity", 2).alias("cumulative_activity"))


def counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = das(spark, sf_dir).where(F.col("peak_us").between(T0, SCAN_END))
    windows = study_windows(spark)
    return windows, temporal.window_counts(events, windows, SCAN_END, STEP)


def window_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)[1]


def window_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows, counts = counted(spark, sf_dir)
    return temporal.eligibility(counts, windows, nodes(spark, sf_dir).count(), 5, 3)


def stages(spark: SparkSession) -> DataFrame:
    return spark.range(6).select(F.col("id").alias("stage_id"), (F.col("id") * 5 * DAY + T0 + F.when(F.col("id") == 0, HOUR).otherwise(0)).alias("start_us"))


def nuisance(spark: SparkSession) -> DataFrame:
    """60 closed intervals of four hours every twelve, two kinds, each with a buffer of its own."""
    n = F.col("id")
    return spark.range(60).select(n.alias("ord"), (n * 12 * HOUR + T0 - (n % 3) * HOUR).alias("start_us"), (n * 12 * HOUR + T0 + 4 * HOUR + (n % 5) * 2 * HOUR + (n % 3) * HOUR).alias("end_us"), F.when(n % 2 == 0, "personnel").otherwise("pumping").alias("kind"))


def stage_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.asof_backward(das(spark, sf_dir).select("event_id", "peak_us"), stages(spark), "peak_us", "start_us", "stage_id")
    return out.select("event_id", "stage_id")


def nuisance_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.interval_first(das(spark, sf_dir).select("event_id", "peak_us"), nuisance(spark), "event_id", "peak_us", "start_us", "end_us", "ord", "kind", 6 * HOUR)
    return out.select("event_id", "kind")


def nuisance_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.interval_all(das(spark, sf_dir).select("event_id", "peak_us"), nuisance(spark), "event_id", "peak_us", "start_us", "end_us", "kind", 6 * HOUR)
    return out.select("event_id", "kinds")


def runs_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.runs_of_true(das(spark, sf_dir), ["node"], "event_id", F.col("activity") > 40)


def max_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_true(spark, sf_dir).groupBy("node").agg(F.max("length").alias("n"))
    return nodes(spark, sf_dir).select("node").join(runs, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("max_run"))


def file_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = das(spark, sf_dir).select("node", "event_id", "start_us", "end_us", F.floor("activity").cast("long").alias("fingerprint"))
    return temporal.timeline(files, "start_us", "end_us", "event_id", "fingerprint", ["node"]).select("event_id", "previous_file", "next_file", "gap", "duplicate_of")


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.even_sample(das(spark, sf_dir).select("event_id", "node", "peak_us"), ["node"], ["peak_us", "event_id"], 8).select("event_id", "node")


def roi_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("node", spatial.region_label("burial_depth_cm", "x_cm", "z_cm").alias("region"))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as channels, seven of them at each place."""
    at = F.expr("node div 7")
    return nodes(spark, sf_dir).select(
        F.col("node").alias("channel"),
        F.concat(F.lit("seg"), F.col("node") % 5).alias("segment_id"),
        "geometry_type",
        F.element_at(F.array(*[F.lit(float(d)) for d in (2, 20, 50, 80)]), (at % 4 + 1).cast("int")).alias("burial_depth_cm"),
        ((at % 10) * 20).cast("double").alias("x_cm"),
        (F.expr("(node div 7) div 10") * 20).cast("double").alias("y_cm"),
        F.when(at % 2 == 0, 98.0).otherwise(80.0).alias("z_cm"),
    )


def gauge_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.node_table(layout(spark, sf_dir), 4)
    return out.select("x_cm", "y_cm", F.concat_ws(";", "raw_channels").alias("raw_channels"), F.concat_ws(";", "segment_ids").alias("segment_ids"), F.concat_ws(";", "gauge_support_channels").alias("support"), "gauge_opportunity_profile", "geometry_type", "permutation_group", "region")


def radius_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.radius_graph(nodes(spark, sf_dir), RADIUS).withColumn("distance_cm", F.round("distance_cm", 6))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return spatial.component_sizes(n, spatial.radius_graph(n, RADIUS))


def usable(spark: SparkSession, sf_dir: str, records: int = 5, active: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sensors, edges, windows and the counts of eligible windows."""
    n = cut(nodes(spark, sf_dir))
    windows, counts = counted(spark, sf_dir)
    counts = cut(counts)
    ok = temporal.eligibility(counts, windows, n.count(), records, active).where("eligible").select("window_id")
    return n, cut(spatial.radius_graph(n, RADIUS)), windows, counts.join(F.broadcast(ok), "window_id", "left_semi")


def moran_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all windows in which counts vary, by their maps as they are: no row is made for an edge in a window."""
    n, edges, _, counts = usable(spark, sf_dir, 1, 1)
    return maps.map_scores(counts, n, edges, "stratum", 0).select("window_id", F.round(F.col("scores")[0], 6).alias("moran_i"))


def start_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest Moran's I over the durations that start at a time."""
    windows = study_windows(spark)
    return peaks_by_start(moran_windows(spark, sf_dir).join(windows, "window_id"), "moran_i")


def permutation_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.permutation_pools(nodes(spark, sf_dir), das(spark, sf_dir), "stratum")


def scan_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows and whole rows of scores of eligible windows under md5 permutations."""
    n, edges, windows, counts = usable(spark, sf_dir)
    return windows, maps.map_scores(counts, n, edges, "stratum", PERMUTATIONS, drawn=inference.hashed_permutations(n, "stratum", PERMUTATIONS))


def permutation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.scan_statistics(scan_scores(spark, sf_dir)[1])
    return out.select("window_id", F.round("observed", 6).alias("observed"), F.round("scan_z", 5).alias("scan_z"), F.round("p_window", 6).alias("p_window"), F.round("p_global", 6).alias("p_global"), F.round("critical", 5).alias("critical"))


def null_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.null_statistics(scan_scores(spark, sf_dir)[1])
    return out.select("window_id", *[F.round(c, 9).alias(c) for c in ("null_mean", "null_sd", "null_q025", "null_q975")])


def scan_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows, scores = scan_scores(spark, sf_dir)
    return inference.episodes(inference.scan_statistics(scores).join(windows, "window_id"), 0.5).select("episode_id", "support_start_us", "support_end_us", "significant_window_count", F.round("scan_z", 5).alias("scan_z"))


def full_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows and whole rows of scores of eligible windows under as many permutations as a study draws."""
    n, edges, windows, counts = usable(spark, sf_dir)
    s = ScanSettings()
    return windows, maps.map_scores(counts, n, edges, "stratum", s.simulations, s.seed)


def full_permutation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.scan_statistics(full_scores(spark, sf_dir)[1], ScanSettings().alpha)
    return out.select("window_id", F.round("observed", 6).alias("observed"), F.round("scan_z", 5).alias("scan_z"), F.round("p_window", 6).alias("p_window"), F.round("p_global", 6).alias("p_global"), F.round("critical", 5).alias("critical"))


def full_null_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.null_statistics(full_scores(spark, sf_dir)[1])
    return out.select("window_id", *[F.round(c, 9).alias(c) for c in ("null_mean", "null_sd", "null_q025", "null_q975")])


def full_scan_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not registered: the smallest tables rightly have no episode, and a query without an oracle must give rows there."""
    windows, scores = full_scores(spark, sf_dir)
    alpha = ScanSettings().alpha
    found = inference.scan_statistics(scores, alpha).join(windows, "window_id")
    return inference.episodes(found, alpha).select("episode_id", "support_start_us", "support_end_us", "significant_window_count", F.round("scan_z", 5).alias("scan_z"))


def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the share of long events of each type as if it were a p."""
    tests = das(spark, sf_dir).groupBy(F.col("event_type").alias("test")).agg((F.count_if(F.col("activity") > 150) / F.count("*")).alias("p"))
    return inference.holm(tests).select("test", F.round("p", 8).alias("p"), F.round("p_adjusted", 8).alias("p_adjusted"), "rank")


QUERIES = {f.__name__: f for f in (minute_activity, event_policy_filter, range_audit, label_counts, position_final, position_snapshots, position_series, interval_islands, merge_membership, scan_windows, event_totals, window_node_counts, window_eligibility, stage_asof, nuisance_first, nuisance_all, runs_true, max_consecutive, file_timeline, even_sample, roi_region, gauge_profile, radius_graph, graph_components, moran_windows, start_peaks, permutation_pools, permutation_scan, null_summary, scan_episodes, full_permutation_scan, full_null_summary, holm)}

WINDOWS = f"""raw AS (SELECT i, {T0} + s AS start_us, {T0} + s + d AS end_us, d AS duration_us FROM (
    SELECT i, d, unnest(list_distinct(list_append(range(0, {SCAN_END - T0} - d + 1, {STEP}), {SCAN_END - T0} - d))) AS s
    FROM (VALUES {", ".join(f"({i}, {d})" for i, d in enumerate(DURATIONS))}) t(i, d))),
windows AS (SELECT row_number() OVER (ORDER BY i, start_us) - 1 AS window_id, start_us, end_us, CAST(duration_us AS BIGINT) AS duration_us FROM raw)"""
COUNTS = f"""counts AS (SELECT window_id, node, count(*) AS n FROM das JOIN windows w ON peak_us >= w.start_us
    AND (peak_us < w.end_us OR (w.end_us = {SCAN_END} AND peak_us = w.end_us)) WHERE peak_us BETWEEN {T0} AND {SCAN_END} GROUP BY ALL)"""
EDGES = f"""edges AS (SELECT a.node AS node_i, b.node AS node_j, sqrt((a.x_cm - b.x_cm) ** 2 + (a.y_cm - b.y_cm) ** 2 + (a.z_cm - b.z_cm) ** 2) AS distance_cm
    FROM nodes a JOIN nodes b ON a.node < b.node WHERE distance_cm > 1e-10 AND distance_cm <= {RADIUS} + 1e-9)"""
OWN = "own AS (SELECT window_id, sum(n) AS records, count(*) AS active_nodes, sum(n * n) AS squares FROM counts GROUP BY 1)"
ELIGIBLE = """eligible AS (SELECT window_id, CAST(coalesce(records, 0) AS BIGINT) AS records, coalesce(active_nodes, 0) AS active_nodes,
    coalesce(records >= 5 AND active_nodes >= 3 AND (SELECT count(*) FROM nodes) * squares > records * records, false) AS eligible
    FROM windows LEFT JOIN own USING (window_id))"""
SCORES = f"""perm AS (SELECT p AS perm_id, node, stratum, row_number() OVER (PARTITION BY p, stratum ORDER BY node) AS i,
    row_number() OVER (PARTITION BY p, stratum ORDER BY md5(concat(p, ':', node)), node) AS j FROM nodes, range(1, {PERMUTATIONS + 1}) r(p)),
drawn AS (SELECT a.perm_id, a.node, b.node AS source FROM perm a JOIN perm b ON a.perm_id = b.perm_id AND a.stratum = b.stratum AND a.i = b.j
    UNION ALL SELECT 0, node, node FROM nodes),
cen AS (SELECT window_id, node, coalesce(n, 0) - records / (SELECT count(*) FROM nodes) AS c FROM eligible JOIN nodes ON true
    LEFT JOIN counts USING (window_id, node) WHERE eligible),
down AS (SELECT window_id, sum(c * c) AS q FROM cen GROUP BY 1),
scores AS (SELECT window_id, perm_id, (SELECT count(*) FROM nodes) / (SELECT count(*) FROM edges) * top / q AS score FROM (
    SELECT a.window_id, d.perm_id, sum(a.c * b.c) AS top FROM edges JOIN drawn d ON d.node = node_i JOIN drawn e ON e.node = node_j AND d.perm_id = e.perm_id
    JOIN cen a ON a.node = d.source JOIN cen b ON b.node = e.source AND a.window_id = b.window_id GROUP BY ALL) JOIN down USING (window_id))"""
MAXSCAN = """stats AS (SELECT window_id, avg(score) AS center, stddev_samp(score) AS scale FROM scores GROUP BY 1),
z AS (SELECT window_id, perm_id, score, scale > 1e-12 AS informative, CASE WHEN scale > 1e-12 THEN (score - center) / scale ELSE 0 END AS z FROM scores JOIN stats USING (window_id)),
maxima AS (SELECT perm_id, max(z) AS m FROM z WHERE informative GROUP BY 1),
result AS (SELECT window_id, score AS observed, z AS scan_z,
    CASE WHEN informative THEN (1 + (SELECT count(*) FROM maxima WHERE perm_id > 0 AND m >= z - 1e-12)) / (SELECT count(*) FROM maxima) ELSE 1 END AS p_window,
    (1 + (SELECT count(*) FROM maxima WHERE perm_id > 0 AND m >= (SELECT m FROM maxima WHERE perm_id = 0) - 1e-12)) / (SELECT count(*) FROM maxima) AS p_global,
    (SELECT list_sort(list(m))[CAST(ceil((count(*) - 1) * 0.95 - 1e-9) AS INT) + 1] FROM maxima WHERE perm_id > 0) AS critical
    FROM z WHERE perm_id = 0)"""
ISLANDS = """marked AS (SELECT *, max(end_us) OVER (PARTITION BY node ORDER BY start_us, end_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM das),
placed AS (SELECT *, CAST(sum(CASE WHEN b IS NULL OR start_us > b THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY start_us, end_us, event_id) AS BIGINT) AS island FROM marked)"""
RUNS = """f AS (SELECT node, event_id, activity > 40 AS t, row_number() OVER (PARTITION BY node ORDER BY event_id) AS i FROM das),
g AS (SELECT *, i - row_number() OVER (PARTITION BY node ORDER BY event_id) AS r FROM f WHERE t),
runs AS (SELECT node, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY node, r)"""
NUISANCE = f"""nuisance AS (SELECT n AS ord, n * {12 * HOUR} + {T0} - (n % 3) * {HOUR} AS start_us,
    n * {12 * HOUR} + {T0} + {4 * HOUR} + (n % 5) * {2 * HOUR} + (n % 3) * {HOUR} AS end_us,
    CASE WHEN n % 2 = 0 THEN 'personnel' ELSE 'pumping' END AS kind FROM range(60) t(n))"""
LAYOUT = """layout AS (SELECT node AS channel, 'seg' || (node % 5) AS segment_id, geometry_type,
    CAST(list_extract([2.0, 20.0, 50.0, 80.0], CAST((node // 7) % 4 + 1 AS INT)) AS DOUBLE) AS d, CAST(((node // 7) % 10) * 20 AS DOUBLE) AS x_cm,
    CAST(((node // 7) // 10) * 20 AS DOUBLE) AS y_cm, CASE WHEN (node // 7) % 2 = 0 THEN 98.0 ELSE 80.0 END AS z_cm FROM nodes)"""
REGION = """CASE WHEN d = 2 AND z_cm = 98 THEN 'surface_2cm_top' WHEN d = 2 THEN 'surface_2cm_slope' WHEN d = 20 THEN 'platform_20cm'
    WHEN d = 50 AND x_cm = 120 THEN 'near_face_50cm' WHEN d = 80 AND x_cm = 150 THEN 'near_face_80cm' ELSE 'excluded_interior' END"""

ORACLES = {
    "minute_activity": f"""WITH {DAS}, m AS (SELECT (peak_us - {T0}) // {MINUTE} * {MINUTE} + {T0} AS minute_us, count(*) AS c, sum(activity) AS a FROM das
        WHERE label = 'effective_candidate' AND peak_us < {CUTOFF} AND peak_us >= {T0} GROUP BY 1),
    s AS (SELECT minute_us, minute_us < {EXCLUDED_UNTIL} AS excluded, CASE WHEN minute_us < {EXCLUDED_UNTIL} THEN 0 ELSE coalesce(c, 0) END AS event_count,
        CASE WHEN minute_us < {EXCLUDED_UNTIL} THEN 0 ELSE coalesce(a, 0) END AS a FROM range({T0}, {CUTOFF}, {MINUTE}) r(minute_us) LEFT JOIN m USING (minute_us))
    SELECT minute_us, event_count, round(a, 4) AS activity_increment, excluded, CAST(sum(event_count) OVER w AS BIGINT) AS cumulative_count,
        round(sum(a) OVER w, 4) AS cumulative_activity, round(avg(event_count) OVER (ORDER BY minute_us ROWS 9 PRECEDING), 6) AS trailing_mean
    FROM s WINDOW w AS (ORDER BY minute_us ROWS UNBOUNDED PRECEDING)""",
    "event_policy_filter": f"""WITH {DAS}, p AS (SELECT unnest(list_filter([CASE WHEN label = 'effective_candidate' THEN 'auto_effective' END,
        CASE WHEN label IN ('effective_candidate', 'uncertain') THEN 'auto_effective_plus_uncertain' END, CASE WHEN event_type = 'purchase' THEN 'include_flag' END],
        lambda x: x IS NOT NULL)) AS policy, activity FROM das WHERE peak_us < {CUTOFF})
    SELECT policy, count(*) AS n, round(sum(activity), 4) AS activity FROM p GROUP BY 1""",
    "range_audit": f"""WITH {DAS} SELECT count(*) FILTER (WHERE peak_us < {T0 + 2 * DAY}) AS before, count(*) FILTER (WHERE peak_us > {T0 + 20 * DAY}) AS after,
        count(*) FILTER (WHERE peak_us BETWEEN {T0 + 2 * DAY} AND {T0 + 20 * DAY}) AS kept FROM das""",
    "label_counts": f"WITH {DAS} SELECT label, event_type, count(*) AS n FROM das GROUP BY ALL",
    "position_final": f"""WITH {DAS}, {NODES} SELECT node, x_cm, y_cm, z_cm, count(event_id) AS event_count, round(coalesce(sum(activity), 0), 4) AS activity
        FROM nodes LEFT JOIN (SELECT * FROM das WHERE label = 'effective_candidate' AND activity > 100) USING (node) GROUP BY ALL""",
    "position_snapshots": f"""WITH {DAS}, {NODES}, snap AS (SELECT unnest(list_distinct(list_append(range({T0}, {SCAN_END} + 1, {2 * DAY}), {SCAN_END}))) AS snapshot_us)
    SELECT node, snapshot_us, count(event_id) AS cumulative_count, round(coalesce(sum(activity), 0), 4) AS cumulative_activity
    FROM nodes JOIN snap ON true LEFT JOIN das USING (node) WHERE true GROUP BY ALL HAVING true""".replace("LEFT JOIN das USING (node)", "LEFT JOIN das ON das.node = nodes.node AND peak_us <= snapshot_us").replace("SELECT node, snap", "SELECT nodes.node, snap"),
    "position_series": f"""WITH {DAS}, d AS (SELECT node, peak_us // {DAY} AS day, count(*) AS n, sum(activity) AS a FROM das GROUP BY ALL)
    SELECT node, day, n, CAST(sum(n) OVER w AS BIGINT) AS cn, round(sum(a) OVER w, 4) AS ca FROM d WINDOW w AS (PARTITION BY node ORDER BY day)""",
    "interval_islands": f"""WITH {DAS}, {ISLANDS} SELECT node, island, min(start_us) AS start_us, max(end_us) AS end_us,
        first(peak_us ORDER BY activity DESC, peak_us, event_id) AS peak_us, first(event_id ORDER BY activity DESC, peak_us, event_id) AS representative_event_id,
        count(*) AS source_records, max(activity) AS representative_activity FROM placed GROUP BY node, island""",
    "merge_membership": f"WITH {DAS}, {ISLANDS} SELECT event_id, node, island FROM placed",
    "scan_windows": f"""WITH {DAS}, span AS (SELECT label, min(peak_us) AS a, max(peak_us) AS b FROM das GROUP BY 1),
    raw AS (SELECT label, i, a + unnest(list_distinct(list_append(range(0, b - a - d + 1, {STEP}), b - a - d))) AS start_us, d AS duration_us
        FROM span, (VALUES {", ".join(f"({i}, {d})" for i, d in enumerate(DURATIONS))}) t(i, d) WHERE d <= b - a)
    SELECT label, row_number() OVER (PARTITION BY label ORDER BY i, start_us) - 1 AS window_id, start_us, start_us + duration_us AS end_us, CAST(duration_us AS BIGINT) AS duration_us FROM raw""",
    "event_totals": f"""WITH {DAS} SELECT event_id, row_number() OVER (ORDER BY peak_us, event_id) AS cumulative_count,
    round(sum(activity) OVER (ORDER BY peak_us, event_id ROWS UNBOUNDED PRECEDING), 2) AS cumulative_activity FROM das""",
    "window_node_counts": f"WITH {DAS}, {WINDOWS}, {COUNTS} SELECT * FROM counts",
    "window_eligibility": f"WITH {DAS}, {NODES}, {WINDOWS}, {COUNTS}, {OWN}, {ELIGIBLE} SELECT * FROM eligible",
    "stage_asof": f"""WITH {DAS}, st AS (SELECT i AS stage_id, i * {5 * DAY} + {T0} + CASE WHEN i = 0 THEN {HOUR} ELSE 0 END AS s FROM range(6) t(i))
    SELECT event_id, coalesce((SELECT max_by(stage_id, s) FROM st WHERE s <= peak_us), 0) AS stage_id FROM das""",
    "nuisance_first": f"WITH {DAS}, {NUISANCE} SELECT event_id, min_by(kind, ord) AS kind FROM das LEFT JOIN nuisance n ON peak_us BETWEEN n.start_us AND n.end_us GROUP BY event_id",
    "nuisance_all": f"WITH {DAS}, {NUISANCE} SELECT event_id, coalesce(string_agg(DISTINCT kind, ';' ORDER BY kind), '') AS kinds FROM das LEFT JOIN nuisance n ON peak_us BETWEEN n.start_us AND n.end_us GROUP BY event_id",
    "runs_true": f"WITH {DAS}, {RUNS} SELECT * FROM runs",
    "max_consecutive": f"WITH {DAS}, {NODES}, {RUNS} SELECT node, coalesce(max(length), 0) AS max_run FROM nodes LEFT JOIN runs USING (node) GROUP BY node",
    "file_timeline": f"""WITH {DAS} SELECT event_id, lag(event_id) OVER w AS previous_file, lead(event_id) OVER w AS next_file, start_us - lag(end_us) OVER w AS gap,
        CASE WHEN row_number() OVER f > 1 THEN first_value(event_id) OVER f END AS duplicate_of FROM das
    WINDOW w AS (PARTITION BY node ORDER BY start_us, event_id), f AS (PARTITION BY node, floor(activity) ORDER BY start_us, event_id)""",
    "even_sample": f"""WITH {DAS}, p AS (SELECT event_id, node, row_number() OVER (PARTITION BY node ORDER BY peak_us, event_id) - 1 AS i, count(*) OVER (PARTITION BY node) AS n FROM das)
    SELECT event_id, node FROM p WHERE n <= 8 OR list_contains(list_transform(range(8), lambda k: CAST(round_even(k * (n - 1) / 7, 0) AS BIGINT)), i)""",
    "roi_region": f"WITH {NODES} SELECT node, {REGION} AS region FROM (SELECT *, burial_depth_cm AS d FROM nodes)",
    "gauge_profile": f"""WITH {NODES}, {LAYOUT}, g AS (SELECT a.channel, a.d, a.x_cm, a.y_cm, a.z_cm, count(*) AS k, list(b.channel) AS s FROM layout a JOIN layout b ON abs(a.channel - b.channel) <= 4 GROUP BY ALL),
    pr AS (SELECT d, x_cm, y_cm, z_cm, string_agg(k || ':' || m, ';' ORDER BY k) AS gauge_opportunity_profile FROM (SELECT d, x_cm, y_cm, z_cm, k, count(*) AS m FROM g GROUP BY ALL) GROUP BY ALL),
    su AS (SELECT d, x_cm, y_cm, z_cm, array_to_string(list_sort(list_distinct(flatten(list(s)))), ';') AS support FROM g GROUP BY ALL),
    o AS (SELECT d, x_cm, y_cm, z_cm, string_agg(channel, ';' ORDER BY channel) AS raw_channels, array_to_string(list_sort(list_distinct(list(segment_id))), ';') AS segment_ids,
        CASE WHEN bool_or(geometry_type = 'ring') THEN 'ring' ELSE 'line' END AS geometry_type FROM layout GROUP BY ALL)
    SELECT x_cm, y_cm, raw_channels, segment_ids, support, gauge_opportunity_profile, geometry_type,
        CASE WHEN d = 2 AND z_cm = 98 THEN 'surface_2cm_top' WHEN d = 2 THEN 'surface_2cm_slope' ELSE 'horizontal_' || CAST(d AS INT) || 'cm' END || '|' || geometry_type || '|' || gauge_opportunity_profile AS permutation_group,
        {REGION} AS region FROM o JOIN pr USING (d, x_cm, y_cm, z_cm) JOIN su USING (d, x_cm, y_cm, z_cm)""",
    "radius_graph": f"WITH {NODES}, {EDGES} SELECT node_i, node_j, round(distance_cm, 6) AS distance_cm FROM edges",
    "graph_components": f"""WITH RECURSIVE {NODES}, {EDGES}, s AS (SELECT node_i AS a, node_j AS b FROM edges UNION ALL SELECT node_j, node_i FROM edges),
    r AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a), c AS (SELECT a, min(b) AS component FROM r GROUP BY a)
    SELECT component, count(*) AS size FROM c GROUP BY 1""",
    "moran_windows": f"""WITH {DAS}, {NODES}, {EDGES}, {WINDOWS}, {COUNTS}, {OWN}, cen AS (SELECT window_id, node, coalesce(n, 0) - records / (SELECT count(*) FROM nodes) AS c
        FROM own JOIN nodes ON true LEFT JOIN counts USING (window_id, node) WHERE (SELECT count(*) FROM nodes) * squares > records * records),
    down AS (SELECT window_id, sum(c * c) AS q FROM cen GROUP BY 1)
    SELECT window_id, round((SELECT count(*) FROM nodes) / (SELECT count(*) FROM edges) * top / q, 6) AS moran_i FROM down JOIN (
        SELECT a.window_id, sum(a.c * b.c) AS top FROM edges JOIN cen a ON a.node = node_i JOIN cen b ON b.node = node_j AND a.window_id = b.window_id GROUP BY 1) USING (window_id)""",
    "permutation_pools": f"""WITH {DAS}, {NODES}, per AS (SELECT node, count(*) AS records FROM das GROUP BY 1)
    SELECT stratum, count(*) AS node_count, count(*) > 1 AS exchangeable, string_agg(node, ';' ORDER BY node) AS nodes, CAST(sum(coalesce(records, 0)) AS BIGINT) AS records
    FROM nodes LEFT JOIN per USING (node) GROUP BY stratum""",
    "permutation_scan": f"""WITH {DAS}, {NODES}, {EDGES}, {WINDOWS}, {COUNTS}, {OWN}, {ELIGIBLE}, {SCORES}, {MAXSCAN}
    SELECT window_id, round(observed, 6) AS observed, round(scan_z, 5) AS scan_z, round(p_window, 6) AS p_window, round(p_global, 6) AS p_global, round(critical, 5) AS critical FROM result""",
    "null_summary": f"""WITH {DAS}, {NODES}, {EDGES}, {WINDOWS}, {COUNTS}, {OWN}, {ELIGIBLE}, {SCORES}
    SELECT window_id, round(avg(score), 9) AS null_mean, round(stddev_samp(score), 9) AS null_sd, round(quantile_cont(score, 0.025), 9) AS null_q025,
        round(quantile_cont(score, 0.975), 9) AS null_q975 FROM scores WHERE perm_id > 0 GROUP BY 1""",
    "scan_episodes": f"""WITH {DAS}, {NODES}, {EDGES}, {WINDOWS}, {COUNTS}, {OWN}, {ELIGIBLE}, {SCORES}, {MAXSCAN},
    sig AS (SELECT *, max(end_us) OVER (ORDER BY start_us, end_us, window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM result JOIN windows USING (window_id) WHERE p_window <= 0.5),
    ep AS (SELECT *, CAST(sum(CASE WHEN b IS NULL OR start_us > b THEN 1 ELSE 0 END) OVER (ORDER BY start_us, end_us, window_id) AS BIGINT) AS episode_id FROM sig)
    SELECT episode_id, min(start_us) AS support_start_us, max(end_us) AS support_end_us, count(*) AS significant_window_count, round(max(scan_z), 5) AS scan_z FROM ep GROUP BY 1""",
    "holm": f"""WITH {DAS}, t AS (SELECT event_type AS test, count(*) FILTER (WHERE activity > 150) / count(*) AS p FROM das GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS rank, count(*) OVER () AS m FROM t)
    SELECT test, round(p, 8) AS p, round(max(least(1.0, (m - rank + 1) * p)) OVER (ORDER BY p, test), 8) AS p_adjusted, rank FROM r""",
}
ORACLES["start_peaks"] = f"WITH {WINDOWS} SELECT start_us, max(moran_i) AS moran_i FROM ({ORACLES['moran_windows']}) m JOIN windows USING (window_id) GROUP BY 1"
