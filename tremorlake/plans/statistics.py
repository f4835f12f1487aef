"""Queries and oracles of robust statistics and screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators import robust, screening
from tremorlake.plans.das import DAS, DAY, T0, das, table

K, CLASS_K, QUANTILE = 10, 5, 0.995


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.robust_scale(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", F.round("center", 8).alias("center"), F.round("spread", 8).alias("scale"), "n")


def robust_z_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.robust_z(das(spark, sf_dir).select("event_id", "node", "activity"), ["node"], "activity", "z")
    return out.select("event_id", F.round("z", 5).alias("z"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir)
    return e.select("event_id", (F.col("event_id") % 3).alias("scale"), "node", F.expr(f"(peak_us - {T0}) div {5 * DAY}").alias("stage"), (F.col("node") % 4).alias("depth"), "activity", (F.col("event_type") == "error").alias("ref"))


def group_standardizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.group_standardizer(scaled(spark, sf_dir).where("ref"), "scale", ["stage", "depth"], "activity")
    named = out.toDF("k", "stage", "depth", "center", "spread", "n", "source")
    return named.withColumns({"center": F.round("center", 8), "spread": F.round("spread", 8)})


def group_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scaled(spark, sf_dir).withColumnRenamed("scale", "k")
    out = robust.standardize(s.where("not ref"), s.where("ref"), "k", ["stage", "depth"], "activity", "z")
    return out.select("event_id", F.round("z", 5).alias("z"))


def calibration_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.calibration(scaled(spark, sf_dir).drop("scale"), ["stage", "depth"], "node", "activity")
    return out.select("stage", "depth", "node", F.round("center", 8).alias("center"), F.round("spread", 8).alias("spread"), "n")


def frozen_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of stage 3 also serve stages 4 and 5."""
    late = spark.createDataFrame([(4,), (5,)], "stage long")
    return robust.frozen(calibration_models(spark, sf_dir).select("stage", "depth", "node", "center", "spread"), F.col("stage") == 3, late, "stage")


def detector_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features of every event, as z of its node's calibration, with the detector's predicates."""
    s = scaled(spark, sf_dir).drop("scale")
    m = robust.calibration(s, ["stage", "depth"], "node", "activity")
    z = s.join(m.drop("n"), ["stage", "depth", "node"], "left").withColumn("z0", F.coalesce((F.col("activity") - F.col("center")) / F.col("spread"), F.lit(0.0)))
    z = z.withColumns({"z1": F.col("z0") * ((F.col("event_id") % 7) - 3) / 2.0, "z2": F.col("z0") - (F.col("event_id") % 11)})
    out = robust.common_mode(robust.detector_flags(z, ["z0", "z1", "z2"]), ["stage", "depth"], "z2")
    return out.select("event_id", *[F.round(c, 5).alias(c) for c in ("score", "secondary", "active_fraction")], "expanded", "strict", "common_mode")


def quantile_higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.quantile_higher(das(spark, sf_dir), ["node"], "activity", 0.95, "critical")


def quantiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = (0.025, 0.75, 0.9, 0.95, 0.99, 0.975)
    return das(spark, sf_dir).groupBy("event_type").agg(*[F.round(F.percentile("activity", F.lit(q)), 6).alias(f"q{int(q * 1000)}") for q in qs])


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 5 != 0, F.log1p("activity")).alias("x"))
    return robust.impute_median(e, ["x"]).select("event_id", F.round("x", 6).alias("x"))


def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.effect_sizes(das(spark, sf_dir), "event_type", "purchase", "activity")
    return out.select("versus", *[F.round(c, 6).alias(c) for c in ("target_median", "reference_median", "cohens_d", "cliffs_delta")], "target_n", "reference_n")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and references: labels 0 to 2 of the first 300 vectors are three noise classes."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("class_"), "label").alias("label"), F.col("label").alias("c"))
    return e.where("c >= 3"), e.where("c < 3")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("key", "is_reference", *[F.round(c, 5).alias(c) for c in ("noise_distance", "threshold", "ratio", "nearest_distance")], "nearest_class")


def knn_noise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, reference = vectors(spark, sf_dir)
    return _rounded(screening.noise_distances(candidates, reference, K, CLASS_K, QUANTILE))


def four_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected early candidates (label 3) become a fourth class in the same space."""
    candidates, reference = vectors(spark, sf_dir)
    more = candidates.where("c = 3")
    return _rounded(screening.noise_distances(candidates.where("c <> 3"), reference.unionByName(more), K, CLASS_K, QUANTILE))


def subclass_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to subclasses of the references: each class by the parity of the id."""
    candidates, reference = vectors(spark, sf_dir)
    sub = reference.withColumn("label", F.concat_ws("/", "label", F.col("key") % 2))
    near = screening.knn(candidates, sub, CLASS_K, exclude_self=False, per_label=True)
    return near.select("key", F.col("label").alias("subclass"), F.round(F.element_at("distances", -1), 5).alias("distance"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six events in a row of a node are six scales of one event; the ratio is activity / 20."""
    e = das(spark, sf_dir).select(F.expr("event_id div 6").alias("event_id"), (F.col("event_id") % 6).alias("scale"), F.round(F.col("activity") / 20, 6).alias("ratio"), F.col("event_type").alias("nearest_class"), "peak_us", "event_type")
    return e


def event_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screening.event_votes(votes(spark, sf_dir))
    return out.withColumns({"median_ratio": F.round("median_ratio", 6), "max_consecutive": F.col("max_consecutive").cast("long")})


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screened catalog: votes, label and score, with flags from the id."""
    e = screening.event_votes(votes(spark, sf_dir))
    i = F.col("event_id")
    coherent, local, strict = i % 2 == 0, i % 3 == 0, i % 4 == 0
    e = e.withColumns({
        "label": screening.screening_label("novel_scale_count", "max_consecutive", coherent, local, i % 19 == 0, i % 23 == 0),
        "score": F.round(screening.screening_score("max_ratio", "novel_scale_count", "max_consecutive", coherent, local, strict), 4),
        "buffered_operation": i % 19 == 0,
        "common_mode": i % 29 == 0,
        "instrument_anomaly": i % 31 == 0,
        "strict_candidate": strict,
        "local_priority": i % 5 == 0,
        "early_caution": i % 7 == 0,
        "best_nearest_class": F.when(F.col("best_nearest_class") == "view", "personnel").when(F.col("best_nearest_class") == "click", "pumping").otherwise("stable_rain"),
    })
    peak = votes(spark, sf_dir).groupBy("event_id").agg(F.min("peak_us").alias("peak_us"))
    return e.join(peak, "event_id")


def screening_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screening.review_rank(catalog(spark, sf_dir), "score", "event_id")
    return out.select("event_id", "label", "score", "review_rank")


def formal_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.formal_tags(catalog(spark, sf_dir)).select("event_id", "human_like", "label", "screening_pool")


def early_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screening.early_reference_tags(screening.formal_tags(catalog(spark, sf_dir)), "peak_us", T0, T0 + 2 * DAY)
    return out.select("event_id", "early_period", "label", "screening_pool")


def phase_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir)
    out = e.select("event_id", screening.phase("peak_us", T0 + 10 * DAY, T0 + 12 * DAY).alias("phase"), ((F.col("peak_us") - (T0 + 10 * DAY)) / 1e6).alias("signed_s"))
    return out.withColumn("signed_s", F.round("signed_s", 6))


def _branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tagged = screening.formal_tags(catalog(spark, sf_dir))
    return tagged, screening.early_reference_tags(tagged, "peak_us", T0, T0 + 2 * DAY)


def three_vs_four_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.branch_transition(*_branches(spark, sf_dir), "event_id")


def three_vs_four_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screening.branch_summary(*_branches(spark, sf_dir), "event_id", F.col("peak_us") >= T0 + 2 * DAY)
    return out.withColumn("value", F.round("value", 8))


def top_k_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir)
    return screening.review_selection(e, "event_type", "activity", "event_id", 6, F.col("label") == "uncertain", 8).select("event_id", "event_type", "activity")


def wide_scale_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.wide_by_scale(votes(spark, sf_dir), "event_id", "scale", range(6), ["ratio"]).toDF("event_id", *[f"ratio_{i}" for i in range(6)])


def manual_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).select("event_id")
    old = c.where("event_id % 13 = 0").withColumn("manual_label", F.concat(F.lit("m"), F.col("event_id") % 3))
    return screening.keep_manual_labels(c, old, "event_id")


def nuisance_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir).withColumn("raw", F.when(F.col("event_id") % 3 == 0, " Personnel ").otherwise(F.col("event_type")))
    mapping = {"personnel": "personnel", "view": "pumping", "click": "pumping"}
    return e.groupBy(screening.canonical_kind("raw").alias("two_way"), screening.canonical_kind("raw", mapping).alias("mapped")).agg(F.count("*").alias("n"))


def task_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = das(spark, sf_dir).withColumn("task_id", F.concat_ws(":", "event_type", "event_id"))
    return e.groupBy(screening.reference_class("task_id", ["view", "click"]).alias("task_class")).agg(F.count("*").alias("n"))


def label_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of node parity by label, zeros filled in."""
    labels = ["effective_candidate", "nuisance_like", "uncertain"]
    return das(spark, sf_dir).where("NOT (node % 10 = 3 AND label = 'uncertain')").groupBy((F.col("node") % 10).alias("g")).pivot("label", labels).agg(F.count(F.lit(1))).na.fill(0)


QUERIES = {f.__name__: f for f in (robust_scale, robust_z_group, group_standardizer, group_standardize, calibration_models, frozen_models, detector_z, quantile_higher, quantiles_linear, imputed, effect_sizes, knn_noise_distance, four_reference, subclass_nearest, event_screening, screening_labels, formal_tags, early_tags, phase_tags, three_vs_four_transition, three_vs_four_summary, top_k_per_type, wide_scale_pivot, manual_labels, nuisance_kinds, task_classes, label_pivot)}


def _scale_sql(source: str, keys: str, value: str, floor: str = "1e-8") -> str:
    return f"""(SELECT {keys}, any_value(m) AS center, CASE WHEN 1.4826 * median(abs({value} - m)) >= {floor} THEN 1.4826 * median(abs({value} - m))
        WHEN stddev_pop({value}) >= {floor} THEN stddev_pop({value}) ELSE 1.0 END AS scale, count({value}) AS n
        FROM (SELECT *, median({value}) OVER (PARTITION BY {keys}) AS m FROM {source}) GROUP BY {keys})"""


SCALED = f"""s AS (SELECT event_id, event_id % 3 AS k, node, (peak_us - {T0}) // {5 * DAY} AS stage, node % 4 AS depth, activity, event_type = 'error' AS ref FROM das),
r AS (SELECT * FROM s WHERE ref)"""
STANDARD = f"own AS {_scale_sql('r', 'k, stage, depth', 'activity')}, whole AS {_scale_sql('r', 'k', 'activity')}"
CALIBRATION = f"""cg AS {_scale_sql('s', 'stage, depth', 'activity', '1e-6')}, cc AS {_scale_sql('s', 'stage, depth, node', 'activity', '1e-6')},
cal AS (SELECT stage, depth, node, CASE WHEN cc.n >= 20 THEN cc.center ELSE cg.center END AS center,
    CASE WHEN cc.n >= 20 THEN greatest(cc.scale, 0.25 * cg.scale, 1e-6) ELSE greatest(cg.scale, 1e-6) END AS spread, cc.n AS n FROM cc JOIN cg USING (stage, depth))"""
VECTORS = "v AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS x, 'class_' || label AS label, label AS c FROM embeddings)"


def _noise_sql(reference: str, candidate: str) -> str:
    return f"""WITH {VECTORS}, r AS (SELECT * FROM v WHERE {reference}), q AS (SELECT * FROM v WHERE {candidate}),
    d AS (SELECT a.key, b.key AS other, b.label, list_distance(a.x, b.x) AS d FROM (SELECT * FROM r UNION ALL SELECT * FROM q) a, r b),
    n AS (SELECT key, d, row_number() OVER (PARTITION BY key ORDER BY d) AS i FROM d WHERE key <> other),
    nd AS (SELECT key, d AS noise_distance FROM n WHERE i = {K}),
    t AS (SELECT greatest(quantile_cont(noise_distance, {QUANTILE}), 1e-9) AS threshold FROM nd WHERE key IN (SELECT key FROM r)),
    c AS (SELECT key, label, d, row_number() OVER (PARTITION BY key, label ORDER BY d) AS i FROM d),
    m AS (SELECT key, arg_min(label, d) AS nearest_class, min(d) AS nearest_distance FROM c WHERE i = {CLASS_K} GROUP BY key)
    SELECT key, key IN (SELECT key FROM r) AS is_reference, round(noise_distance, 5) AS noise_distance, round(threshold, 5) AS threshold,
        round(noise_distance / threshold, 5) AS ratio, round(nearest_distance, 5) AS nearest_distance, nearest_class FROM nd JOIN m USING (key), t"""


VOTES = """v AS (SELECT event_id // 6 AS event_id, event_id % 6 AS scale, round(activity / 20, 6) AS ratio, event_type AS nearest_class, peak_us FROM das),
vr AS (SELECT *, ratio > 1 AS t, row_number() OVER (PARTITION BY event_id ORDER BY scale) - row_number() OVER (PARTITION BY event_id, ratio > 1 ORDER BY scale) AS g FROM v),
vl AS (SELECT event_id, max(n) AS n FROM (SELECT event_id, count(*) AS n FROM vr WHERE t GROUP BY event_id, g) GROUP BY event_id),
votes AS (SELECT event_id, count(*) FILTER (WHERE ratio > 1) AS novel_scale_count, coalesce(any_value(vl.n), 0) AS max_consecutive, max(ratio) AS max_ratio,
    median(ratio) AS median_ratio, first(scale ORDER BY ratio DESC, scale) AS best_scale, first(nearest_class ORDER BY ratio DESC, scale) AS best_nearest_class,
    min(peak_us) AS peak_us FROM v LEFT JOIN vl USING (event_id) GROUP BY event_id)"""
CATALOG = """cat AS (SELECT *, event_id % 19 = 0 AS op, event_id % 23 = 0 AS hu, event_id % 29 = 0 AS cm, event_id % 31 = 0 AS ia,
    CASE best_nearest_class WHEN 'view' THEN 'personnel' WHEN 'click' THEN 'pumping' ELSE 'stable_rain' END AS near,
    CASE WHEN novel_scale_count >= 2 AND max_consecutive >= 2 AND (event_id % 2 = 0 OR event_id % 3 = 0) AND event_id % 19 <> 0 AND event_id % 23 <> 0 THEN 'effective_candidate'
      WHEN event_id % 19 = 0 OR event_id % 23 = 0 OR novel_scale_count = 0 THEN 'nuisance_like' ELSE 'uncertain' END AS label,
    round(least(max_ratio, 10) + 0.5 * novel_scale_count + 0.4 * max_consecutive + 0.5 * CAST(event_id % 2 = 0 AS INT) + 0.5 * CAST(event_id % 3 = 0 AS INT) + 0.5 * CAST(event_id % 4 = 0 AS INT), 4) AS score FROM votes)"""
TAGS = """tag AS (SELECT * REPLACE (CASE WHEN human_like OR cm OR ia THEN 'nuisance_like' ELSE label END AS label), CASE WHEN ia THEN 'instrument_anomaly' WHEN cm THEN 'common_mode'
    WHEN human_like THEN 'human_like' WHEN event_id % 4 = 0 THEN 'strict_candidate' WHEN event_id % 5 = 0 THEN 'local_priority' WHEN event_id % 7 = 0 THEN 'early_caution'
    ELSE 'expanded_candidate' END AS screening_pool FROM (SELECT *, op OR (near IN ('personnel', 'pumping') AND max_ratio <= 1) AS human_like FROM cat))"""
EARLY = f"""early AS (SELECT * REPLACE (CASE WHEN early_period THEN 'nuisance_like' ELSE label END AS label,
    CASE WHEN early_period AND NOT ia AND NOT cm AND NOT human_like THEN 'early_reference_period' ELSE screening_pool END AS screening_pool)
    FROM (SELECT *, peak_us >= {T0} AND peak_us < {T0 + 2 * DAY} AS early_period FROM tag))"""
BRANCH = f"WITH {DAS}, {VOTES}, {CATALOG}, {TAGS}, {EARLY}, pair AS (SELECT t.event_id, t.label AS b, e.label AS o, t.peak_us >= {T0 + 2 * DAY} AS late FROM tag t JOIN early e USING (event_id))"

ORACLES = {
    "robust_scale": f"SELECT l_returnflag, l_linestatus, round(center, 8) AS center, round(scale, 8) AS scale, n FROM {_scale_sql('lineitem', 'l_returnflag, l_linestatus', 'l_extendedprice')}",
    "robust_z_group": f"""WITH {DAS}, a AS (SELECT *, median(activity) OVER w AS m, count(*) OVER w AS n FROM das WINDOW w AS (PARTITION BY node)),
    b AS (SELECT *, median(abs(activity - m)) OVER (PARTITION BY node) AS d FROM a)
    SELECT event_id, round(CASE WHEN n >= 3 AND d > 0 THEN 0.67448975 * (activity - m) / d ELSE 0 END, 5) AS z FROM b""",
    "group_standardizer": f"""WITH {DAS}, {SCALED}, {STANDARD} SELECT k, stage, depth, round(CASE WHEN own.n >= 24 THEN own.center ELSE whole.center END, 8) AS center,
    round(CASE WHEN own.n >= 24 THEN own.scale ELSE whole.scale END, 8) AS spread, own.n AS n, CASE WHEN own.n >= 24 THEN 'group' ELSE 'fallback' END AS source FROM own JOIN whole USING (k)""",
    "group_standardize": f"""WITH {DAS}, {SCALED}, {STANDARD}, big AS (SELECT * FROM own WHERE n >= 24)
    SELECT event_id, round(greatest(-15, least(15, (activity - coalesce(big.center, whole.center)) / coalesce(big.scale, whole.scale))), 5) AS z
    FROM (SELECT * FROM s WHERE NOT ref) LEFT JOIN big USING (k, stage, depth) LEFT JOIN whole USING (k)""",
    "calibration_models": f"WITH {DAS}, {SCALED}, {CALIBRATION} SELECT stage, depth, node, round(center, 8) AS center, round(spread, 8) AS spread, n FROM cal",
    "frozen_models": f"""WITH {DAS}, {SCALED}, {CALIBRATION}, c AS (SELECT stage, depth, node, round(center, 8) AS center, round(spread, 8) AS spread FROM cal)
    SELECT * FROM c WHERE stage NOT IN (4, 5) UNION ALL SELECT t.stage, depth, node, center, spread FROM c, (VALUES (4), (5)) t(stage) WHERE c.stage = 3""",
    "detector_z": f"""WITH {DAS}, {SCALED}, {CALIBRATION}, z AS (SELECT event_id, stage, depth, coalesce((activity - center) / spread, 0) AS z0 FROM s LEFT JOIN cal USING (stage, depth, node)),
    y AS (SELECT *, z0 * ((event_id % 7) - 3) / 2.0 AS z1, z0 - (event_id % 11) AS z2 FROM z),
    x AS (SELECT *, greatest(z0, z1, z2) AS score, list_reverse_sort([z0, z1, z2])[2] AS secondary FROM y),
    f AS (SELECT *, score >= 3.5 AND (z0 > 0 OR z1 > 0) AS expanded, score >= 5 AND secondary >= 2 AS strict FROM x),
    g AS (SELECT *, avg(CAST(expanded AS INT)) OVER (PARTITION BY stage, depth) AS active_fraction FROM f)
    SELECT event_id, round(score, 5) AS score, round(secondary, 5) AS secondary, round(active_fraction, 5) AS active_fraction, expanded, strict, active_fraction > 0.25 OR z2 < -4 AS common_mode FROM g""",
    "quantile_higher": f"WITH {DAS} SELECT node, list_sort(list(activity))[CAST(ceil((count(*) - 1) * 0.95 - 1e-9) AS INT) + 1] AS critical FROM das GROUP BY node",
    "quantiles_linear": f"WITH {DAS} SELECT event_type, " + ", ".join(f"round(quantile_cont(activity, {q}), 6) AS q{int(q * 1000)}" for q in (0.025, 0.75, 0.9, 0.95, 0.99, 0.975)) + " FROM das GROUP BY 1",
    "imputed": f"WITH {DAS}, e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ln(1 + activity) END AS x FROM das) SELECT event_id, round(coalesce(x, (SELECT median(x) FROM e)), 6) AS x FROM e",
    "effect_sizes": f"""WITH {DAS}, s AS (SELECT event_type AS g, avg(activity) AS m, var_samp(activity) AS v, count(*) AS n, median(activity) AS md FROM das GROUP BY 1),
    c AS (SELECT b.event_type AS g, sum(sign(a.activity - b.activity)) / count(*) AS d FROM das a, das b WHERE a.event_type = 'purchase' AND b.event_type <> 'purchase' GROUP BY 1)
    SELECT o.g AS versus, round(t.md, 6) AS target_median, round(o.md, 6) AS reference_median, round((t.m - o.m) / sqrt((t.v + o.v) / 2), 6) AS cohens_d, round(d, 6) AS cliffs_delta,
    t.n AS target_n, o.n AS reference_n FROM s o JOIN c USING (g), s t WHERE t.g = 'purchase'""",
    "knn_noise_distance": _noise_sql("c < 3", "c >= 3"),
    "four_reference": _noise_sql("c <= 3", "c > 3"),
    "subclass_nearest": f"""WITH {VECTORS}, d AS (SELECT a.key, b.label || '/' || (b.key % 2) AS subclass, list_distance(a.x, b.x) AS d FROM v a, v b WHERE a.c >= 3 AND b.c < 3),
    i AS (SELECT *, row_number() OVER (PARTITION BY key, subclass ORDER BY d) AS i FROM d) SELECT key, subclass, round(d, 5) AS distance FROM i WHERE i = {CLASS_K}""",
    "event_screening": f"WITH {DAS}, {VOTES} SELECT event_id, novel_scale_count, max_consecutive, max_ratio, round(median_ratio, 6) AS median_ratio, best_scale, best_nearest_class FROM votes",
    "screening_labels": f"WITH {DAS}, {VOTES}, {CATALOG} SELECT event_id, label, score, row_number() OVER (ORDER BY score DESC, event_id) AS review_rank FROM cat",
    "formal_tags": f"WITH {DAS}, {VOTES}, {CATALOG}, {TAGS} SELECT event_id, human_like, label, screening_pool FROM tag",
    "early_tags": f"WITH {DAS}, {VOTES}, {CATALOG}, {TAGS}, {EARLY} SELECT event_id, early_period, label, screening_pool FROM early",
    "phase_tags": f"""WITH {DAS} SELECT event_id, CASE WHEN peak_us < {T0 + 10 * DAY} THEN 'pre' WHEN peak_us <= {T0 + 12 * DAY} THEN 'transition' ELSE 'post' END AS phase,
    round((peak_us - {T0 + 10 * DAY}) / 1e6, 6) AS signed_s FROM das""",
    "three_vs_four_transition": f"{BRANCH} SELECT b AS baseline_label, o AS other_label, count(*) AS event_count FROM pair GROUP BY ALL",
    "three_vs_four_summary": f"""{BRANCH}, m AS (SELECT count(*) FILTER (WHERE b = 'effective_candidate') AS be, count(*) FILTER (WHERE o = 'effective_candidate') AS oe,
    count(*) FILTER (WHERE late AND b = 'effective_candidate') AS lb, count(*) FILTER (WHERE late AND b = 'effective_candidate' AND o = 'effective_candidate') AS lr,
    count(*) FILTER (WHERE late AND b = 'effective_candidate' AND o <> 'effective_candidate') AS ld, count(*) FILTER (WHERE b <> o) AS ch FROM pair)
    SELECT unnest(['baseline_effective', 'other_effective', 'late_baseline_effective', 'late_retained', 'late_downgraded', 'changed', 'late_retention', 'all_retention']) AS metric,
    unnest([CAST(be AS DOUBLE), oe, lb, lr, ld, ch, round(CASE WHEN lb > 0 THEN lr / lb END, 8), round(CASE WHEN be > 0 THEN oe / be END, 8)]) AS value FROM m""",
    "top_k_per_type": f"""WITH {DAS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY activity DESC, event_id) AS i FROM das)
    SELECT event_id, event_type, activity FROM r WHERE i <= 6 UNION SELECT * FROM (SELECT event_id, event_type, activity FROM das WHERE label = 'uncertain' ORDER BY activity DESC, event_id LIMIT 8)""",
    "wide_scale_pivot": f"WITH {DAS}, {VOTES} SELECT event_id, " + ", ".join(f"max(ratio) FILTER (WHERE scale = {i}) AS ratio_{i}" for i in range(6)) + " FROM v GROUP BY event_id HAVING count(*) = 6",
    "manual_labels": "SELECT DISTINCT event_id // 6 AS event_id, CASE WHEN (event_id // 6) % 13 = 0 THEN 'm' || ((event_id // 6) % 3) ELSE 'pending' END AS manual_label FROM events",
    "nuisance_kinds": f"""WITH {DAS}, r AS (SELECT lower(trim(CASE WHEN event_id % 3 = 0 THEN ' Personnel ' ELSE event_type END)) AS k FROM das)
    SELECT CASE WHEN k = 'personnel' THEN k ELSE 'pumping' END AS two_way, CASE WHEN k = 'personnel' THEN k WHEN k IN ('view', 'click') THEN 'pumping' END AS mapped, count(*) AS n FROM r GROUP BY ALL""",
    "task_classes": f"WITH {DAS} SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'candidate' END AS task_class, count(*) AS n FROM das GROUP BY 1",
    "label_pivot": f"""WITH {DAS} SELECT node % 10 AS g, count(*) FILTER (WHERE label = 'effective_candidate') AS effective_candidate, count(*) FILTER (WHERE label = 'nuisance_like') AS nuisance_like,
    count(*) FILTER (WHERE label = 'uncertain') AS uncertain FROM das WHERE NOT (node % 10 = 3 AND label = 'uncertain') GROUP BY 1""",
}
