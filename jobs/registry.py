"""The jobs as queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import activity_stream, settings, text_quality
from tremorlake.sources.shared import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice into one folder: the second run finds nothing new."""
    output, s = _folder(spark, "activity"), settings.load(activity_stream.Settings, activity_stream.CONFIG)
    activity_stream.run(spark, f"{sf_dir}/events.parquet", output, s)
    return activity_stream.run(spark, f"{sf_dir}/events.parquet", output, s)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice into one folder: the second run overwrites with the same."""
    output, s = _folder(spark, "text_quality"), settings.load(text_quality.Settings, text_quality.CONFIG)
    text_quality.run(spark, f"{sf_dir}/documents.parquet", output, s)
    return text_quality.run(spark, f"{sf_dir}/documents.parquet", output, s)


QUERIES = {"job1_activity_stream": activity, "job2_text_quality": quality}

HARD = """[CASE WHEN nonfinite_fraction > 0.01 THEN 'NONFINITE' END, CASE WHEN zero_fraction > 0.99 THEN 'ZERO_OR_DEAD' END, CASE WHEN saturation_fraction > 0.05 THEN 'SATURATED' END,
      CASE WHEN flat_fraction > 0.99 THEN 'FLATLINE' END, CASE WHEN coalesce(std = 0, true) THEN 'NO_VARIANCE' END]"""
ORACLES = {
    "job1_activity_stream": """
WITH e AS (SELECT event_id, user_id AS node, epoch_us(ts) AS peak_us, value, row_number() OVER (PARTITION BY event_id, ts ORDER BY value DESC, user_id DESC, event_type DESC) AS i
  FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND event_type IN ('click', 'error', 'purchase', 'signup', 'view') AND value >= 0 AND value < 1e14),
c AS (SELECT strftime(make_timestamp(peak_us), '%Y-%m-%d') AS day, node, peak_us // 60000000 * 60000000 AS minute_us, count(*) AS event_count, sum(CAST(value AS DECIMAL(20,6))) AS activity FROM e WHERE i = 1 GROUP BY ALL)
SELECT node, minute_us, event_count, activity::DOUBLE AS activity, (sum(event_count) OVER w)::BIGINT AS cumulative_count, (sum(activity) OVER w)::DOUBLE AS cumulative_activity, day
FROM c WINDOW w AS (PARTITION BY day, node ORDER BY minute_us)
""",
    "job2_text_quality": rf"""
WITH t AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w, string_split(text, chr(10)) AS lines FROM t),
x AS (SELECT *, len(w) AS n, list_transform(w, lambda v: length(v)::DOUBLE) AS x FROM w),
y AS (SELECT *, list_sum(x) / nullif(n, 0) AS mean FROM x),
m AS (SELECT doc_id, source, lang, n AS words,
    CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\x00-\x08\x0E-\x1F\x7F\x{{FFFD}}]', '', 'g')) / length(text) ELSE 0 END AS nonfinite_fraction,
    len(list_filter(lines, lambda v: trim(v, ' ') = '')) / len(lines) AS zero_fraction,
    CASE WHEN n > 0 THEN len(list_filter(x, lambda v: v >= 40)) / n ELSE 0 END AS saturation_fraction,
    CASE WHEN n > 1 THEN len(list_filter(range(1, n), lambda i: w[i] = w[i + 1])) / (n - 1) ELSE 0 END AS flat_fraction,
    coalesce(list_max(list_transform(range(1, n), lambda i: abs(x[i + 1] - x[i]))), 0) AS max_jump,
    list_sum(list_transform(x, lambda v: (v - mean) ** 2)) / nullif(n, 0) AS m2, list_sum(list_transform(x, lambda v: (v - mean) ** 4)) / nullif(n, 0) AS m4 FROM y),
s AS (SELECT *, sqrt(m2) AS std, m4 / nullif(m2 * m2, 0) AS kurtosis, log10(greatest(coalesce(sqrt(m2), 0), 2.2250738585072014e-308)) AS log_std FROM m),
a1 AS (SELECT *, median(log_std) OVER (PARTITION BY source) AS c1, count(*) OVER (PARTITION BY source) AS n1, median(log_std) OVER (PARTITION BY source, lang) AS c2, count(*) OVER (PARTITION BY source, lang) AS n2 FROM s),
a2 AS (SELECT *, median(abs(log_std - c1)) OVER (PARTITION BY source) AS d1, median(abs(log_std - c2)) OVER (PARTITION BY source, lang) AS d2 FROM a1),
z AS (SELECT *, CASE WHEN n1 >= 3 AND d1 > 0 THEN 0.67448975 * (log_std - c1) / d1 ELSE 0 END AS std_z, CASE WHEN n2 >= 8 AND d2 > 0 THEN 0.67448975 * (log_std - c2) / d2 ELSE 0 END AS group_z FROM a2),
r AS (SELECT *, list_filter({HARD}, lambda v: v IS NOT NULL) AS hard,
    list_filter([CASE WHEN std > 0 AND std_z < -6 THEN 'LOW_NOISE_OUTLIER' END, CASE WHEN std > 0 AND std_z > 6 THEN 'HIGH_NOISE_OUTLIER' END, CASE WHEN kurtosis > 100 THEN 'IMPULSIVE_KURTOSIS' END, CASE WHEN std > 0 AND max_jump / std > 50 THEN 'ABRUPT_JUMP' END], lambda v: v IS NOT NULL) AS odd,
    list_filter([CASE WHEN group_z < -6 THEN 'LOW_STD_WITHIN_LAYOUT_GROUP' END, CASE WHEN group_z > 6 THEN 'HIGH_STD_WITHIN_LAYOUT_GROUP' END, CASE WHEN kurtosis > 100 THEN 'HIGH_KURTOSIS_REVIEW' END, CASE WHEN std > 0 AND max_jump / std > 50 THEN 'ABRUPT_JUMP_REVIEW' END], lambda v: v IS NOT NULL) AS review FROM z)
SELECT doc_id, source, words, round(std, 6) AS std, round(kurtosis, 4) AS kurtosis, round(std_z, 4) AS std_z, round(group_z, 4) AS group_z, array_to_string(list_concat(hard, odd), ';') AS bad_reasons,
  array_to_string(hard, ';') AS hard_reasons, array_to_string(review, ';') AS review_reasons, CASE WHEN max(len(hard)) OVER (PARTITION BY source) > 0 THEN 'WARN' ELSE 'PASS' END AS source_status,
  CASE WHEN len(hard) > 0 THEN 'HARD_BAD' WHEN len(review) > 0 THEN 'REVIEW' ELSE 'PASS' END AS qc_class, lang FROM r
""",
}
