"""The driver's tables as an event catalog: users are nodes and channels of a grid, values are activities.

The same view in both dialects: Spark for the queries, DuckDB for their oracles.  Times are microseconds
since 1970 as BIGINT, so no session's time zone and no rounding to microseconds comes between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
#: 2024-01-01, the catalog's first day.
T0 = 1_704_067_200_000_000
T_END = T0 + 30 * DAY
STAGE_DAYS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def label_of(event_type: str) -> Column:
    t = F.col(event_type)
    return F.when(t.isin("purchase", "signup"), "effective_candidate").when(t == "view", "uncertain").otherwise("nuisance_like")


def das(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("node"), micros("ts").alias("peak_us"), F.round(F.col("value") * 60000).cast("long").alias("half_ms"), F.col("value").alias("activity"), "event_type")
    return e.select(
        "event_id",
        "node",
        "peak_us",
        (F.col("peak_us") - F.col("half_ms") * 1000).alias("start_us"),
        (F.col("peak_us") + F.col("half_ms") * 1000).alias("end_us"),
        "activity",
        "event_type",
        label_of("event_type").alias("label"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor dimension: grid coordinates of every user.  35 cm reach the neighbours along axes and diagonals."""
    n = table(spark, sf_dir, "events").select(F.col("user_id").alias("node")).distinct()
    return n.select(
        "node",
        ((F.col("node") % 10) * 20).cast("double").alias("x_cm"),
        ((F.expr("node div 10") % 10) * 20).cast("double").alias("y_cm"),
        (F.expr("node div 100") * 20).cast("double").alias("z_cm"),
        (F.col("node") % 3).alias("stratum"),
        F.when(F.col("node") % 4 == 0, "line").otherwise("ring").alias("geometry_type"),
        F.element_at(F.array(*[F.lit(float(d)) for d in (2, 20, 50, 80)]), (F.col("node") % 4 + 1).cast("int")).alias("burial_depth_cm"),
    )


DAS = """das AS (SELECT event_id, user_id AS node, epoch_us(ts) AS peak_us,
  epoch_us(ts) - CAST(round(value * 60000) AS BIGINT) * 1000 AS start_us, epoch_us(ts) + CAST(round(value * 60000) AS BIGINT) * 1000 AS end_us,
  value AS activity, event_type,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'effective_candidate' WHEN event_type = 'view' THEN 'uncertain' ELSE 'nuisance_like' END AS label
  FROM events)"""

NODES = """nodes AS (SELECT node, CAST((node % 10) * 20 AS DOUBLE) AS x_cm, CAST(((node // 10) % 10) * 20 AS DOUBLE) AS y_cm,
  CAST((node // 100) * 20 AS DOUBLE) AS z_cm, node % 3 AS stratum, CASE WHEN node % 4 = 0 THEN 'line' ELSE 'ring' END AS geometry_type,
  CAST(list_extract([2.0, 20.0, 50.0, 80.0], CAST(node % 4 + 1 AS INT)) AS DOUBLE) AS burial_depth_cm
  FROM (SELECT DISTINCT user_id AS node FROM events))"""
