"""Queries and oracles of what is kept in files: tables made unit by unit, array containers, tasks read together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.operators import features
from tremorlake.plans.das import DAS, DAY, HOUR, T0, das, table
from tremorlake.sources import arrays, incremental
from tremorlake.sources.shared import shared_folder

CHANNELS = (3, 17, 40)
FIRST_ROW = 5
ANCHOR = 2 * HOUR
DAILY = "node BIGINT, event_count BIGINT, activity DOUBLE, first_us BIGINT, last_us BIGINT"


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def day_units(events: DataFrame) -> DataFrame:
    """A unit a day; its fingerprint is of the day's events in any order."""
    day = F.expr(f"peak_us div {DAY}").cast("string")
    rows = events.select(day.alias("unit"), F.xxhash64("event_id", "node", "peak_us", "activity").cast("decimal(38,0)").alias("h"))
    return rows.groupBy("unit").agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), F.sum("h").cast("string"))).alias("fingerprint"))


def daily(events: DataFrame, todo: DataFrame) -> DataFrame:
    own = events.withColumn("unit", F.expr(f"peak_us div {DAY}").cast("string")).join(todo.select("unit"), "unit")
    sums = own.groupBy("unit", "node").agg(F.count("*").alias("event_count"), F.sum(F.col("activity").cast("decimal(20,6)")).alias("activity"), F.min("peak_us").alias("first_us"), F.max("peak_us").alias("last_us"))
    return sums.withColumn("activity", F.col("activity").cast("double"))


def incremental_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of the first fortnight, and then the whole one: only days that differ are made again."""
    events, folder = das(spark, sf_dir), own_folder(spark, "days")
    rules = {"counted": F.col("event_count") > 0, "within_day": F.expr(f"first_us div {DAY}") == F.col("unit").cast("long")}
    for known in (events.where(F.col("peak_us") < T0 + 14 * DAY + DAY // 2), events):
        found = incremental.refresh(spark, folder, day_units(known), {"step": "day"}, DAILY, lambda todo, known=known: daily(known, todo), rules)
    return found.table


def array_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as containers of one array a label, rows by id; then some channels of the later rows."""
    place = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.format_string("label_%s", F.col("label").cast("string")).alias("container"), F.lit("embedding").alias("member"), (F.row_number().over(place) - 1).cast("long").alias("row"), F.col("embedding").alias("samples"), F.lit("<f4").alias("kind"))
    folder = own_folder(spark, "arrays")
    arrays.write_containers(rows, folder, compressed=False)
    read = arrays.read_containers(spark, folder, members=["embedding"], channels=CHANNELS, first=FIRST_ROW, block=16)
    each = read.select("container", "channel", "first_row", F.posexplode("samples").alias("i", "v"))
    return each.select("container", "channel", (F.col("first_row") + F.col("i")).alias("row"), F.round("v", 6).alias("v"))


def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a file that are read together: within two hours of the first one."""
    tasks = das(spark, sf_dir).select("event_id", (F.col("node") % 7).cast("string").alias("file_name"), F.col("peak_us").alias("time_us"))
    return features.anchors(tasks, ANCHOR, 1000).select("event_id", "file_name", "anchor_us")


QUERIES = {f.__name__: f for f in (incremental_days, array_slices, anchor_groups)}

ORACLES = {
    "incremental_days": f"""WITH {DAS} SELECT CAST(peak_us // {DAY} AS VARCHAR) AS unit, node, count(*) AS event_count, CAST(sum(CAST(activity AS DECIMAL(20,6))) AS DOUBLE) AS activity,
    min(peak_us) AS first_us, max(peak_us) AS last_us FROM das GROUP BY ALL""",
    "anchor_groups": f"""WITH RECURSIVE {DAS}, t AS (SELECT DISTINCT CAST(node % 7 AS VARCHAR) AS file_name, peak_us AS time_us FROM das),
    a(file_name, anchor_us) AS (SELECT file_name, min(time_us) FROM t GROUP BY 1 UNION ALL
        SELECT t.file_name, min(t.time_us) FROM a JOIN t ON t.file_name = a.file_name AND t.time_us > a.anchor_us + {ANCHOR} GROUP BY t.file_name)
    SELECT event_id, CAST(node % 7 AS VARCHAR) AS file_name, anchor_us FROM das ASOF JOIN a ON CAST(node % 7 AS VARCHAR) = a.file_name AND peak_us >= a.anchor_us""",
    "array_slices": f"""WITH r AS (SELECT 'label_' || label || '.npz' AS container, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row FROM embeddings)
    SELECT container, CAST(c AS INT) AS channel, row, round(CAST(embedding[c + 1] AS DOUBLE), 6) AS v FROM r, (VALUES {", ".join(f"({c})" for c in CHANNELS)}) t(c) WHERE row >= {FIRST_ROW}""",
}
