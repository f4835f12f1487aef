"""Event activity of a catalog that grows: minutes and positions of the days that new files touch.

    python -m jobs.activity_stream --events FOLDER --output FOLDER [--config FILE]

A file stream takes the files that its checkpoint has not seen.  Of each batch, sound records go to
OUTPUT/records, in folders by day and batch, the others with their fault to OUTPUT/rejected; then the days that the
batch touches are computed anew from all their records and overwrite their folders of OUTPUT/activity and
OUTPUT/days.  A batch that a lost run left half done is taken again under the same number and overwrites what it
wrote, so the result is the same.  Late records simply touch an older day.

An event is its id and its time.  Delivered again it counts once, with what the last batch says (within a batch,
the largest value, then position and kind); a record of another time is another event.  Values are added as
decimals of six digits, so sums do not depend on their order.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from tremorlake.checks import DataError, require_columns
from tremorlake.operators.temporal import cumulative
from tremorlake.plans.das import DAY, MINUTE, micros
from tremorlake.sources.tables import exists

log = logging.getLogger("activity_stream")
CONFIG = Path(__file__).with_suffix(".json")
RECORDS = "event_id BIGINT, node BIGINT, peak_us BIGINT, kind STRING, activity DECIMAL(20,6), day STRING, batch BIGINT"
ACTIVITY = "node BIGINT, minute_us BIGINT, event_count BIGINT, activity DOUBLE, cumulative_count BIGINT, cumulative_activity DOUBLE, day STRING"


@dataclass(frozen=True)
class Settings:
    id: str
    time: str
    position: str
    kind: str
    value: str
    #: Kinds of events that count; others are rejected.
    kinds: tuple[str, ...]
    files_per_batch: int = 100
    #: A batch that touches more days is an error: the list of days is told to the readers.
    most_days: int = 100_000


def checked(batch: DataFrame, s: Settings) -> DataFrame:
    """The records' columns and their fault, null for sound ones."""
    value = F.col(s.value).cast("double")
    sane = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < 1e14)
    rows = batch.select(
        F.col(s.id).cast("long").alias("event_id"),
        F.col(s.position).cast("long").alias("node"),
        micros(s.time).alias("peak_us"),
        F.col(s.kind).cast("string").alias("kind"),
        F.when(sane, value).cast("decimal(20,6)").alias("activity"),
    )
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("peak_us") / DAY).cast("int")), "yyyy-MM-dd")
    fault = (
        F.when(F.col("event_id").isNull(), "no id")
        .when(F.col("peak_us").isNull(), "no time")
        .when(F.col("node").isNull(), "no position")
        .when(~F.coalesce(F.col("kind").isin(*s.kinds), F.lit(False)), "kind")
        .when(F.col("activity").isNull(), "value")
    )
    return rows.withColumns({"day": day, "fault": fault})


def minutes(records: DataFrame) -> DataFrame:
    """Counts and sums of each day, position and minute, with their totals since the day began."""
    last = F.struct("batch", "activity", "node", "kind")
    events = records.groupBy("day", "event_id", "peak_us").agg(F.max(last).alias("last")).select("day", "peak_us", "last.node", "last.activity")
    cells = events.groupBy("day", "node", (F.floor(F.col("peak_us") / MINUTE) * MINUTE).cast("long").alias("minute_us")).agg(F.count("*").alias("event_count"), F.sum("activity").alias("activity"))
    total = cumulative(cells, ["minute_us"], {"cumulative_count": "event_count", "cumulative_activity": "activity"}, ["day", "node"])
    return total.select("node", "minute_us", "event_count", F.col("activity").cast("double").alias("activity"), "cumulative_count", F.col("cumulative_activity").cast("double").alias("cumulative_activity"), "day")


def by_day(activity: DataFrame) -> DataFrame:
    return activity.groupBy("day").agg(F.sum("event_count").alias("event_count"), F.count_distinct("node").alias("positions"), F.count("*").alias("cells"), F.min("minute_us").alias("first_minute_us"), F.max("minute_us").alias("last_minute_us"))


def replace_partitions(frame: DataFrame, path: str, *by: str) -> None:
    """Only the folders that the frame has rows of are overwritten, whatever the session's setting is."""
    frame.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(batch: DataFrame, number: int, output: str, s: Settings) -> None:
    spark = batch.sparkSession
    rows = checked(batch, s).withColumn("batch", F.lit(number).cast("long"))
    read, bad = rows.agg(F.count("*"), F.count("fault")).first()
    if not read:
        log.info("batch %d: nothing to read", number)
        return
    replace_partitions(rows.where("fault IS NOT NULL"), f"{output}/rejected", "batch")
    replace_partitions(rows.where("fault IS NULL").drop("fault"), f"{output}/records", "day", "batch")
    if read == bad:
        log.info("batch %d: read %d records, all rejected", number, read)
        return
    touched = [r[0] for r in rows.where("fault IS NULL").select("day").distinct().limit(s.most_days + 1).collect()]  # days of one batch
    if len(touched) > s.most_days:
        raise DataError(f"batch {number} touches over {s.most_days} days")
    records = spark.read.schema(RECORDS).parquet(f"{output}/records").where(F.col("day").isin(touched))
    replace_partitions(minutes(records), f"{output}/activity", "day")
    written = spark.read.schema(ACTIVITY).parquet(f"{output}/activity").where(F.col("day").isin(touched))
    replace_partitions(by_day(written), f"{output}/days", "day")
    cells = written.count()
    log.info("batch %d: read %d records, rejected %d, wrote %d cells of %d days", number, read, bad, cells, len(touched))


def pattern(path: str) -> str:
    """A glob that only the path itself matches: without one a file stream takes folders only."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[]{}") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, events: str, output: str, s: Settings) -> DataFrame:
    """Takes what is new of the Parquet files at events, and returns the activity of all days so far."""
    schema = require_columns(spark.read.parquet(events), (s.id, s.time, s.position, s.kind, s.value), events).schema
    log.info("reading %s into %s", events, output)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", s.files_per_batch).parquet(pattern(events))
    running = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, output, s)).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return result(spark, output)


def result(spark: SparkSession, output: str) -> DataFrame:
    """Empty before the first sound record."""
    if not exists(spark, f"{output}/activity"):
        return spark.createDataFrame([], ACTIVITY)
    return spark.read.schema(ACTIVITY).parquet(f"{output}/activity")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--events", required=True, help="a folder of Parquet files that grows")
    p.add_argument("--output", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(argv)
    settings.show_log()
    from tremorlake.session import get_spark

    spark = get_spark()
    try:
        run(spark, a.events, a.output, settings.load(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
