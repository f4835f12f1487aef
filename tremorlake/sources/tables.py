"""Readers: explicit schemas, files by name, layouts with their channel offset, records inventories."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.checks import DataError, require_columns


def exists(spark: SparkSession, path: str) -> bool:
    """By Hadoop's own file systems, so any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def require_files(spark: SparkSession, **paths: str) -> None:
    missing = [f"{label} ({path})" for label, path in paths.items() if not exists(spark, path)]
    if missing:
        raise DataError("missing inputs: " + ", ".join(missing))


def read_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """CSV or CSV.GZ with a header, a byte-order mark or not; columns by name, so their order is free."""
    header = spark.read.csv(path, header=True)
    require_columns(header, required, path)
    kinds = dict(part.strip().split(" ", 1) for part in _split(schema))
    return header.select(*[typed(F.col(f"`{c}`"), kinds.get(c, "string")).alias(c) for c in header.columns])


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def typed(value: Column, kind: str) -> Column:
    """Mixed timestamp formats, truthy flags and tolerant numbers."""
    if kind == "boolean":
        return F.lower(F.trim(value)).isin("true", "1", "yes", "y")
    if kind == "timestamp_ntz":
        return value.try_cast("timestamp_ntz")
    return value if kind == "string" else value.try_cast(kind)


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    """A configuration, small by nature."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def discover(spark: SparkSession, folder: str, suffix: str, recursive: bool = True, exclude: str | None = None) -> DataFrame:
    """path, name, size, modified of the files with that suffix; nothing of their contents is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    out = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out if exclude is None else out.where(~F.col("path").contains(exclude))


def name_timestamp_ns(name: Column) -> Column:
    """Nanoseconds of yyyy-MM-ddTHHmmss(.fraction) or yyyyMMdd_HHmmss in a file name; an offset is ignored."""
    p = r"(\d{4})-?(\d{2})-?(\d{2})[T_ ]?(\d{2})[:.\-]?(\d{2})[:.\-]?(\d{2})(?:[.,](\d{1,9}))?"
    part = [F.regexp_extract(name, p, i) for i in range(1, 8)]
    text = F.concat(part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit(" "), part[3], F.lit(":"), part[4], F.lit(":"), part[5])
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), text.try_cast("timestamp_ntz"))
    return seconds * 1_000_000_000 + F.rpad(part[6], 9, "0").try_cast("bigint")


def declared_band(parameters: Column) -> Column:
    """[low, high] in hertz of a file's processing record (JSON with bandpass_hz), null where it names no band."""
    band = F.from_json(parameters, "bandpass_hz array<double>")["bandpass_hz"]
    return F.when((F.size(band) == 2) & ~F.exists(band, lambda v: v.isNull()), band)


def check_records(records: DataFrame, fs: float | None = None, band: tuple[float, float] | None = None) -> DataFrame:
    """check, violations: one sampling rate, one channel count and one first channel for all files; the expected rate
    and, for files with a band column, the expected band; and that every file declares its rate and band."""
    one = records.agg(*[(F.greatest(F.count_distinct(c), F.lit(1)) - 1).alias(c) for c in ("fs", "channel_count", "start_channel")])
    out = one.select(F.expr("stack(3, 'fs', fs, 'channel_count', channel_count, 'start_channel', start_channel) AS (check, violations)"))
    told = lambda name, ok: records.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations")).select(F.lit(name).alias("check"), "violations")
    out = out.unionByName(told("fs_declared", F.col("fs").isNotNull() & ~F.isnan(F.col("fs").cast("double"))))
    if fs is not None:
        out = out.unionByName(told("fs_expected", F.round("fs", 9) == round(fs, 9)))
    if "band" in records.columns:
        out = out.unionByName(told("band_declared", F.col("band").isNotNull()))
        if band is not None:
            out = out.unionByName(told("band_expected", (F.col("band")[0] == band[0]) & (F.col("band")[1] == band[1])))
    return out


def layout_with_offset(layout: DataFrame, start: int, count: int, channel: str = "channel") -> DataFrame:
    """data_channel from 0: the layout's own numbers where they all fit, else those less the first channel.

    Duplicates and numbers out of range are errors; coordinate_valid tells rows whose place is known."""
    own = layout.withColumn("__c", F.col(channel).try_cast("int"))
    seen = own.agg(F.count("*").alias("n"), F.count("__c").alias("k"), F.count_distinct("__c").alias("d"), F.min("__c").alias("low"), F.max("__c").alias("high")).first()
    if seen["k"] != seen["n"] or seen["d"] != seen["n"]:
        raise DataError("layout channels must be distinct integers")
    shift = 0 if seen["n"] == 0 or (seen["low"] >= 0 and seen["high"] < count) else start
    if seen["n"] and not (0 <= seen["low"] - shift and seen["high"] - shift < count):
        raise DataError(f"layout channels {seen['low']} to {seen['high']} lie outside the cable")
    valid = F.lit(True)
    for c in ("x_cm", "y_cm", "z_cm", "burial_depth_cm"):
        if c in layout.columns:
            valid = valid & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return own.withColumn("data_channel", F.col("__c") - shift).withColumn("coordinate_valid", valid).drop("__c")


def all_channels(layout: DataFrame, count: int, channel: str = "data_channel", filler: str = "leadin_unlisted") -> DataFrame:
    """Every channel of the cable, listed or not."""
    whole = layout.sparkSession.range(count).select(F.col("id").cast("int").alias(channel))
    return whole.join(layout.withColumn("listed", F.lit(True)), channel, "left").withColumn("segment_id", F.coalesce("segment_id", F.lit(filler))).na.fill({"listed": False})


def locate(times: DataFrame, records: DataFrame, time: str = "time_ns", limit_s: float = 600.05) -> DataFrame:
    """The file that a time falls in: the last that starts at or before it, within the limit; else null.

    A file can hold times of its own bucket, as wide as the limit, and of the next one.  Within a bucket each file
    reaches up to the next one's start, so a time meets one file at most."""
    width = round(limit_s * 1e9)
    own = F.floor(F.col("start_ns") / width).cast("long")
    files = records.select("start_ns", F.col("file_name").alias("__file"), F.explode(F.array(own, own + 1)).alias("__bucket"))
    w = Window.partitionBy("__bucket").orderBy("start_ns", "__file")
    files = files.select("__bucket", "__file", F.col("start_ns").alias("__start"), F.least(F.lead("start_ns").over(w), F.col("start_ns") + width).alias("__end"))
    asked = times.withColumn("__at", F.floor(F.col(time) / width).cast("long"))
    inside = (F.col("__at") == F.col("__bucket")) & (F.col(time) >= F.col("__start")) & (F.col(time) < F.col("__end"))
    return asked.join(files, inside, "left").withColumnRenamed("__file", "file_name").drop("__at", "__bucket", "__start", "__end")
