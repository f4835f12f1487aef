"""Writers: tables by Spark's own commit protocol; small reports and manifests by the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_small_csv(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One file with a byte-order mark for spreadsheets; refused above that many rows."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use write_csv")
    rows.to_csv(path, index=False, encoding="utf-8-sig")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside its place and renamed, in any store that Hadoop reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".partial")
    store = target.getFileSystem(conf)
    stream = store.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    store.delete(target, False)
    if not store.rename(part, target):
        raise OSError(f"could not rename {path}.partial")


def write_manifest(spark: SparkSession, path: str, content: dict[str, Any]) -> None:
    write_text(spark, path, json.dumps(content, indent=2, default=str, sort_keys=True) + "\n")


def stable_digest(content: Any) -> str:
    """16 hex digits of a configuration, for the names of intermediate tables."""
    return hashlib.sha256(json.dumps(content, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_snapshots(snapshots: DataFrame, path: str, time: str = "snapshot_us") -> None:
    """One folder a snapshot with headerless tab-separated x, y, z, value, ordered by z, y, x, 12 digits."""
    value = F.format_string("%.12g", F.col("value").cast("double"))
    rows = snapshots.select(time, "x_cm", "y_cm", "z_cm", value.alias("value"))
    ordered = rows.repartition(time).sortWithinPartitions(time, "z_cm", "y_cm", "x_cm")
    ordered.write.mode("overwrite").partitionBy(time).option("sep", "\t").option("header", False).csv(path)


def snapshot_index(snapshots: DataFrame, step: int, first: int, time: str = "snapshot_us") -> DataFrame:
    """Each snapshot's folder, rows, and whether it is a partial step."""
    out = snapshots.groupBy(time).agg(F.count("*").alias("rows"))
    return out.select(time, F.concat(F.lit(f"{time}="), F.col(time)).alias("folder"), "rows", (F.pmod(F.col(time) - first, F.lit(step)) != 0).alias("partial"))


def write_template(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def review_template(catalog: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns there are, and those that reviewers fill in."""
    have = [c for c in columns if c in catalog.columns]
    extra = {c: F.lit(v) for c, v in (("manual_label", "pending"), ("manual_confidence", ""), ("manual_reviewer", ""), ("manual_notes", "")) if c not in have}
    return catalog.select(*have).withColumns(extra)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report table from a frame of a few rows."""
    rows = df.limit(most).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"
