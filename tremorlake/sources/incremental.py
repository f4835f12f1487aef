"""Tables made unit by unit: what a changed source touches is made again, the rest stays.

A unit is a source file, or a batch of files with its neighbours.  Its fingerprint says which version of its
sources a result is of.  Below the folder of the settings' digest, `data` holds the rows in one folder a unit and
`manifest` a row a unit: fingerprint, number of rows and a digest of them.  A unit is made again when it is new,
when its fingerprint is another, or when its rows are not those of the manifest or break a rule.  Rows carry their
fingerprint, so what a unit had before never counts, even where the new version has no rows at all.

A refresh that is lost leaves units whose rows and manifest disagree; the next one makes those again.  Only one
refresh of a table may run at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.checks import DataError
from tremorlake.sources.shared import cut
from tremorlake.sources.sinks import stable_digest
from tremorlake.sources.tables import exists

MANIFEST = "fingerprint STRING, rows BIGINT, digest DECIMAL(38,0), unit STRING"


@dataclass(frozen=True)
class Refreshed:
    table: DataFrame
    #: unit, reason of what was made this time.
    made: DataFrame


def file_units(files: DataFrame, name: str = "name") -> DataFrame:
    """unit, fingerprint of each file by its name, size and time of change."""
    return files.select(F.col(name).alias("unit"), F.md5(F.concat_ws("|", name, "size", F.col("modified").cast("string"))).alias("fingerprint"))


def batch_units(units: DataFrame, order: Column, size: int, halo: int = 1) -> tuple[DataFrame, DataFrame]:
    """Batches of so many units in order: (unit, fingerprint) of each batch over its own and halo neighbours on both
    sides, and (unit, member, core) of what it reads.  The list of source files is numbered as a whole."""
    placed = units.withColumn("i", F.row_number().over(Window.orderBy(order, "unit")) - 1)
    near = F.array_distinct(F.transform(F.array(F.col("i") - halo, F.col("i"), F.col("i") + halo), lambda i: F.floor(i / size).cast("long")))
    last = placed.agg(F.max(F.floor(F.col("i") / size).cast("long")).alias("last"))
    spread = placed.withColumn("batch", F.explode(near)).join(F.broadcast(last), (F.col("batch") >= 0) & (F.col("batch") <= F.col("last")))  # one row
    label = F.format_string("batch_%06d", F.col("batch"))
    members = spread.select(label.alias("unit"), F.col("unit").alias("member"), (F.floor(F.col("i") / size) == F.col("batch")).alias("core"), "fingerprint")
    told = members.groupBy("unit").agg(F.md5(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(":", "member", "fingerprint", F.col("core").cast("string")))))).alias("fingerprint"))
    return told, members.select("unit", "member", "core")


def _digest(columns: list[str]) -> Column:
    """Of a unit's rows in any order."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest")


def _replace(frame: DataFrame, path: str) -> None:
    """Only the units that the frame has rows of."""
    frame.repartition("unit").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit").parquet(path)


def faults(data: DataFrame, manifest: DataFrame, columns: list[str], rules: dict[str, Column]) -> DataFrame:
    """unit, reason of units whose rows are not those that the manifest tells of, or break a rule."""
    broken = F.array_compact(F.array(*[F.when(F.count_if(~F.coalesce(rule, F.lit(False))) > 0, F.lit(f"rows break {name}")) for name, rule in rules.items()])) if rules else F.array().cast("array<string>")
    seen = data.groupBy("unit", "fingerprint").agg(F.count("*").alias("seen"), _digest(columns).alias("seen_digest"), broken.alias("broken"))
    both = manifest.join(seen, ["unit", "fingerprint"], "left")
    reason = (
        F.when(F.coalesce("seen", F.lit(0)) != F.col("rows"), "another number of rows")
        .when(~F.col("seen_digest").eqNullSafe(F.col("digest")), "other rows")
        .when(F.size("broken") > 0, F.get("broken", F.lit(0)))
    )
    return both.select("unit", reason.alias("reason")).where("reason IS NOT NULL")


def refresh(spark: SparkSession, path: str, units: DataFrame, signature: Any, schema: str, make: Callable[[DataFrame], DataFrame], rules: dict[str, Column] | None = None) -> Refreshed:
    """The table of all units, those that are new, changed or unsound made by make(unit, fingerprint): rows with unit
    and the schema's columns.  Units that are no longer listed are left out."""
    folder = f"{path.rstrip('/')}/{stable_digest(signature)}"
    stored = f"{schema}, fingerprint STRING, unit STRING"
    want = spark.createDataFrame([], stored)
    columns = want.columns[:-2]
    listed = cut(units.select("unit", "fingerprint"))
    twice = listed.groupBy("unit").count().where("count > 1 OR unit IS NULL").limit(1).collect()
    if twice:
        raise DataError(f"unit {twice[0][0]} is listed {twice[0][1]} times")

    def read(part: str, kind: str, damaged: bool = False) -> DataFrame:
        at = f"{folder}/{part}"
        return spark.read.schema(kind).option("ignoreCorruptFiles", damaged).parquet(at) if exists(spark, at) else spark.createDataFrame([], kind)

    # a file that can't be read is missing rows
    data, manifest = read("data", stored, True), read("manifest", MANIFEST)
    known = manifest.select("unit", F.col("fingerprint").alias("known"))
    bad = faults(data, manifest, columns, rules or {})
    reason = F.when(F.col("known").isNull(), "new").when(F.col("known") != F.col("fingerprint"), "changed").otherwise(F.col("reason"))
    todo = cut(listed.join(known, "unit", "left").join(bad, "unit", "left").select("unit", "fingerprint", reason.alias("reason")).where("reason IS NOT NULL"))
    if not todo.isEmpty():
        rows = make(todo.select("unit", "fingerprint"))
        typed = rows.select("unit", *[F.col(c).cast(f.dataType).alias(c) for c, f in zip(columns, want.schema.fields, strict=False)])
        _replace(typed.join(todo.select("unit", "fingerprint"), "unit").select(*want.columns), f"{folder}/data")
        written = read("data", stored).join(todo.select("unit", "fingerprint"), ["unit", "fingerprint"], "left_semi")
        counts = written.groupBy("unit").agg(F.count("*").alias("rows"), _digest(columns))
        told = todo.join(counts, "unit", "left").select("fingerprint", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "digest", "unit")
        _replace(told, f"{folder}/manifest")
    table = read("data", stored).join(listed, ["unit", "fingerprint"], "left_semi")
    return Refreshed(table.select("unit", *columns), todo.select("unit", "reason"))
