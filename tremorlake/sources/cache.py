"""Tables that are made once: by signature, schema and rules of their rows; digests of files; a log of stages."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.checks import violations
from tremorlake.sources.sinks import stable_digest, write_manifest
from tremorlake.sources.tables import exists, read_json


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fault(spark: SparkSession, path: str, signature: Any, schema: str, rules: dict[str, Column], subset: bool = False) -> str | None:
    """Why the table at path can't be used, or None.  With subset, a manifest made with fewer settings will do, as
    long as those that it has agree."""
    if not exists(spark, f"{path}/manifest.json"):
        return "no manifest"
    told = read_json(spark, f"{path}/manifest.json")
    if told.get("digest") != stable_digest(signature):
        own = told.get("signature")
        agrees = subset and isinstance(own, dict) and isinstance(signature, dict) and own and all(signature.get(k) == v for k, v in own.items())
        if not agrees:
            return "another signature"
    try:
        df = spark.read.parquet(f"{path}/data")
    except AnalysisException:
        return "no table"
    want = spark.createDataFrame([], schema)
    if df.dtypes != want.dtypes:
        return "another schema"
    if df.count() != told.get("rows"):
        return "another number of rows"
    broken = violations(df, **rules).where("violations > 0").limit(1).collect() if rules else []
    return f"rows break {broken[0][0]}" if broken else None


def cached(spark: SparkSession, path: str, signature: Any, schema: str, make: Callable[[], DataFrame], rules: dict[str, Column] | None = None, subset: bool = False) -> DataFrame:
    """The table at path where it is sound, else made anew: written beside its place with its manifest last, and moved.

    An empty table keeps its schema.  What a lost run left beside the place is never read."""
    if fault(spark, path, signature, schema, rules or {}, subset) is not None:
        part = f"{path}.{uuid.uuid4().hex[:8]}.partial"
        want = spark.createDataFrame([], schema)
        df = make()
        df.select(*[F.col(c).cast(t).alias(c) for c, t in want.dtypes]).write.parquet(f"{part}/data")
        rows = spark.read.schema(want.schema).parquet(f"{part}/data").count()
        write_manifest(spark, f"{part}/manifest.json", {"digest": stable_digest(signature), "signature": signature, "rows": rows})
        store, target = _store(spark, path)
        store.delete(target, True)
        if not store.rename(_store(spark, part)[1], target):
            raise OSError(f"could not move {part}")
    return spark.read.parquet(f"{path}/data")


def file_digests(paths: DataFrame, path: str = "path", chunk: int = 1 << 23) -> DataFrame:
    """path, size, sha256 of files of any size, read in pieces in the executors."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for name in batch["path"]:
                store, at = fs.FileSystem.from_uri(name)
                whole, size = hashlib.sha256(), 0
                with store.open_input_stream(at) as stream:
                    while piece := stream.read(chunk):
                        whole.update(piece)
                        size += len(piece)
                yield pd.DataFrame({"path": [name], "size": [size], "sha256": [whole.hexdigest()]})

    return paths.select(F.col(path).cast("string").alias("path")).mapInPandas(digest, "path string, size long, sha256 string")


def check_digests(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """name, verdict (ok, changed, missing) of every listed file.  listed: name (below the folder), sha256."""
    root = folder.split("://", 1)[-1].rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    files = files.withColumn("name", F.expr(f"substring(path, instr(path, '{root}/') + {len(root) + 1})"))
    seen = file_digests(files.join(listed, "name", "left_semi").drop("name")).select("path", F.col("sha256").alias("seen"))
    both = listed.join(files.join(seen, "path"), "name", "left")
    return both.select("name", F.when(F.col("seen").isNull(), "missing").when(F.lower("sha256") == F.col("seen"), "ok").otherwise("changed").alias("verdict"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of a list with a digest, white space and a name in each line."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$", 1).alias("sha256"), F.regexp_replace(F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$", 2), r"^\./", "").alias("name")).where("name <> ''")


def waveform_fingerprint(blocks: DataFrame, by: Sequence[str] = ("file_name",)) -> DataFrame:
    """by, fingerprint: of the first, middle and last block of every channel, so that copies of a file show."""
    w = Window.partitionBy(*by, "channel")
    i, n = F.row_number().over(w.orderBy("block_start_ns")), F.count("*").over(w)
    placed = blocks.select(*by, "channel", "samples", i.alias("i"), n.alias("n")).where((F.col("i") == 1) | (F.col("i") == F.floor(F.col("n") / 2) + 1) | (F.col("i") == F.col("n")))
    own = F.md5(F.concat_ws(",", F.transform("samples", lambda x: F.hex(F.encode(x.cast("string"), "UTF-8")))))
    per = placed.select(*by, "channel", "i", own.alias("h")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("channel", "i", "h"))).alias("l"))
    return per.select(*by, F.md5(F.concat_ws("", F.transform("l", lambda x: x["h"]))).alias("fingerprint"))


class StageLog:
    """Seconds by stage, in order, for the manifest of a run."""

    def __init__(self) -> None:
        self.stages: list[dict[str, Any]] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began, state = time.perf_counter(), "failed"
        try:
            yield
            state = "done"
        finally:
            self.stages.append({"stage": name, "seconds": round(time.perf_counter() - began, 3), "state": state})

    def text(self) -> str:
        return "".join(json.dumps(s) + "\n" for s in self.stages)
