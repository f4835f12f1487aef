"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all runs in this process, as in tests."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir")
    if known is None:
        known = context.getCheckpointDir()
        if known is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
            known = tempfile.mkdtemp(prefix="tremorlake-")
        context._conf.set("spark.checkpoint.dir", known)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known


def gathered(frame: DataFrame) -> DataFrame:
    """The frame in at most four partitions a core, for narrow rows that are about to be written: a file for
    each shuffle partition would be many small ones, where AQE doesn't put partitions together."""
    return frame.coalesce(4 * frame.sparkSession.sparkContext.defaultParallelism)


def cut(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it from there: the lineage ends, lost executors cost nothing."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character, accented letters too, stays."""
    return F.translate(text, UPPER, LOWER)


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def written(frame: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again; smaller on disk than a checkpoint."""
    spark = frame.sparkSession
    path = f"{folder or own_folder(spark)}/{fresh_name(name)}"
    frame.write.parquet(path)
    out = spark.read.parquet(path)
    out.written_path = path
    return out


def discard(frame: DataFrame) -> None:
    """Delete the files of a frame that written() gave, once nothing reads it any more."""
    _delete(frame.sparkSession, frame.written_path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Sub-folders that scratch() has opened.
_scratch: list[str] = []


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, or of scratch() that part."""
    return "/".join([f"{shared_folder(spark)}/tremorlake-{spark.sparkContext.applicationId}", *_scratch])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators write down meanwhile is deleted in the end; nothing lazy that reads it may be used later."""
    _scratch.append(fresh_name("scratch"))
    try:
        yield
    finally:
        path = own_folder(spark)
        _scratch.pop()
        _delete(spark, path)


def clear_shared(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder, once no result that reads them is needed any more."""
    _delete(spark, own_folder(spark))
