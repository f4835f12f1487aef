"""Exact dedup against a persistent digest index.

The index is a folder with one row per distinct normalised text, bucketed and sorted by its digest.  New data
is digested, reduced to one row per digest (map-side first, so a text that fills a third of the rows costs
one row a task), anti-joined with the index by sort-merge over the buckets, and what is new is appended.  The
index is found by its path, in whatever session; it grows to more buckets with its rows.  Rows of a call count
for others once the call has ended, so one that dies on the way changes nothing; a call with the name of an
earlier one takes its place, which makes reruns safe.  One call at a time may write to an index.

Defined cases: a null text is an empty text; of repeated rows with one id one row stays; rows with a null
id sort after all others of their group; an empty batch appends nothing; other columns are left alone,
whatever their names.  On a kept index a text of an earlier call has that call's keep_id and none of its new
rows stays, whatever their ids; group_size counts the rows of the call at hand.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import SPACE_CLASS, cut, fresh_name, gathered, own_folder, table, text_of

#: Rows that a bucket of the index should hold; at four times as many it is written anew with more buckets.
BUCKET_ROWS = 1_000_000


def digest(text: str = "text") -> Column:
    """SHA-256 of the text with each run of white space as one space, lowercase hex."""
    return F.sha2(F.regexp_replace(text_of(text), f"{SPACE_CLASS}+", " "), 256)


class DigestIndex:
    """(digest, keep_id, run, keep_row), bucketed and sorted by digest, in the folder buckets-<n> of its path.

    A folder counts once whole-<n> lies beside it, and a row once its call is named in done/, so what a lost call
    wrote is never read; the next growth leaves it behind."""

    COLUMNS = "digest STRING, keep_id BIGINT, run STRING, keep_row BIGINT"

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def buckets(self) -> int | None:
        """How many there are; None before the first row."""
        files, path = self._files()
        if not files.exists(path):
            return None
        found = [x.getPath().getName() for x in files.listStatus(path)]
        whole = [int(name[8:]) for name in found if name.startswith("buckets-") and f"whole-{name[8:]}" in found]
        return max(whole, default=None)

    def _table(self, buckets: int) -> str:
        """The catalog's name for the folder: an external table, so that dropping it leaves the files."""
        folder = f"{self.path}/buckets-{buckets}"
        name = f"digest_index_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
        if self.spark.catalog.tableExists(name):
            self.spark.catalog.refreshTable(name)
        else:
            self.spark.sql(f"CREATE TABLE {name} ({self.COLUMNS}) USING PARQUET CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'")
        return name

    def done(self, own: str | None = None) -> list[str]:
        """The attempts whose rows count, the last of each run, and own in place of its run's earlier ones."""
        files, path = self._files()
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        names = sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []
        last = {name.rsplit("@", 1)[0]: name for name in [*names, *([own] if own else [])]}
        return list(last.values())

    def read(self, own: str | None = None) -> DataFrame:
        """The rows of calls that ended, and of the one at hand."""
        n = self.buckets()
        if not n:
            return self.spark.createDataFrame([], self.COLUMNS)
        calls = self.spark.createDataFrame([(x,) for x in self.done(own)], "run STRING")
        return self.spark.table(self._table(n)).join(F.broadcast(calls), "run", "left_semi").select("digest", "keep_id", "run", "keep_row")  # a row a call

    def _mark(self, name: str) -> None:
        files, _ = self._files()
        files.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True).close()

    def _remove(self, name: str) -> None:
        files, _ = self._files()
        files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def end(self, own: str) -> None:
        """From here on the attempt's rows count for other calls."""
        self._mark(f"done/{own}")
        files, _ = self._files()
        for x in files.listStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")):
            name = x.getPath().getName()
            if name != own and name.rsplit("@", 1)[0] == own.rsplit("@", 1)[0]:
                self._remove(f"done/{name}")

    def _write(self, rows: DataFrame, buckets: int) -> None:
        ordered = rows.repartition(buckets, "digest").select("digest", "keep_id", "run", "keep_row")
        name = self._table(buckets)
        ordered.write.mode("append").bucketBy(buckets, "digest").sortBy("digest").option("path", f"{self.path}/buckets-{buckets}").saveAsTable(name, format="parquet")
        self.spark.catalog.refreshTable(name)

    def append(self, digests: DataFrame, own: str) -> None:
        """digests: doc_id, row_id, digest.  Adds the digests that the index has not; the smallest (doc_id, row_id) stays."""
        # nulls sort first in a struct's minimum, so a flag puts them last
        order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_id")
        new = digests.groupBy("digest").agg(F.min(order).alias("first"))
        new = new.select("digest", F.col("first.doc_id").cast("long").alias("keep_id"), F.lit(own).alias("run"), F.col("first.row_id").alias("keep_row"))
        now = self.buckets()
        if now:
            new = new.repartition(now, "digest").join(self.read(own).select("digest").hint("merge"), "digest", "left_anti")
        # what is new is written down once: it is counted, and a failed append can be told from a whole one
        new = cut(gathered(new))
        added = new.count()
        if not added and now:
            return
        rows = added + (self.read(own).count() if now else 0)
        wanted = max(8, -(-rows // self.bucket_rows))
        if now and wanted <= 4 * now:
            self._write(new, now)
            return
        wanted *= 2 if now else 1
        # what a lost call left in the place of the new folder, which has no mark
        self._forget(wanted)
        self._write(self.read(own).unionByName(new) if now else new, wanted)
        self._mark(f"whole-{wanted}")
        if now:
            self._forget(now)

    def _forget(self, buckets: int) -> None:
        self._remove(f"whole-{buckets}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(buckets)}")
        self._remove(f"buckets-{buckets}")

    def drop(self) -> None:
        n = self.buckets()
        if n:
            self._forget(n)
        files, path = self._files()
        files.delete(path, True)


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_id, digest), written down so that row_id means the same row from here on."""
    return cut(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), digest(text_col).alias("digest")))


def resolve(rows: DataFrame, index: DigestIndex, own: str) -> DataFrame:
    """Each row with keep_id, group_size and kept.  The last join's large groups can be split by AQE: both sides are plain exchanges."""
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = sizes.join(index.read(own), "digest")
    # the derived key makes both sides plain exchanges; a repartition would keep AQE from splitting
    groups = groups.select(F.col("digest").alias("_digest"), F.crc32("digest").alias("_part"), "keep_id", F.when(F.col("run") == own, F.col("keep_row")).alias("keep_row"), "group_size")
    both = rows.withColumn("part", F.crc32("digest")).join(groups, (F.col("part") == F.col("_part")) & (F.col("digest") == F.col("_digest")))
    return both.withColumn("kept", F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)))


def split_in_batches(rows: DataFrame) -> list[DataFrame]:
    """Older and newer half by id, as an index would meet them; null ids come last."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or low == high:
        return [rows]
    middle = (int(low) + int(high)) // 2
    return [rows.where(F.col("doc_id") <= middle), rows.where((F.col("doc_id") > middle) | F.col("doc_id").isNull())]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_path: str | None = None, bucket_rows: int = BUCKET_ROWS, run: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too.

    With an index_path (in a store that all executors see) the index stays, and the texts of earlier calls count;
    without one it is of this call alone and is deleted in the end.  run names the call, for one that may be repeated."""
    spark = docs.sparkSession
    rows = digested(docs, id_col, text_col)
    own = f"{run or fresh_name('run')}@{time.time_ns():020d}"
    index = DigestIndex(spark, index_path or f"{own_folder(spark)}/{fresh_name('digest_index')}", bucket_rows)
    for batch in split_in_batches(rows):
        index.append(batch, own)
    out = resolve(rows, index, own).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
    out = cut(gathered(out))
    if index_path is None:
        index.drop()
    else:
        index.end(own)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text an earlier id has; all columns as they were.

    Rows that repeat both id and text are told apart by nothing else, so such a group is reduced by
    dropDuplicates, and only where there is one."""
    rows = exact_dedup(docs, id_col, text_col)
    kept = rows.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest"))
    marked = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own_id"), digest(text_col).alias("own_digest"))
    out = marked.join(kept, (F.col("own_digest") == F.col("kept_digest")) & F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi")
    twice = rows.where(F.col("group_size") > 1).where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).limit(1)
    if not twice.isEmpty():
        out = out.dropDuplicates(["own_id", "own_digest"])
    return out.select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""
