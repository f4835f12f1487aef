"""Line dedup: lines whose normalised form stands in many documents go, everywhere.

Each document gives its distinct line hashes once, so the count of rows per hash is the count of documents,
and partial aggregation takes a very common line down to one row a task.  Positions of lines to drop are
found by a join on the hash (both sides plain exchanges, so AQE can split a hot line), gathered per
document, and the text is put together from the lines that stay, by position.  Texts that lose no line don't
take part in that last join.

Defined cases: null or empty text is one empty line, which stays; a row is a document, so repeated rows
count as often as they stand there; equal lines of one document count once; an empty table gives none; other
columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.bitmaps import bitmap_subquery, possible
from tremorlake.llm.common import SPACE_CHARS, ascii_lower, cut, table, text_of


def line_hashes(text: Column, min_chars: int) -> Column:
    """128 bits for every line, null for lines whose key is too short to drop."""
    lines = F.split(ascii_lower(text), "\n", -1)

    def of(line: Column) -> Column:
        key = F.trim(line, F.lit(SPACE_CHARS))
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), F.reverse(key)).alias("b")))

    return F.transform(lines, of)


def dropped_positions(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """id, mark, drop: the positions (from 0) of lines to drop, for documents that have some.  docs: id, mark, text."""
    # written down: the texts are read and normalised once for both uses
    hashed = cut(docs.select("id", "mark", line_hashes(F.col("text"), min_chars).alias("hashes")))
    each = hashed.select(F.explode(F.array_distinct("hashes")).alias("h")).where("h is not null")
    common = each.groupBy("h.a", "h.b").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.xxhash64("a", "b").alias("j"))
    placed = hashed.select("id", "mark", F.posexplode("hashes").alias("pos", "h")).where("h is not null").select("id", "mark", "pos", "h.a", "h.b")
    # the derived key makes both sides plain exchanges, whose hot keys AQE can split
    hit = placed.withColumn("i", F.xxhash64("a", "b")).join(common, (F.col("i") == F.col("j")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_semi")
    return hit.groupBy("id", "mark").agg(F.collect_set("pos").alias("drop"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what stays) of every row."""
    # id and text's hash name a row; rows that have both alike have the same lines
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    gone = cut(dropped_positions(rows, min_docs, min_chars).select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark"), "drop"))
    marks, bits = bitmap_subquery(gone.select(F.col("gone_mark").alias("h")))
    touched = possible(F.col("mark"), marks, bits)
    both = rows.where(touched).join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")
    lines = F.split("text", "\n", -1)
    stay = F.filter(lines, lambda _, i: ~F.array_contains("drop", i))
    changed = both.select(
        F.col("id").alias("doc_id"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
    )
    same = rows.where(~touched).select(F.col("id").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "text")
    return changed.unionByName(same)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""
