"""Mixing sources to target weights along a curriculum.

A source's weight changes over training time t in [0, 1]: straight lines between knots.  Its integral is the
source's share of all the words that the mix takes; a source stops at `repeats` times its own size, and what it
can't give is shared again by weight until none is above.  Demand of a source up to t is its target times the
integral up to t over the whole one.  A source's documents stand in the order of their hash, over and over, each
on an interval of its words; where the interval begins, the inverse of cumulative demand tells the time: the
document's position.  Sorting by ranges of positions gives the training order.

Running totals of a source are taken in buckets of its hashes, so a source that holds a third of all rows is
dealt over the cluster; sources meet their buckets in a join, and only sums come to the driver.

Defined cases: a null text has no words; documents without words are taken 0 times and stand at the end; a null
source is a source of its own, the last one; a row is a document, and rows alike in source, id and text follow
each other; null ids are ids like others; an empty table gives none; of columns only id, source and text are
read.  The last document that a source gives may be taken in part, so each source meets its target to a word.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.llm.common import cut, table, text_of
from tremorlake.operators.temporal import numbered

#: Weights at t = 0, 1/2 and 1 of the first, second, third source, and so on over again; they integrate to 5, 2 and 1.
CURRICULUM = ((7.5, 5.0, 2.5), (2.0, 2.0, 2.0), (0.5, 1.0, 1.5))
SHARE = Fraction(3, 2)
REPEATS = 2
BUCKET_ROWS = 20_000
#: Rows alike that are told apart at once.
_SLICE = 100_000


def word_count(text: Column) -> Column:
    """How many runs of other characters than white space there are."""
    bare = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, " +"))).cast("long")


def integral(knots: Sequence[float]) -> float:
    """Of straight lines between knots that are evenly spaced over [0, 1]."""
    return sum((a + b) / 2 for a, b in zip(knots, knots[1:])) / (len(knots) - 1)


def time_of(share: Column, knots: Sequence[float]) -> Column:
    """The t up to which that share of the integral has come: in each line a quadratic, solved without cancellation."""
    step, lines = 1 / (len(knots) - 1), list(zip(knots, knots[1:]))
    area, done, times = share * integral(knots), 0.0, []
    for i, (a, b) in enumerate(lines):
        more = F.greatest(area - done, F.lit(0.0))
        root = F.sqrt(F.greatest(a * a + 2 * (b - a) / step * more, F.lit(0.0)))
        done += (a + b) / 2 * step
        times.append((done, i * step + F.coalesce(F.try_divide(2 * more, a + root), F.lit(0.0))))
    out = times[-1][1]
    for end, at in reversed(times[:-1]):
        out = F.when(area < end, at).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def sources_of(rows: DataFrame, curriculum: Sequence[Sequence[float]]) -> DataFrame:
    """source, source_size, kind (which schedule), weight (its integral), by code point of the source, null last."""
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    placed = numbered(sums.withColumn("unnamed", F.col("source").isNull()), ["unnamed", "source"], "at").drop("unnamed")
    kind = F.pmod(F.col("at"), F.lit(len(curriculum))).cast("int")
    weights = F.array(*[F.lit(integral(k)) for k in curriculum])
    return placed.select("source", "source_size", kind.alias("kind")).withColumn("weight", F.get(weights, F.col("kind")).cast("decimal(18,6)"))


def level(sources: DataFrame, share: Fraction, repeats: int) -> Fraction:
    """Words for a weight of 1, so that sources, stopped at repeats times their size, give share times all words.

    Stopping those above raises it for the others; each round is one sum, and the first that stops no more is exact."""
    total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    budget, now, stopped = share * total, Fraction(0), -1
    cap = (F.col("source_size") * repeats).cast("decimal(38,0)")
    while True:
        # cap < now * weight, without division; weights have six digits
        above = cap.cast("double") < F.lit(float(now)) * F.col("weight").cast("double")
        gone, weight, n = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n <= stopped or not weight:
            return now
        now, stopped = (budget - int(gone or 0)) / Fraction(weight), n


def mix(docs: DataFrame, curriculum: Sequence[Sequence[float]] = CURRICULUM, share: Fraction = SHARE, repeats: int = REPEATS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, takes of every row; takes: epoch, words and position of each time
    that the mix takes it.  A pass over a source is an epoch; bucket_rows changes no result."""
    text = text_of(text_col)
    order = F.md5(F.encode(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.encode(text, "UTF-8"))), "UTF-8"))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), order.alias("order"))
    rows = cut(read.groupBy("source", "order", "doc_id", "size").agg(F.count("*").alias("copies")))
    sources = cut(sources_of(rows, curriculum))
    now = level(sources, share, repeats)
    cap = (F.col("source_size") * repeats).cast("double")
    target = F.least(cap, F.lit(float(now)) * F.col("weight").cast("double"))
    goals = sources.select("source", "source_size", "kind", target.alias("target"), F.floor(target).alias("goal"))
    # running totals of buckets within their source, then of rows within their bucket
    buckets = max(1, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets, 32))
    sums = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    w = Window.partitionBy("source").orderBy("bucket")
    sums = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), (F.sum("words").over(w) - F.col("words")).alias("before"))
    sums = sums.join(goals, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("within", F.sum(F.col("size") * F.col("copies")).over(inside) - F.col("size") * F.col("copies"))
    placed = own.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    # rows alike stand one behind the other
    slices = placed.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_SLICE}"))))
    last = F.least(F.col("copies"), (F.col("slice") + 1) * _SLICE) - 1
    each = slices.withColumn("copy", F.explode(F.sequence(F.col("slice") * _SLICE, last)))
    each = each.withColumn("begin", F.col("before") + F.col("within") + F.col("copy") * F.col("size"))

    def take(epoch: int) -> Column:
        begin = F.col("begin") + epoch * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("goal") - begin))
        done = F.coalesce(F.try_divide(begin.cast("double"), F.col("target")), F.lit(0.0))
        position = F.lit(1.0)
        for i, knots in enumerate(curriculum):
            position = F.when(F.col("kind") == i, time_of(done, knots)).otherwise(position)
        return F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), position.alias("position"))

    takes = F.filter(F.array(*[take(e) for e in range(repeats)]), lambda x: x["words"] > 0)
    return each.select("doc_id", "source", "size", "source_size", "target", takes.alias("takes"))


def training_order(mixed: DataFrame) -> DataFrame:
    """doc_id, source, epoch, words, position of every take, sorted by ranges of positions."""
    takes = mixed.select("doc_id", "source", F.inline("takes"))
    return takes.orderBy("position", F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "epoch")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their first position."""
    mixed = cut(mix(table(spark, sf_dir, "documents")))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    first = F.coalesce(F.get("takes", F.lit(0))["position"], F.lit(2.0))
    out = mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("position"))
    return out.orderBy("position", F.col("doc_id").asc_nulls_last()).drop("position")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
t AS (SELECT sum(source_size)::BIGINT AS total FROM s),
-- sources in the order in which they stop as the level rises
p AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY source_size * 20 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone,
    sum(w) OVER (ORDER BY source_size * 20 // w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest FROM s),
q AS (SELECT *, (3 * total - 2 * gone)::DOUBLE / (2 * rest) AS level FROM p, t),
g AS (SELECT q.source, source_size, least(2.0::DOUBLE * source_size, (SELECT max(level) FROM q) * w) AS target FROM q),
r AS (SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS goal,
    sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS begin_
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (greatest(0, least(size, goal - begin_)) + greatest(0, least(size, goal - begin_ - source_size)))::BIGINT AS taken FROM r
"""
