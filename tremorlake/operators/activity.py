"""Event activity from waveform blocks: stitched reads, gauge medians, minute totals and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions import rms, square_integral

#: waveform_block: file_name, channel, start_sample, fs, samples array<float>; start_sample counts on the common clock.


def stitched(blocks: DataFrame, requests: DataFrame, width: int) -> DataFrame:
    """request, channel, samples: the samples [first, last] of each request, files overlapping or not.

    requests: request, first, last, channels and, where a catalog names one, preferred (a file).  Blocks and requests
    meet on time buckets of width samples and the channel.  The preferred file gives all that it has; of others,
    where they overlap, a later one gives only what lies after the ones before it."""
    named = requests if "preferred" in requests.columns else requests.withColumn("preferred", F.lit(None).cast("string"))
    b = blocks.withColumn("end_sample", F.col("start_sample") + F.size("samples") - 1)
    b = b.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_sample") / width).cast("long"), F.floor(F.col("end_sample") / width).cast("long"))))
    r = named.withColumn("channel", F.explode("channels")).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / width).cast("long"), F.floor(F.col("last") / width).cast("long"))))
    met = r.drop("channels").join(b, ["bucket", "channel"]).where((F.col("start_sample") <= F.col("last")) & (F.col("end_sample") >= F.col("first")))
    met = met.dropDuplicates(["request", "channel", "file_name", "start_sample"])
    all_of = Window.partitionBy("request", "channel")
    chosen = F.col("file_name").eqNullSafe(F.col("preferred"))
    met = met.withColumns({"chosen": chosen, "from": F.min(F.when(chosen, F.col("start_sample"))).over(all_of), "to": F.max(F.when(chosen, F.col("end_sample"))).over(all_of)})
    span = lambda s, e: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))
    start, end = F.col("start_sample"), F.col("end_sample")
    # what others have before the preferred file begins and after it ends
    around = F.filter(F.array(span(start, F.least(end, F.col("from") - 1)), span(F.greatest(start, F.col("to") + 1), end)), lambda x: x["s"] <= x["e"])
    spans = F.when(F.col("chosen") | F.col("from").isNull(), F.array(span(start, end))).otherwise(around)
    met = met.withColumn("x", F.explode(spans)).select("*", "x.*")
    w = all_of.orderBy("s", "file_name").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("first", "s", F.coalesce(F.max("e").over(w) + 1, F.col("first")))
    cut = met.withColumns({"begin": begin, "stop": F.least("last", "e")}).where("begin <= stop")
    part = cut.withColumn("part", F.slice("samples", (F.col("begin") - F.col("start_sample") + 1).cast("int"), (F.col("stop") - F.col("begin") + 1).cast("int")))
    return part.groupBy("request", "channel", "first", "last").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("begin", "part"))), lambda x: x["part"])).alias("samples"))


def complete(stitches: DataFrame) -> DataFrame:
    """Requests that didn't get every sample."""
    return stitches.where(F.size("samples") != F.col("last") - F.col("first") + 1)


def gauge_metrics(stitches: DataFrame, fs: float) -> DataFrame:
    """Over the channels of each request: the median and range of RMS, median and sum of the squared integral."""
    own = stitches.select("request", "channel", rms(F.col("samples")).alias("r"), square_integral(F.col("samples"), fs).alias("q"), F.size("samples").alias("n"))
    return own.groupBy("request").agg(
        F.median("r").alias("rms_median"),
        F.min("r").alias("rms_min"),
        F.max("r").alias("rms_max"),
        F.median("q").alias("integral_median"),
        F.sum("q").alias("integral_sum"),
        F.count("*").alias("gauge_channels"),
        F.max("n").alias("samples"),
        F.concat_ws(";", F.sort_array(F.collect_list("channel"))).alias("gauge_data_channels"),
    )


def rollup(events: DataFrame, minute: str, position: str, value: str) -> DataFrame:
    """Counts and sums by (minute, position), by minute, by position and over all, in one pass."""
    sums = events.cube(minute, position).agg(F.grouping_id().alias("level"), F.count("*").alias("event_count"), F.sum(value).alias("total"))
    return sums.withColumn("level", F.element_at(F.array(F.lit("cell"), F.lit("minute"), F.lit("position"), F.lit("all")), (F.col("level") + 1).cast("int")))


def invariants(events: DataFrame, rolled: DataFrame, value: str) -> DataFrame:
    """check, violations: every level of the rollup adds up to the events."""
    whole = events.agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    levels = rolled.groupBy("level").agg(F.sum("event_count").alias("n2"), F.sum("total").alias("s2"))
    off = (F.col("n") != F.col("n2")) | (F.abs(F.col("s") - F.col("s2")) > 1e-9 * F.greatest(F.abs("s"), F.lit(1.0)))
    return levels.join(F.broadcast(whole), how="left", on=F.lit(True)).select(F.concat(F.lit("sum_of_"), "level").alias("check"), off.cast("long").alias("violations"))
