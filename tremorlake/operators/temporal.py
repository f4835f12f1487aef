"""Time operators: spines and running totals, as-of and interval joins, unions of intervals, scan windows.

Times are numbers (microseconds).  Windows are partitioned by the entity wherever there is one; the few that
are not run over a spine or a list of windows, whose length is set by the study's span and not by the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.checks import DataError
from tremorlake.sources.shared import cut

#: Stages that are broadcast as one array.
STAGES = 10_000


def spine(spark: SparkSession, first: int, last: int, step: int, name: str) -> DataFrame:
    """first, first + step, ... up to last."""
    n = max(0, (last - first) // step + 1)
    return spark.range(n).select((F.col("id") * step + first).alias(name))


def cumulative(df: DataFrame, order: Sequence[str], values: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Running totals; values maps a new column to the one it adds up."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({new: F.sum(old).over(w) for new, old in values.items()})


def trailing_mean(df: DataFrame, order: str, value: str, rows: int, name: str, by: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0)))


def spined_activity(events: DataFrame, first: int, last: int, step: int, excluded: Column | None = None, trailing: int = 10) -> DataFrame:
    """Counts and activity per step on a spine without holes, their running totals and the trailing mean of counts.

    Excluded steps stand with zeros.  Events are aggregated before they meet the spine."""
    minute = F.floor((F.col("peak_us") - first) / step) * step + first
    sums = events.groupBy(minute.cast("long").alias("minute_us")).agg(F.count("*").alias("event_count"), F.sum("activity").alias("activity_increment"))
    frame = spine(events.sparkSession, first, last, step, "minute_us").join(sums, "minute_us", "left")
    out_of = F.lit(False) if excluded is None else excluded
    frame = frame.withColumn("excluded", out_of)
    for c, zero in (("event_count", F.lit(0).cast("long")), ("activity_increment", F.lit(0.0))):
        frame = frame.withColumn(c, F.when(F.col("excluded"), zero).otherwise(F.coalesce(c, zero)))
    frame = cumulative(frame, ["minute_us"], {"cumulative_count": "event_count", "cumulative_activity": "activity_increment"})
    return trailing_mean(frame, "minute_us", "event_count", trailing, "trailing_mean")


def snapshots(events: DataFrame, positions: DataFrame, key: str, first: int, last: int, step: int) -> DataFrame:
    """Cumulative count and activity of every position at every snapshot; the last stands even off the step.

    An event counts at the first snapshot that isn't before it; running totals over (position, snapshot) do
    the rest, so the grid is as large as its result and nothing is joined by range."""
    at = sorted({*range(first, last + 1, step), last})
    grid = positions.select(key).withColumn("snapshot_us", F.explode(F.array(*[F.lit(t).cast("long") for t in at])))
    rounded = F.ceil((F.col("peak_us") - first) / step) * step + first
    met = events.where(F.col("peak_us") <= last).withColumn("snapshot_us", F.least(F.greatest(rounded, F.lit(first)), F.lit(last)).cast("long"))
    sums = met.groupBy(key, "snapshot_us").agg(F.count("*").alias("n"), F.sum("activity").alias("a"))
    full = grid.join(sums, [key, "snapshot_us"], "left").na.fill({"n": 0, "a": 0.0})
    return cumulative(full, ["snapshot_us"], {"cumulative_count": "n", "cumulative_activity": "a"}, [key]).drop("n", "a")


def asof_backward(left: DataFrame, dim: DataFrame, time: str, start: str, value: str) -> DataFrame:
    """The value of the last dim row that starts at or before time; before the first, the first one's.

    Ends play no part.  dim is a short list of stages, which is checked; asof_window joins two large tables."""
    if dim.limit(STAGES + 1).count() > STAGES:
        raise DataError(f"over {STAGES} stages; use asof_window")
    listed = dim.agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(value).alias("v")))).alias("__stages"))
    joined = left.join(F.broadcast(listed), how="left", on=F.lit(True))
    before = F.filter("__stages", lambda x: x["s"] <= F.col(time))
    return joined.withColumn(value, F.when(F.size(before) > 0, F.element_at(before, -1)["v"]).otherwise(F.get("__stages", F.lit(0))["v"])).drop("__stages")


def asof_window(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """As-of join of two large tables per key: union, then the last value seen.  Both have the time column."""
    rows = left.withColumn("__r", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    both = rows.unionByName(right.select(*by, time, value).withColumn("__r", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "__r").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__r = 1").drop("__r")


def bucketed(intervals: DataFrame, start: str, end: str, width: int, name: str = "__bucket") -> DataFrame:
    """A row for each bucket of that width which the closed interval touches."""
    b = lambda c: F.floor(F.col(c) / width).cast("long")
    return intervals.withColumn(name, F.explode(F.sequence(b(start), b(end))))


def stab(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, width: int) -> DataFrame:
    """Inner join of points with the closed intervals that hold them, as an equi-join on time buckets."""
    p = points.withColumn("__bucket", F.floor(F.col(time) / width).cast("long"))
    return p.join(bucketed(intervals, start, end, width), "__bucket").where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("__bucket")


def interval_first(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, order: str, kind: str, width: int) -> DataFrame:
    """Each point with the kind of the first interval, in table order, that holds it, or null."""
    met = stab(points.select(key, time), intervals, time, start, end, width)
    return points.join(met.groupBy(key).agg(F.min_by(kind, order).alias(kind)), key, "left")


def interval_all(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, kind: str, width: int) -> DataFrame:
    """Each point with all distinct kinds that hold it, sorted and joined by ;."""
    met = stab(points.select(key, time), intervals, time, start, end, width)
    joined = met.groupBy(key).agg(F.concat_ws(";", F.sort_array(F.collect_set(kind))).alias("kinds"))
    return points.join(joined, key, "left").na.fill({"kinds": ""})


def islands(df: DataFrame, by: Sequence[str], start: str, end: str, tie: Sequence[str], touching: bool = True, name: str = "island") -> DataFrame:
    """Numbers the unions of overlapping intervals within each entity, from 1."""
    w = Window.partitionBy(*by).orderBy(start, end, *tie)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = before.isNull() | (F.col(start) > before if touching else F.col(start) >= before)
    return df.withColumn("__new", new.cast("int")).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_overlapping(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged local records (the strongest event of each union speaks for it) and the membership."""
    placed = islands(events, ["node"], "start_us", "end_us", ["event_id"])
    strongest = F.struct(-F.col("activity"), F.col("peak_us"), F.col("event_id"))
    merged = placed.groupBy("node", "island").agg(
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.min_by("peak_us", strongest).alias("peak_us"),
        F.min_by("event_id", strongest).alias("representative_event_id"),
        F.count("*").alias("source_records"),
        F.max("activity").alias("representative_activity"),
    )
    return merged, placed.select("event_id", "node", "island")


def candidate_windows(spark: SparkSession, start: int, end: int, durations: Sequence[int], step: int) -> DataFrame:
    """Windows of every duration at every step, and the one that ends exactly at the end.  window_id in that order."""
    rows = None
    for i, length in enumerate(d for d in durations if d <= end - start):
        last = end - start - length
        own = spark.range(last // step + 1).select((F.col("id") * step).alias("a"))
        if last % step:
            own = own.unionByName(spark.range(1).select(F.lit(last).cast("long").alias("a")))
        own = own.select(F.lit(i).alias("d"), (F.col("a") + start).alias("start_us"), (F.col("a") + start + length).alias("end_us"), F.lit(length).cast("long").alias("duration_us"))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("no duration fits the span")
    first = rows.groupBy("start_us", "end_us").agg(F.min_by(F.struct("d", "duration_us"), "d").alias("f")).select("start_us", "end_us", F.col("f.d").alias("d"), F.col("f.duration_us").alias("duration_us"))
    return first.withColumn("window_id", F.row_number().over(Window.orderBy("d", "start_us")) - 1).drop("d")


def study_windows(spans: DataFrame, durations: Sequence[int], step: int, by: Sequence[str] = ()) -> DataFrame:
    """The same windows of every study; spans: by, start_us, end_us.  A study without room for a duration has none of it.

    window_id counts a study's windows by duration and start; their number is set by its span."""
    listed = F.array(*[F.struct(F.lit(i).alias("d"), F.lit(n).cast("long").alias("duration_us")) for i, n in enumerate(durations)])
    each = spans.select(*by, "start_us", "end_us", F.inline(listed)).withColumn("last", F.col("end_us") - F.col("start_us") - F.col("duration_us")).where("last >= 0")
    steps = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / step)), lambda i: i * step)
    opens = each.select(*by, "d", "duration_us", F.col("start_us").alias("__first"), F.explode(F.array_distinct(F.concat(steps, F.array("last")))).alias("__at"))
    own = opens.select(*by, "d", "duration_us", (F.col("__first") + F.col("__at")).alias("start_us"))
    w = Window.partitionBy(*by).orderBy("d", "start_us")
    return own.dropDuplicates([*by, "start_us", "duration_us"]).select(*by, (F.row_number().over(w) - 1).cast("long").alias("window_id"), "start_us", (F.col("start_us") + F.col("duration_us")).alias("end_us"), "duration_us")


def window_counts(events: DataFrame, windows: DataFrame, analysis_end: int, step: int, node: str = "node", time: str = "peak_us") -> DataFrame:
    """window_id, node, n: events in [start, end), and at the analysis end too for windows that end there.

    Windows open at a step boundary of the buckets, so whole buckets are counted once per (node, bucket) and
    only the bucket that an edge cuts looks at single events."""
    cells = events.withColumn("b", F.floor(F.col(time) / step).cast("long"))
    w = windows.withColumn("last", F.when(F.col("end_us") == analysis_end, F.col("end_us")).otherwise(F.col("end_us") - 1))
    spread = w.withColumn("b", F.explode(F.sequence(F.floor(F.col("start_us") / step).cast("long"), F.floor(F.col("last") / step).cast("long"))))
    inner = (F.col("b") * step >= F.col("start_us")) & ((F.col("b") + 1) * step - 1 <= F.col("last"))
    whole = spread.where(inner).join(cells.groupBy(node, "b").agg(F.count("*").alias("c")), "b").select("window_id", node, "c")
    edge = spread.where(~inner).join(cells.select(node, time, "b"), "b").where((F.col(time) >= F.col("start_us")) & (F.col(time) <= F.col("last"))).select("window_id", node, F.lit(1).cast("long").alias("c"))
    return whole.unionByName(edge).groupBy("window_id", node).agg(F.sum("c").alias("n"))


def eligibility(counts: DataFrame, windows: DataFrame, node_count: int, min_records: int, min_active: int) -> DataFrame:
    """Records, active nodes and the population variance over all nodes, absent ones as 0."""
    own = counts.groupBy("window_id").agg(F.sum("n").alias("records"), F.count("*").alias("active_nodes"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    full = windows.select("window_id").join(own, "window_id", "left").na.fill(0)
    # n * squares = records^2 exactly where all nodes have the same count
    varies = node_count * F.col("squares") > F.col("records") * F.col("records")
    return full.select("window_id", "records", "active_nodes", ((F.col("records") >= min_records) & (F.col("active_nodes") >= min_active) & varies).alias("eligible"))


def runs_of_true(df: DataFrame, by: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Maximal runs of rows for which flag holds: first and last row's order value and length, per entity."""
    w = Window.partitionBy(*by).orderBy(order)
    numbered = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__i", F.row_number().over(w))
    true = numbered.where("__f").withColumn("run", F.col("__i") - F.row_number().over(w))
    return true.groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("run")


def timeline(files: DataFrame, start: str, end: str, name: str, fingerprint: str, by: Sequence[str] = ()) -> DataFrame:
    """Gaps and overlaps between consecutive files, their neighbours, and which file had a fingerprint first."""
    w = Window.partitionBy(*by).orderBy(F.col(start).asc_nulls_last(), name)
    f = Window.partitionBy(*by, fingerprint).orderBy(F.col(start).asc_nulls_last(), name)
    return files.select(
        "*",
        F.lag(name).over(w).alias("previous_file"),
        F.lead(name).over(w).alias("next_file"),
        (F.col(start) - F.lag(end).over(w)).alias("gap"),
        F.when(F.row_number().over(f) > 1, F.first(name).over(f)).alias("duplicate_of"),
    )


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with numbers from 0 in that order over all rows: sorted by ranges, counted within each, and the counts of
    the ranges before added.  No task sees more than its range."""
    placed = cut(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).cast("int")
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # a row a partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before", "__id")


def running_totals(df: DataFrame, order: Sequence[str], values: dict[str, str], count: str | None = None) -> DataFrame:
    """Running totals in that order over all rows; values maps a new column to the one it adds up, count names a
    running count.  Totals are taken within ranges of the order, and those of the ranges before are added."""
    placed = cut(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__id", 33).cast("int"))
    names = {**values, **({count: None} if count else {})}
    total = lambda old: F.count("*") if old is None else F.sum(old)
    sums = placed.groupBy("__part").agg(*[total(old).alias(f"__b_{new}") for new, old in names.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = sums.select("__part", *[F.coalesce(F.sum(f"__b_{new}").over(earlier), F.lit(0)).alias(f"__b_{new}") for new in names])
    own = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({new: total(old).over(own) for new, old in names.items()}).join(F.broadcast(before), "__part")
    return out.withColumns({new: F.col(new) + F.col(f"__b_{new}") for new in names}).drop("__id", "__part", *[f"__b_{new}" for new in names])


def even_sample(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """At most k rows of each entity, evenly spaced along the order: positions rint(i (n - 1) / (k - 1))."""
    if by:
        n = F.count("*").over(Window.partitionBy(*by))
        placed = df.withColumn("__i", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long")).withColumn("__n", n)
    else:
        placed = numbered(df, order, "__i").join(F.broadcast(df.agg(F.count("*").alias("__n"))), how="left", on=F.lit(True))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("__n") - 1) / max(1, k - 1)).cast("long"))
    keep = (F.col("__n") <= k) | F.array_contains(wanted, F.col("__i"))
    return placed.where(keep).drop("__i", "__n")
