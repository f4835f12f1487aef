"""Channel quality control: moments, flags, classes within layout groups, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.operators.robust import robust_z


# Fixed values.
@dataclass(frozen=True)
class Limits:
    nonfinite: float = 0.01
    zero: float = 0.99
    saturation: float = 0.001
    flat: float = 0.99
    std_z: float = 6.0
    kurtosis: float = 100.0
    jump: float = 50.0
    group: int = 8
    fixed_bad: float = 0.5


def channel_moments(samples: DataFrame, by: Sequence[str], order: Sequence[str], value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Moments and counts of every file and channel, from one row a sample, in one window and one aggregation."""
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    x = F.when(ok, v)
    d = F.col("__d")
    saturated = F.lit(False) if low is None else (v <= low) | (v >= high)
    rows = samples.withColumn("__x", x).withColumn("__d", F.col("__x") - F.lag("__x").over(Window.partitionBy(*by).orderBy(*order)))
    x = F.col("__x")
    return rows.groupBy(*by).agg(
        F.count("*").alias("sample_count"),
        F.count(x).alias("finite_count"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        (F.kurtosis(x) + 3).alias("kurtosis"),
        (1 - F.count(x) / F.count("*")).alias("nonfinite_fraction"),
        (F.count_if(x == 0) / F.count("*")).alias("zero_fraction"),
        (F.count_if(saturated & ok) / F.count("*")).alias("saturation_fraction"),
        F.coalesce(F.count_if(d == 0) / F.nullif(F.count(d), F.lit(0)), F.lit(1.0)).alias("flat_fraction"),
        F.sqrt(F.avg(d * d)).alias("difference_rms"),
        F.coalesce(F.max(F.abs(d)), F.lit(0.0)).alias("max_jump"),
    )


def block_moments(blocks: DataFrame, by: Sequence[str], samples: str) -> DataFrame:
    """The same first four moments from rows that hold arrays of samples: power sums per row, then merged.

    Sums are taken about each row's own mean and moved to the common one, so large offsets cost no digits."""
    a = F.filter(samples, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = blocks.select(*by, a.alias("a")).withColumn("n", F.size("a")).where("n > 0")
    rows = rows.withColumn("m", F.aggregate("a", F.lit(0.0), lambda s, v: s + v) / F.col("n"))
    power = lambda k: F.aggregate("a", F.lit(0.0), lambda s, v: s + F.pow(v - F.col("m"), F.lit(float(k))))
    rows = rows.select(*by, "n", "m", power(2).alias("p2"), power(3).alias("p3"), power(4).alias("p4"))
    whole = rows.groupBy(*by).agg(F.sum("n").alias("whole_n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("whole_m"))
    d = F.col("m") - F.col("whole_m")
    n = F.col("n")
    moved = rows.join(whole, list(by)).groupBy(*by).agg(
        F.first("whole_n").alias("n"),
        F.first("whole_m").alias("mean"),
        F.sum(F.col("p2") + n * d**2).alias("m2"),
        F.sum(F.col("p4") + 4 * d * F.col("p3") + 6 * d**2 * F.col("p2") + n * d**4).alias("m4"),
    )
    return moved.select(*by, "n", "mean", (F.col("m2") / F.col("n")).alias("variance"), F.when(F.col("m2") > 0, F.col("n") * F.col("m4") / F.col("m2") ** 2).alias("kurtosis"))


def _listed(*reasons: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in reasons]))


def flag_channels(moments: DataFrame, file: str, limits: Limits = Limits()) -> DataFrame:
    """bad_reasons of each channel, its spread judged against all channels of the file."""
    tiny = 2.2250738585072014e-308
    z = robust_z(moments.withColumn("log_std", F.log10(F.greatest(F.coalesce("std", F.lit(0.0)), F.lit(tiny)))), [file], "log_std", "std_z")
    dead = F.coalesce(F.col("std") == 0, F.lit(True))
    reasons = _listed(
        (F.col("nonfinite_fraction") > limits.nonfinite, "NONFINITE"),
        (F.col("zero_fraction") > limits.zero, "ZERO_OR_DEAD"),
        (F.col("saturation_fraction") > limits.saturation, "SATURATED"),
        (F.col("flat_fraction") > limits.flat, "FLATLINE"),
        (dead, "NO_VARIANCE"),
        (~dead & (F.col("std_z") < -limits.std_z), "LOW_NOISE_OUTLIER"),
        (~dead & (F.col("std_z") > limits.std_z), "HIGH_NOISE_OUTLIER"),
        (F.col("kurtosis") > limits.kurtosis, "IMPULSIVE_KURTOSIS"),
        (F.try_divide("max_jump", "std") > limits.jump, "ABRUPT_JUMP"),
    )
    return z.withColumn("bad_reasons", F.concat_ws(";", reasons)).withColumn("bad", F.col("bad_reasons") != "")


def classify(flagged: DataFrame, layout: DataFrame, file: str, channel: str, group: str, limits: Limits = Limits()) -> DataFrame:
    """HARD_BAD, REVIEW or PASS: hard faults, or an odd spread within the layout group of the file."""
    full = flagged.join(layout, channel)
    z = robust_z(full, [file, group], "log_std", "group_z", limits.group)
    hard = _listed(
        (F.col("nonfinite_fraction") > limits.nonfinite, "NONFINITE"),
        (F.col("zero_fraction") > limits.zero, "ZERO_OR_DEAD"),
        (F.col("saturation_fraction") > limits.saturation, "SATURATED"),
        (F.col("flat_fraction") > limits.flat, "FLATLINE"),
        (F.coalesce(F.col("std") == 0, F.lit(True)), "NO_VARIANCE"),
    )
    soft = _listed(
        (F.col("group_z") < -limits.std_z, "LOW_STD_WITHIN_LAYOUT_GROUP"),
        (F.col("group_z") > limits.std_z, "HIGH_STD_WITHIN_LAYOUT_GROUP"),
        (F.col("kurtosis") > limits.kurtosis, "HIGH_KURTOSIS_REVIEW"),
        (F.try_divide("max_jump", "std") > limits.jump, "ABRUPT_JUMP_REVIEW"),
    )
    out = z.withColumns({"hard_reasons": hard, "review_reasons": soft})
    return out.withColumn("qc_class", F.when(F.size("hard_reasons") > 0, "HARD_BAD").when(F.size("review_reasons") > 0, "REVIEW").otherwise("PASS"))


def channel_summary(classed: DataFrame, channel: str, stable: Column, limits: Limits = Limits()) -> DataFrame:
    """Across files.  Reviews count over the stable files, over all where there is none."""
    hard, review = F.size("hard_reasons") > 0, F.size("review_reasons") > 0
    some = F.count_if(stable)
    base = F.when(some > 0, some).otherwise(F.count("*"))
    reviews = F.when(some > 0, F.count_if(stable & review)).otherwise(F.count_if(review))
    return classed.groupBy(channel).agg(
        F.count("*").alias("files"),
        F.count_if(hard).alias("hard_bad_files"),
        (F.count_if(hard) / F.count("*") >= limits.fixed_bad).alias("fixed_bad"),
        F.concat_ws(";", F.sort_array(F.array_distinct(F.flatten(F.collect_set("hard_reasons"))))).alias("hard_reasons"),
        some.alias("stable_files"),
        (reviews / base).alias("review_fraction"),
        F.median("rms").alias("median_rms"),
        F.median("std").alias("median_std"),
    )


def group_summary(summary: DataFrame, layout: DataFrame, channel: str, group: str) -> DataFrame:
    bad = F.count_if("fixed_bad")
    return summary.join(layout, channel).groupBy(group).agg(F.count("*").alias("channels"), bad.alias("fixed_bad_channels"), (1 - bad / F.count("*")).alias("valid_rate"), F.median("median_rms").alias("median_rms"))


def file_summary(classed: DataFrame, file: str, structural: Column | None = None) -> DataFrame:
    hard = F.count_if(F.col("qc_class") == "HARD_BAD")
    wrong = F.lit(False) if structural is None else F.bool_or(structural)
    return classed.groupBy(file).agg(hard.alias("hard_bad_channels"), F.count_if(F.size("review_reasons") > 0).alias("review_channels"), F.avg("nonfinite_fraction").alias("mean_nonfinite"), F.when(wrong, "FAIL").when(hard > 0, "WARN").otherwise("PASS").alias("quality_status"))


def with_metadata(files: DataFrame, metadata: DataFrame, path: str, name: str) -> DataFrame:
    """Metadata by relative path, else by base name, without regard to case."""
    by_path = metadata.select(F.lower(path).alias("__p"), F.struct(*metadata.columns).alias("m1")).dropDuplicates(["__p"])
    by_name = metadata.select(F.lower(name).alias("__n"), F.struct(*metadata.columns).alias("m2")).dropDuplicates(["__n"])
    full = files.join(by_path, F.lower(files[path]) == F.col("__p"), "left").join(by_name, F.lower(files[name]) == F.col("__n"), "left")
    return full.withColumn("metadata", F.coalesce("m1", "m2")).drop("__p", "__n", "m1", "m2")
