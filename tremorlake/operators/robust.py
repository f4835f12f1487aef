"""Robust statistics by group: centre and scale, z-scores, standardizers with fallback, calibration, effects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MAD = 1.4826
Z = 0.67448975


#: Accuracy of the sketch that brackets a quantile, and the ranks on both sides, as shares, that the bracket takes.
SKETCH, MARGIN = 1_000, 0.005
#: Groups of so few values, of which a margin is less than some ranks, are listed whole.
SMALL = 1_000


#: Rows of a group whose distinct values one task may hold.
LARGE = 1_000_000


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def quantile(df: DataFrame, by: Sequence[str], value: Column | str, q: float, name: str, largest: int) -> DataFrame:
    """by, name: the linear quantile of each group.  An aggregate keeps every distinct value of a group in one task,
    so groups of more than LARGE rows are done by exact_quantile, with the same result."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    if largest > LARGE:
        return exact_quantile(df, by, v, q, name)
    return df.select(*by, F.when(~F.isnan(v), v).alias("__v")).groupBy(*by).agg(F.percentile("__v", F.lit(q)).alias(name))


def exact_quantile(df: DataFrame, by: Sequence[str], value: Column | str, q: float, name: str, kind: str = "linear") -> DataFrame:
    """by, name: the exact quantile of each group, whatever its size; nulls and NaN don't count.

    A sketch brackets it: ranks a margin off on both sides, where the sketch errs by a fifth of the margin at most.
    Values below the bracket are counted, and only the hundredth part within it is listed, each distinct value once
    with its count.  kind: linear interpolation, or higher: the value at or above position (n - 1) q."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, v.cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    around = F.percentile_approx("__v", F.array(F.lit(max(0.0, q - MARGIN)), F.lit(min(1.0, q + MARGIN))), SKETCH)
    bracket = rows.groupBy(*by).agg(around.alias("__a"), F.count("*").alias("__n"))
    own = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by]
    met = rows.alias("r").join(bracket.alias("s"), reduce(and_, own)) if by else rows.alias("r").join(F.broadcast(bracket).alias("s"), how="left", on=F.lit(True))
    small = F.col("__n") <= SMALL
    inside = F.when(small | F.col("__v").between(F.col("__a")[0], F.col("__a")[1]), F.col("__v"))
    # values outside are one row a group and task: below the bracket or not
    counts = met.groupBy(*[F.col(f"r.{k}").alias(k) for k in by], inside.alias("__v"), (~small & (F.col("__v") < F.col("__a")[0])).alias("__below")).agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))
    listed = counts.groupBy(*by).agg(
        F.sum(F.when(F.col("__below"), F.col("__c")).otherwise(0)).alias("__under"),
        F.first("__n").alias("__n"),
        F.array_sort(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("__v", "__c")))).alias("__l"),
    )
    at = (F.col("__n") - 1) * F.lit(q)
    low = F.floor(at + (1e-9 if kind == "linear" else 0)) if kind == "linear" else F.ceil(at - 1e-9)

    def ranked(rank: Column) -> Column:
        """The value of that rank, from 0, by running counts over the list."""
        start = F.struct(F.col("__under").cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
        step = lambda acc, x: F.struct((acc["seen"] + x["__c"]).cast("long").alias("seen"), F.coalesce(acc["v"], F.when(acc["seen"] + x["__c"] > rank, x["__v"])).alias("v"))
        return F.aggregate("__l", start, step)["v"]

    if kind != "linear":
        return listed.select(*by, ranked(low).alias(name))
    share = F.greatest(at - low, F.lit(0.0))
    first = listed.select(*by, ranked(low).alias("__x"), F.when(share > 1e-9, ranked(low + 1)).alias("__y"), share.alias("__t"))
    return first.select(*by, F.when(F.col("__y").isNull(), F.col("__x")).otherwise(F.col("__x") + F.col("__t") * (F.col("__y") - F.col("__x"))).alias(name))


def joined_by(df: DataFrame, dim: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the columns of its group, or of the only row where there are no groups."""
    return df.join(dim, list(by), "left") if by else df.join(F.broadcast(dim), how="left", on=F.lit(True))


def robust_scale(df: DataFrame, by: Sequence[str], value: str, floor: float = 1e-8) -> DataFrame:
    """center (median), spread (1.4826 MAD, else the population deviation, else 1) and n of each group."""
    df = df.dropna(subset=list(by)) if by else df
    size = largest_group(df, by)
    first = df.groupBy(*by).agg(F.stddev_pop(value).alias("sd"), F.count(value).alias("n"), *([] if size > LARGE else [F.median(value).alias("center")]))
    if size > LARGE:
        first = joined_by(first, exact_quantile(df, by, value, 0.5, "center"), by)
    mad = quantile(joined_by(df, first.select(*by, "center"), by), by, F.abs(F.col(value) - F.col("center")), 0.5, "mad", size)
    both = joined_by(first, mad.withColumn("mad", MAD * F.col("mad")), by)
    scale = F.when(F.col("mad") >= floor, F.col("mad")).when(F.col("sd") >= floor, F.col("sd")).otherwise(1.0)
    return both.select(*by, "center", scale.alias("spread"), "n")


def robust_z(df: DataFrame, by: Sequence[str], value: str, name: str, at_least: int = 3) -> DataFrame:
    """0.67448975 (x - median) / MAD within the group; 0 in small groups and where MAD is 0."""
    df = df.dropna(subset=list(by)) if by else df
    size = largest_group(df, by)
    m = df.groupBy(*by).agg(F.count(value).alias("__n"), *([] if size > LARGE else [F.median(value).alias("__m")]))
    if size > LARGE:
        m = joined_by(m, exact_quantile(df, by, value, 0.5, "__m"), by)
    near = joined_by(df, m, by)
    full = joined_by(near, quantile(near, by, F.abs(F.col(value) - F.col("__m")), 0.5, "__d", size), by)
    return full.withColumn(name, F.when((F.col("__n") >= at_least) & (F.col("__d") > 0), Z * (F.col(value) - F.col("__m")) / F.col("__d")).otherwise(0.0)).drop("__m", "__n", "__d")


def group_standardizer(reference: DataFrame, scale_key: str, detail: Sequence[str], value: str, at_least: int = 24) -> DataFrame:
    """Long table of (scale, group): the group's own centre and scale where it is large enough, else its scale's."""
    whole = robust_scale(reference, [scale_key], value).select(scale_key, F.col("center").alias("gc"), F.col("spread").alias("gs"))
    own = robust_scale(reference, [scale_key, *detail], value).join(whole, scale_key)
    enough = F.col("n") >= at_least
    return own.select(
        scale_key,
        *detail,
        F.when(enough, F.col("center")).otherwise(F.col("gc")).alias("center"),
        F.when(enough, F.col("spread")).otherwise(F.col("gs")).alias("spread"),
        "n",
        F.when(enough, "group").otherwise("fallback").alias("source"),
    )


def standardize(df: DataFrame, reference: DataFrame, scale_key: str, detail: Sequence[str], value: str, name: str, at_least: int = 24, limit: float = 15.0) -> DataFrame:
    """z by the detailed standardizer, by the scale's where that is missing or small, clipped."""
    keys = [scale_key, *detail]
    own = group_standardizer(reference, scale_key, detail, value, at_least).where("source = 'group'").select(*keys, F.col("center").alias("c1"), F.col("spread").alias("s1"))
    whole = robust_scale(reference, [scale_key], value).select(scale_key, F.col("center").alias("c0"), F.col("spread").alias("s0"))
    full = df.join(own, keys, "left").join(whole, scale_key, "left")
    z = (F.col(value) - F.coalesce("c1", "c0")) / F.coalesce("s1", "s0")
    return full.withColumn(name, F.greatest(F.lit(-limit), F.least(F.lit(limit), z))).drop("c0", "c1", "s0", "s1")


def calibration(df: DataFrame, group: Sequence[str], channel: str, value: str, at_least: int = 20) -> DataFrame:
    """Per channel: its own centre, and the scale kept above a quarter of the group's; the group's where it has too few."""
    g = robust_scale(df, group, value, 1e-6).select(*group, F.col("center").alias("gc"), F.col("spread").alias("gs"))
    own = robust_scale(df, [*group, channel], value, 1e-6).join(g, list(group))
    enough = F.col("n") >= at_least
    return own.select(
        *group,
        channel,
        F.when(enough, F.col("center")).otherwise(F.col("gc")).alias("center"),
        F.when(enough, F.greatest(F.col("spread"), 0.25 * F.col("gs"), F.lit(1e-6))).otherwise(F.greatest(F.col("gs"), F.lit(1e-6))).alias("spread"),
        "n",
    )


def frozen(models: DataFrame, anchor: Column, stages: DataFrame, stage: str) -> DataFrame:
    """Models of the anchor stage stand for the given later stages as well."""
    listed = stages.agg(F.collect_set(stage).alias("__later"))  # one row, of the stages' names
    kept = models.where(anchor).drop(stage).join(F.broadcast(listed), how="inner", on=F.lit(True))
    return models.join(stages, stage, "left_anti").unionByName(kept.withColumn(stage, F.explode("__later")).drop("__later"))


def impute_median(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Nulls and NaN take the median of the rows passed in, 0 where there is none."""
    out = df.withColumns({v: F.when(~F.isnan(v), F.col(v)) for v in values})
    n = df.count()
    for v in values:
        out = joined_by(out, quantile(df, [], v, 0.5, f"__{v}", n), [])
    return out.withColumns({v: F.coalesce(v, f"__{v}", F.lit(0.0)) for v in values}).drop(*[f"__{v}" for v in values])


def quantile_higher(df: DataFrame, by: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """The smallest value at or above position (n - 1) q; of groups that a task can't sort, by exact_quantile."""
    if largest_group(df, by) > LARGE:
        return exact_quantile(df, by, value, q, name, "higher")
    w = Window.partitionBy(*by)
    ranked = df.select(*by, value, F.row_number().over(w.orderBy(value)).alias("__i"), F.count("*").over(w).alias("__n"))
    return ranked.where(F.col("__i") == F.ceil((F.col("__n") - 1) * F.lit(q) - 1e-9) + 1).select(*by, F.col(value).alias(name))


def effect_sizes(df: DataFrame, group: str, target: str, value: str) -> DataFrame:
    """Cohen's d and Cliff's delta of the target group against every other.

    Delta needs how many values of the other group lie below and above each of the target's.  Values are
    counted first and compared by their running counts, so the cost is a sort and not a product of groups."""
    s = df.groupBy(group).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.count(value).alias("n"), F.median(value).alias("median"))
    t = s.where(F.col(group) == target).select(F.col("mean").alias("tm"), F.col("var").alias("tv"), F.col("n").alias("tn"), F.col("median").alias("target_median"))
    o = s.where(F.col(group) != target)
    per = df.groupBy(group, value).agg(F.count("*").alias("c"))
    others = per.where(F.col(group) != target).select(F.col(group).alias("other"), F.col(value).alias("v"), F.col("c").alias("b"), F.lit(0).cast("long").alias("a"))
    own = per.where(F.col(group) == target).select(F.col(value).alias("v"), F.lit(0).cast("long").alias("b"), F.col("c").alias("a"))
    names = o.agg(F.collect_list(group).alias("__names"))  # one row, of the groups' names
    spread = own.join(F.broadcast(names), how="inner", on=F.lit(True)).withColumn("other", F.explode("__names")).drop("__names")
    each = others.unionByName(spread).groupBy("other", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy("other").orderBy("v")
    below = F.coalesce(F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.sum("b").over(Window.partitionBy("other")) - below - F.col("b")
    delta = each.withColumn("s", F.col("a") * (below - above)).groupBy("other").agg(F.sum("s").alias("s"))
    full = o.join(F.broadcast(t), how="left", on=F.lit(True)).join(delta, F.col(group) == F.col("other"))
    pooled = F.sqrt((F.col("tv") + F.col("var")) / 2)
    return full.select(
        F.col(group).alias("versus"),
        "target_median",
        F.col("median").alias("reference_median"),
        F.when(pooled > 0, (F.col("tm") - F.col("mean")) / pooled).alias("cohens_d"),
        (F.col("s") / (F.col("tn") * F.col("n"))).alias("cliffs_delta"),
        F.col("tn").alias("target_n"),
        F.col("n").alias("reference_n"),
    )


def detector_flags(df: DataFrame, zs: Sequence[str], expanded: float = 3.5, strict: float = 5.0, secondary: float = 2.0) -> DataFrame:
    """score (largest z), secondary (second largest), and the expanded and strict detections."""
    ordered = F.sort_array(F.array(*[F.col(z) for z in zs]), asc=False)
    out = df.withColumns({"score": ordered[0], "secondary": ordered[1]})
    return out.withColumns({
        "expanded": (F.col("score") >= expanded) & ((F.col(zs[0]) > 0) | (F.col(zs[1]) > 0)),
        "strict": (F.col("score") >= strict) & (F.col("secondary") >= secondary),
    })


def common_mode(df: DataFrame, at: Sequence[str], control: str, share: float = 0.25, depth: float = 4.0) -> DataFrame:
    """Whether too many sensors fire at once, or the control channels say that all do."""
    w = Window.partitionBy(*at)
    active = F.avg(F.col("expanded").cast("double")).over(w)
    return df.withColumn("active_fraction", active).withColumn("common_mode", (F.col("active_fraction") > share) | (F.col(control) < -depth))
