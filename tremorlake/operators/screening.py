"""Screening against noise domains: exact nearest neighbours, thresholds, votes over scales, labels, branches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.operators.neighbours import Search
from tremorlake.operators.robust import exact_quantile
from tremorlake.sources.shared import cut

#: The space of all references; classes are named behind an equals sign.
WHOLE = "*"


def knn(queries: DataFrame, reference: DataFrame, k: int, key: str = "key", vector: str = "vector", label: str = "label", exclude_self: bool = True, per_label: bool = False) -> DataFrame:
    """key, label, distances: the k smallest Euclidean distances to the reference, or to each label of it.

    Exact, by cells around pivots (neighbours.Search).  A query's key stands once."""
    q = queries.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    space = F.col(label).cast("string") if per_label else F.lit("")
    r = reference.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(space, F.lit("")).alias("space"))
    search = Search(r)
    if not search.n:
        return q.limit(0).select("key", F.lit(None).cast("string").alias("label"), F.array().cast("array<double>").alias("distances"))
    return search.nearest(q, k, None if exclude_self else frozenset()).select("key", (F.col("space") if per_label else F.lit(None).cast("string")).alias("label"), "distances")


def noise_distances(candidates: DataFrame, reference: DataFrame, k: int, class_k: int, quantile: float) -> DataFrame:
    """key, noise_distance, threshold, ratio, nearest_class.  Rows: key, vector, label.

    The threshold is the quantile of the references' leave-one-out distances to their k-th neighbour; the
    class distance does not leave a reference out of its own class.  A class without rows plays no part."""
    # one search: all references are a space of their own, in which a reference doesn't meet itself, and so is each class
    named = lambda rows, mark: rows.select(F.concat(F.lit(mark), F.col("key").cast("string")).alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    spaces = F.explode(F.array(F.lit(WHOLE), F.concat(F.lit("="), F.col("label").cast("string"))))
    search = Search(reference.select(F.concat(F.lit("r"), F.col("key").cast("string")).alias("key"), F.col("vector").cast("array<double>").alias("vector"), spaces.alias("space")).where("space IS NOT NULL"))
    if not search.n:
        nothing = F.lit(None).cast("double")
        return candidates.limit(0).select("key", F.lit(False).alias("is_reference"), *[nothing.alias(c) for c in ("noise_distance", "threshold", "ratio")], F.lit("").alias("nearest_class"), nothing.alias("nearest_distance"))
    everyone = named(candidates, "q").unionByName(named(reference, "r"))
    found = cut(search.nearest(everyone, max(k, class_k), frozenset({WHOLE})))
    kind = dict(candidates.dtypes)["key"]
    key, is_reference = F.expr("substring(key, 2)").cast(kind).alias("key"), (F.substring("key", 1, 1) == "r").alias("is_reference")
    last = lambda n: F.element_at(F.slice("distances", 1, n), -1)
    whole = found.where((F.col("space") == WHOLE) & (F.size("distances") > 0)).select(key, is_reference, last(k).alias("noise_distance"))
    threshold = exact_quantile(whole.where("is_reference"), [], "noise_distance", quantile, "t").select(F.greatest("t", F.lit(1e-9)).alias("threshold"))
    classes = found.where((F.col("space") != WHOLE) & (F.size("distances") > 0)).select(key, is_reference, F.struct(last(class_k).alias("d"), F.expr("substring(space, 2)").alias("label")).alias("m"))
    nearest = classes.groupBy("key", "is_reference").agg(F.min("m").alias("m"))
    full = whole.join(F.broadcast(threshold), how="left", on=F.lit(True)).join(nearest, ["key", "is_reference"])
    return full.select("key", "is_reference", "noise_distance", "threshold", (F.col("noise_distance") / F.col("threshold")).alias("ratio"), F.col("m.label").alias("nearest_class"), F.col("m.d").alias("nearest_distance"))


def longest_run(flags: Column) -> Column:
    """Of an array of booleans, the longest run of true."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    step = lambda s, x: F.struct(F.when(x, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["best"], F.when(x, s["now"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(flags, start, step)["best"]


def event_votes(scored: DataFrame, event: str = "event_id", scale: str = "scale", ratio: str = "ratio") -> DataFrame:
    """How many scales are novel, the longest run of them, and the best scale's row (the first on a tie)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(scale).alias("s"), F.col(ratio).alias("r")))), lambda x: x["r"] > 1.0)
    best = F.max_by(F.struct(scale, "nearest_class"), F.struct(F.col(ratio), -F.col(scale)))
    out = scored.groupBy(event).agg(F.count_if(F.col(ratio) > 1.0).alias("novel_scale_count"), ordered.alias("flags"), F.max(ratio).alias("max_ratio"), F.median(ratio).alias("median_ratio"), best.alias("best"))
    return out.select(event, "novel_scale_count", longest_run(F.col("flags")).alias("max_consecutive"), "max_ratio", "median_ratio", F.col("best")[scale].alias("best_scale"), F.col("best.nearest_class").alias("best_nearest_class"))


def screening_label(novel: str, consecutive: str, coherent: Column, local: Column, operation: Column, human: Column, min_novel: int = 2, min_run: int = 2) -> Column:
    high = (F.col(novel) >= min_novel) & (F.col(consecutive) >= min_run) & (coherent | local) & ~operation & ~human
    return F.when(high, "effective_candidate").when(operation | human | (F.col(novel) == 0), "nuisance_like").otherwise("uncertain")


def screening_score(ratio: str, novel: str, consecutive: str, coherent: Column, local: Column, strict: Column) -> Column:
    one = lambda c: 0.5 * c.cast("int")
    return F.least(F.col(ratio), F.lit(10.0)) + 0.5 * F.col(novel) + 0.4 * F.col(consecutive) + one(coherent) + one(local) + one(strict)


def formal_tags(catalog: DataFrame) -> DataFrame:
    """human_like, the forced nuisance label, and the pool: the first that applies of seven."""
    human = F.col("buffered_operation") | (F.col("best_nearest_class").isin("personnel", "pumping") & (F.col("max_ratio") <= 1.0))
    out = catalog.withColumn("human_like", human)
    forced = F.col("human_like") | F.col("common_mode") | F.col("instrument_anomaly")
    pool = F.lit(None).cast("string")
    for name in reversed(["instrument_anomaly", "common_mode", "human_like", "strict_candidate", "local_priority", "early_caution"]):
        pool = F.when(F.col(name), name).otherwise(pool)
    return out.withColumns({"label": F.when(forced, "nuisance_like").otherwise(F.col("label")), "screening_pool": F.coalesce(pool, F.lit("expanded_candidate"))})


def early_reference_tags(tagged: DataFrame, time: str, start: int, end: int) -> DataFrame:
    """Within [start, end) everything is nuisance; what no stronger pool claims is named after the period."""
    early = (F.col(time) >= start) & (F.col(time) < end)
    plain = early & ~F.col("instrument_anomaly") & ~F.col("common_mode") & ~F.col("human_like")
    return tagged.withColumns({"early_period": early, "label": F.when(early, "nuisance_like").otherwise(F.col("label")), "screening_pool": F.when(plain, "early_reference_period").otherwise(F.col("screening_pool"))})


def phase(time: str, first: int, second: int) -> Column:
    """pre before first, transition up to and with second, post after it."""
    t = F.col(time)
    return F.when(t < first, "pre").when(t <= second, "transition").otherwise("post")


def branch_transition(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    both = base.select(key, F.col("label").alias("baseline_label")).join(other.select(key, F.col("label").alias("other_label")), key)
    return both.groupBy("baseline_label", "other_label").agg(F.count("*").alias("event_count"))


def branch_summary(base: DataFrame, other: DataFrame, key: str, late: Column) -> DataFrame:
    """metric, value: how the second branch changes the first one's effective events.  late is a condition on base."""
    both = base.select(key, F.col("label").alias("b"), late.alias("late")).join(other.select(key, F.col("label").alias("o")), key)
    eff = lambda c: F.col(c) == "effective_candidate"
    one = both.agg(
        F.count_if(eff("b")).alias("baseline_effective"),
        F.count_if(eff("o")).alias("other_effective"),
        F.count_if(eff("b") & F.col("late")).alias("late_baseline_effective"),
        F.count_if(eff("b") & F.col("late") & eff("o")).alias("late_retained"),
        F.count_if(eff("b") & F.col("late") & ~eff("o")).alias("late_downgraded"),
        F.count_if(F.col("b") != F.col("o")).alias("changed"),
    )
    one = one.withColumns({"late_retention": F.expr("try_divide(late_retained, late_baseline_effective)"), "all_retention": F.expr("try_divide(other_effective, baseline_effective)")})
    pairs = ", ".join(f"'{c}', cast({c} AS double)" for c in one.columns)
    return one.select(F.expr(f"stack({len(one.columns)}, {pairs}) AS (metric, value)"))


def review_rank(df: DataFrame, score: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Position by score, best first; equal scores by key."""
    return df.withColumn("review_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key)))


def review_selection(df: DataFrame, kind: str, score: str, key: str, k: int, unsure: Column, more: int) -> DataFrame:
    """The k best of every kind and the best unsure ones, each once."""
    top = review_rank(df, score, key, [kind]).where(F.col("review_rank") <= k).drop("review_rank")
    return top.unionByName(df.where(unsure).orderBy(F.desc(score), key).limit(more)).dropDuplicates([key])


def wide_by_scale(scored: DataFrame, event: str, scale: str, scales: Sequence[int], values: Sequence[str]) -> DataFrame:
    """One row an event with a column for each value and scale; events that lack a scale are left out."""
    wide = scored.groupBy(event).pivot(scale, list(scales)).agg(*[F.first(v).alias(v) for v in values])
    if len(values) == 1:
        wide = wide.withColumnsRenamed({str(s): f"{s}_{values[0]}" for s in scales})
    return wide.dropna(subset=[c for c in wide.columns if c != event])


def keep_manual_labels(catalog: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Labels set by hand survive a new run; the others are pending."""
    old = previous.select(key, F.col("manual_label").alias("__old"))
    return catalog.join(old, key, "left").withColumn("manual_label", F.coalesce("__old", F.lit("pending"))).drop("__old")


def canonical_kind(kind: str, mapping: dict[str, str] | None = None) -> Column:
    """Through the mapping, null where it has none; without one anything but personnel is pumping."""
    k = F.lower(F.trim(F.col(kind)))
    if mapping is None:
        return F.when(k == "personnel", "personnel").otherwise("pumping")
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.element_at(pairs, k)


def reference_class(task_id: str, known: Sequence[str]) -> Column:
    """The class before the colon of a task's id; anything else is a candidate."""
    prefix = F.split_part(F.col(task_id), F.lit(":"), F.lit(1))
    return F.when(prefix.isin(*known), prefix).otherwise("candidate")
