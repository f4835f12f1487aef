"""Learned operators on pyspark.ml: signal types by mixtures, and a grouped cross-validated forest."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.operators.robust import robust_scale
from tremorlake.sources.shared import cut


def robust_vector(df: DataFrame, features: Sequence[str], limit: float = 12.0, name: str = "z") -> DataFrame:
    """A vector of the features, missing ones at the median, by robust centre and scale, clipped."""
    out = df
    for f in features:
        s = robust_scale(df.where(F.col(f).isNotNull()), [], f).select(F.col("center").alias("__c"), F.col("spread").alias("__s"))
        out = out.join(F.broadcast(s), how="left", on=F.lit(True))
        z = (F.coalesce(F.col(f), F.col("__c")) - F.col("__c")) / F.col("__s")
        out = out.withColumn(f"__{f}", F.greatest(F.lit(-limit), F.least(F.lit(limit), z))).drop("__c", "__s")
    made = VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol=name).transform(out)
    return made.drop(*[f"__{f}" for f in features])


def bic(log_likelihood: float, n: int, k: int, d: int) -> float:
    free = k * (d + d * (d + 1) / 2) + k - 1
    return -2 * log_likelihood + free * math.log(n)


#: Rows that a task of a mixture's fit takes.
TASK_ROWS = 50_000


def signal_types(events: DataFrame, features: Sequence[str], order: Sequence[str], least: int = 2, most: int = 6, seed: int = 0, starts: int = 5) -> tuple[DataFrame, list[tuple[int, float]]]:
    """signal_type (Type A, B, ... by the medians of the order columns) and the BIC of each number of types.

    Of the starts of each number the one with the largest likelihood counts."""
    events = cut(events)  # read for every feature
    n = events.count()
    ready = cut(robust_vector(events, features))  # read by every fit
    # every task of every step of every fit tells the driver something
    ready = ready.coalesce(max(1, math.ceil(n / TASK_ROWS)))
    ready = PCA(k=min(5, len(features)), inputCol="z", outputCol="pcs").fit(ready).transform(ready)
    most = min(most, max(least, n // 20))
    fits, scores = {}, []
    for k in range(least, most + 1):
        tries = [GaussianMixture(k=k, featuresCol="pcs", predictionCol="raw", probabilityCol="share", seed=seed + 1000 * i).fit(ready) for i in range(starts)]
        fits[k] = max(tries, key=lambda m: m.summary.logLikelihood)
        scores.append((k, bic(fits[k].summary.logLikelihood, n, k, min(5, len(features)))))
    best = min(scores, key=lambda s: s[1])[0]
    placed = fits[best].transform(ready)
    ranks = placed.groupBy("raw").agg(*[F.median(c).alias(c) for c in order])
    letters = ranks.select("raw", F.concat(F.lit("Type "), F.char(F.row_number().over(Window.orderBy(*order, "raw")) + 64)).alias("signal_type"))
    return placed.join(F.broadcast(letters), "raw").withColumn("pc", vector_to_array("pcs")).drop("z", "pcs", "share", "raw"), scores


def confirmed_types(catalog: DataFrame, features: Sequence[str], order: Sequence[str], at_least: int = 20, **settings) -> DataFrame:
    """catalog with confirmed_type: signal types among the events that reviewers call effective alone; not_assigned
    for all others, and for all where fewer than at_least are confirmed."""
    confirmed = F.lower(F.trim(F.col("manual_label").cast("string"))) == "effective"
    own = catalog.where(confirmed)
    none = F.lit("not_assigned")
    if own.limit(at_least).count() < at_least:
        return catalog.withColumn("confirmed_type", none)
    placed, _ = signal_types(own, features, order, **settings)
    typed = placed.select("event_id", F.col("signal_type").alias("__t"))
    return catalog.join(typed, "event_id", "left").withColumn("confirmed_type", F.coalesce("__t", none)).drop("__t")


def balanced_folds(groups: dict, folds: int) -> dict:
    """group -> fold: the largest groups first, each to the fold with the fewest rows so far."""
    sizes, out = [0] * folds, {}
    for name, n in sorted(groups.items(), key=lambda g: (-g[1], str(g[0]))):
        at = min(range(folds), key=lambda f: (sizes[f], f))
        out[name], sizes[at] = at, sizes[at] + n
    return out


def forest(trees: int, seed: int = 0) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=trees, minInstancesPerNode=3, seed=seed)


def weighted(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """rows with x, y and w; both classes weigh alike."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}  # two classes
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return VectorAssembler(inputCols=list(features), outputCol="x").transform(rows.withColumns({"w": weight, "y": F.col(label).cast("double")}))


#: Groups whose folds are balanced one by one; more are dealt by hash, which then balances them.
GROUPS = 100_000


def grouped_forest(rows: DataFrame, features: Sequence[str], label: str, group: str, key: str, folds: int = 5, trees: int = 500, seed: int = 0) -> DataFrame:
    """key, label, probability: out of fold, whole groups held out together, classes weighted evenly."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).limit(GROUPS + 1).collect()
    if len(sizes) > GROUPS:
        placed = rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))
    else:
        dealt = list(balanced_folds({r[0]: r["n"] for r in sizes}, folds).items())
        listed = rows.sparkSession.createDataFrame(dealt, f"`{group}` {dict(rows.dtypes)[group]}, fold int")
        placed = rows.join(F.broadcast(listed), group)  # GROUPS rows at most
    ready = cut(weighted(placed, features, label).select(key, "y", "x", "w", "fold"))
    out = None
    for fold in range(folds):
        model = forest(trees, seed).fit(ready.where(F.col("fold") != fold))
        part = model.transform(ready.where(F.col("fold") == fold)).select(key, F.col("y").cast("int").alias(label), vector_to_array("probability")[1].alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


def saved_forest(rows: DataFrame, features: Sequence[str], label: str, path: str, trees: int = 800, seed: int = 0) -> RandomForestClassificationModel:
    """A forest over all rows, written to path; RandomForestClassificationModel.load reads it."""
    model = forest(trees, seed).fit(weighted(rows, features, label))
    model.write().overwrite().save(path)
    return model


def precision_recall(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall at each distinct score, from its counts."""
    per = scored.groupBy(score).agg(F.sum(label).alias("t"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc(score))
    run = per.withColumns({"tp": F.sum("t").over(w), "at": F.sum("n").over(w), "all": F.sum("t").over(Window.partitionBy())})
    return run.select(score, (F.col("tp") / F.col("at")).alias("precision"), (F.col("tp") / F.col("all")).alias("recall"))


def threshold_at_precision(curve: DataFrame, score: str, least: float = 0.9) -> DataFrame:
    """The score with the largest recall at that precision or better, and the average precision of the curve."""
    steps = curve.withColumn("gain", F.col("recall") - F.coalesce(F.lag("recall").over(Window.orderBy("recall")), F.lit(0.0)))
    ok = F.col("precision") >= least
    return steps.agg(F.max_by(F.when(ok, F.col(score)), F.when(ok, F.struct(F.col("recall"), F.col(score)))).alias("threshold"), F.sum(F.col("gain") * F.col("precision")).alias("average_precision"))
