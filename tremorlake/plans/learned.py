"""Queries of learned operators; their fits have no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators import ml
from tremorlake.plans.das import DAY, T0, das
from tremorlake.plans.statistics import catalog


def signal_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = catalog(spark, sf_dir).where("label = 'effective_candidate'")
    placed, _ = ml.signal_types(events, ["max_ratio", "novel_scale_count", "median_ratio", "best_scale"], ["best_scale", "max_ratio"], most=4, starts=2)
    return placed.groupBy("signal_type").agg(F.count("*").alias("event_count"), F.median("max_ratio").alias("median_ratio"), F.median("best_scale").alias("median_scale"))


def review_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of a long event, days held out together, and the curve's working point."""
    e = das(spark, sf_dir)
    rows = e.select("event_id", (F.col("activity") > 60).cast("int").alias("label"), F.expr(f"(peak_us - {T0}) div {DAY}").alias("day"), (F.col("activity") + F.col("event_id") % 40).alias("f0"), (F.col("node") % 10).alias("f1"))
    scored = ml.grouped_forest(rows, ["f0", "f1"], "label", "day", "event_id", folds=3, trees=10)
    return ml.threshold_at_precision(ml.precision_recall(scored.withColumn("probability", F.round("probability", 3)), "label", "probability"), "probability")


QUERIES = {f.__name__: f for f in (signal_types, review_classifier)}
ORACLES: dict[str, str] = {}
