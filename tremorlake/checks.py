"""Integrity checks as aggregates: each gives the number of violations, and require() raises when there is one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    """Input that breaks a rule."""


def require_columns(df: DataFrame, columns: Sequence[str], label: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise DataError(f"{label} lacks the columns {missing}")
    return df


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """check, violations: rows for which a rule doesn't hold (null counts as not), all rules in one pass."""
    counted = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in rules)
    return counted.select(F.expr(f"stack({len(rules)}, {pairs}) AS (check, violations)"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """check, violations: surplus rows of keys that stand more than once."""
    extra = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    return extra.select(F.lit("unique_" + "_".join(keys)).alias("check"), "violations")


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str], label: str) -> DataFrame:
    """check, violations: rows of left without a partner."""
    return left.join(right, list(on), "left_anti").agg(F.count("*").alias("violations")).select(F.lit(label).alias("check"), "violations")


def require(report: DataFrame) -> None:
    """A report has a row for each check, so the driver sees a handful."""
    bad = report.where("violations > 0").collect()
    if bad:
        raise DataError("; ".join(f"{r['check']}: {r['violations']} rows" for r in bad))


def event_rules(start: str = "start_us", peak: str = "peak_us", end: str = "end_us", activity: str = "activity") -> dict[str, Column]:
    """start <= peak <= end, end > start, and a finite activity of 0 or more."""
    a = F.col(activity)
    return {
        "peak_within": (F.col(start) <= F.col(peak)) & (F.col(peak) <= F.col(end)),
        "positive_duration": F.col(end) > F.col(start),
        "activity_sane": ~F.isnan(a) & (a >= 0) & (a < F.lit(float("inf"))),
    }
