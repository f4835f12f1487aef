"""Every query of the engine with its oracle, where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremorlake.plans import learned, signals, statistics, stored, time_space, waveforms

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (time_space, statistics, signals, waveforms, learned, stored)


def queries() -> dict[str, Query]:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
