"""Bitmaps of fixed largest size over 64-bit hashes, for filters before an exact join.

A false hit costs time and never a result; a full bitmap lets everything through to the join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest bitmap: 2**23 bits, 1 MiB.
LARGEST = 23


def probes(h: Column, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1).cast("bigint")
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]


def bitmap_longs(hashes: DataFrame, bits: int) -> DataFrame:
    """k, v: the longs in which two bits of each hash h are set; at most 2**(bits - 6) rows."""
    spots = hashes.select(F.explode(F.array(*probes(F.col("h"), bits))).alias("spot"))
    return spots.groupBy(F.shiftright("spot", 6).alias("k")).agg(F.bit_or(_one_at(F.col("spot"))).alias("v"))


def bitmap_subquery(hashes: DataFrame) -> tuple[Column, int]:
    """The bitmap as a scalar subquery, and its bits.  It is computed once a query and is no part of the plan's text."""
    bits = min(LARGEST, max(10, (64 * hashes.count()).bit_length()))
    empty = hashes.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v"))
    longs = bitmap_longs(hashes, bits).unionByName(empty).groupBy("k").agg(F.bit_or("v").alias("v"))
    return longs.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("bitmap")).scalar(), bits


def possible(h: Column, marks: Column, bits: int) -> Column:
    tests = [marks[F.shiftright(p, 6).cast("int")].bitwiseAND(_one_at(p)) != 0 for p in probes(h, bits)]
    return tests[0] & tests[1]


def _one_at(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), p.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
