"""Quality control of a delivery of texts: each text's class within its source and language, and its source's.

    python -m jobs.text_quality --documents FOLDER --output FOLDER [--config FILE]

A text is controlled as a recorded channel is: its samples are the lengths of its words.  Damaged characters are
its samples that are no numbers, blank lines its zeros, overlong words its saturated samples, repeated words its
flat line; moments and the largest jump are those of the word lengths, and their spread is judged against all
texts of the source and against those of the same language in it.  Hard faults make a text HARD_BAD, soft ones
REVIEW, others PASS.

OUTPUT/texts holds a row for each text, in folders by class and language; OUTPUT/sources a row for each source;
OUTPUT/languages one for each language.  All are overwritten as wholes, so another run gives the same.  Null texts
are empty ones, and an empty text is HARD_BAD; a missing source or language is one of its own, `(none)`.
"""

from __future__ import annotations

import argparse
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from tremorlake.checks import require_columns
from tremorlake.operators import qc
from tremorlake.sources.shared import cut

log = logging.getLogger("text_quality")
CONFIG = Path(__file__).with_suffix(".json")
NONE = "(none)"
TEXTS = "doc_id BIGINT, source STRING, words BIGINT, std DOUBLE, kurtosis DOUBLE, std_z DOUBLE, group_z DOUBLE, bad_reasons STRING, hard_reasons STRING, review_reasons STRING, source_status STRING, qc_class STRING, lang STRING"


@dataclass(frozen=True)
class Settings:
    id: str
    text: str
    source: str
    language: str
    #: Words of so many characters are saturated.
    longest_word: int
    saturation: float
    spread_z: float
    kurtosis: float
    jump: float
    #: A language with fewer texts in a source is not judged by its spread.
    least_group: int

    def limits(self) -> qc.Limits:
        return qc.Limits(saturation=self.saturation, std_z=self.spread_z, kurtosis=self.kurtosis, jump=self.jump, group=self.least_group)


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = "words long, total double, p2 double, p4 double, saturated long, same long, jump double, lines long, blank long"


def counts(longest_word: int) -> Callable[[Column], Column]:
    """Of a text: its words, the sum of their lengths and of powers of these about their mean, words that are too long
    and that repeat the one before, the largest jump, lines and blank ones.  One pass in an Arrow batch: a lambda of
    SQL is interpreted for every word, and this took ten of them."""

    def one(text: str) -> tuple:
        words, lines = WORD.findall(text), text.split("\n")
        x = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
        total = float(x.sum())
        d = x - total / max(1, len(x))
        # added up in the order of the words, as an aggregate does
        p2, p4 = (float(np.cumsum(np.power(d, k))[-1]) if len(d) else 0.0 for k in (2.0, 4.0))
        jump = float(np.abs(np.diff(x)).max()) if len(x) > 1 else 0.0
        return len(words), total, p2, p4, int((x >= longest_word).sum()), sum(map(eq, words, words[1:])), jump, len(lines), sum(not line.strip(" ") for line in lines)

    @F.pandas_udf(COUNTS)
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(text) for text in texts], columns=[c.split()[0] for c in COUNTS.split(", ")])

    return counted


def measured(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, source, lang and what quality control reads, of every row."""
    text = F.coalesce(F.col(s.text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(s.id).cast("long").alias("doc_id"),
        F.coalesce(F.col(s.source).cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col(s.language).cast("string"), F.lit(NONE)).alias("lang"),
        F.length(text).alias("chars"),
        F.regexp_count(text, F.lit(r"[\x00-\x08\x0E-\x1F\x7F\x{FFFD}]")).alias("damaged"),
        counts(s.longest_word)(F.make_valid_utf8(text)).alias("c"),
    ).select("*", "c.*")
    told = rows.select(
        "doc_id",
        "source",
        "lang",
        "words",
        share(F.col("damaged"), F.col("chars")).alias("nonfinite_fraction"),
        share(F.col("blank"), F.col("lines")).alias("zero_fraction"),
        share(F.col("saturated"), F.col("words")).alias("saturation_fraction"),
        F.coalesce(F.try_divide(F.col("same").cast("double"), F.col("words") - 1), F.lit(0.0)).alias("flat_fraction"),
        F.col("jump").alias("max_jump"),
        F.try_divide("total", "words").alias("mean"),
        F.try_divide("p2", "words").alias("m2"),
        F.try_divide("p4", "words").alias("m4"),
    )
    return told.withColumns({"std": F.sqrt("m2"), "kurtosis": F.try_divide(F.col("m4"), F.col("m2") * F.col("m2"))}).drop("m2", "m4")


def judged(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """The class of every text, and the summary of every source."""
    # the texts are read and measured once
    rows = cut(measured(docs, s))
    flagged = qc.flag_channels(rows, "source", s.limits())
    layout = rows.select("lang").distinct().withColumn("qc_group", F.col("lang"))
    classed = cut(qc.classify(flagged, layout, "source", "lang", "qc_group", s.limits()))
    sources = qc.file_summary(classed, "source")
    status = sources.select("source", F.col("quality_status").alias("source_status"))
    told = classed.join(status, "source").select(
        "doc_id",
        "source",
        "words",
        F.round("std", 6).alias("std"),
        F.round("kurtosis", 4).alias("kurtosis"),
        F.round("std_z", 4).alias("std_z"),
        F.round("group_z", 4).alias("group_z"),
        "bad_reasons",
        F.concat_ws(";", "hard_reasons").alias("hard_reasons"),
        F.concat_ws(";", "review_reasons").alias("review_reasons"),
        "source_status",
        "qc_class",
        "lang",
    )
    return told, sources


def languages(texts: DataFrame) -> DataFrame:
    n = F.count("*")
    return texts.groupBy("lang").agg(n.alias("texts"), F.count_if(F.col("qc_class") == "HARD_BAD").alias("hard_bad"), F.count_if(F.col("qc_class") == "REVIEW").alias("review"), (F.count_if(F.col("qc_class") != "HARD_BAD") / n).alias("valid_rate"))


def run(spark: SparkSession, documents: str, output: str, s: Settings) -> DataFrame:
    """Controls the Parquet files at documents and returns the texts' classes as they were written."""
    docs = require_columns(spark.read.parquet(documents), (s.id, s.text, s.source, s.language), documents)
    log.info("reading %s into %s", documents, output)
    texts, sources = judged(docs, s)
    texts.write.mode("overwrite").partitionBy("qc_class", "lang").parquet(f"{output}/texts")
    sources.write.mode("overwrite").parquet(f"{output}/sources")
    written = result(spark, output)
    languages(written).write.mode("overwrite").parquet(f"{output}/languages")
    counts = {r["qc_class"]: r["count"] for r in written.groupBy("qc_class").count().collect()}  # three classes
    log.info("wrote %d texts: %s", sum(counts.values()), counts)
    return written


def result(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(TEXTS).parquet(f"{output}/texts")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--documents", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(argv)
    settings.show_log()
    from tremorlake.session import get_spark

    spark = get_spark()
    try:
        run(spark, a.documents, a.output, settings.load(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
