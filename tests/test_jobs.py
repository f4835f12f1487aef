"""The jobs: against their SQL, over inputs that grow, and after runs that were lost."""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import replace
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import DATA, rows

from jobs import activity_stream, registry, settings, text_quality
from tremorlake.checks import DataError

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, extra string"
DAY = dt.datetime(2024, 1, 1)
STREAM = settings.load(activity_stream.Settings, activity_stream.CONFIG)
QUALITY = settings.load(text_quality.Settings, text_quality.CONFIG)


def at(day, hour, minute=0, second=0):
    return DAY + dt.timedelta(days=day, hours=hour, minutes=minute, seconds=second)


def deliver(spark, path, found):
    spark.createDataFrame([(*r, "x") for r in found], EVENTS).coalesce(1).write.mode("append").parquet(str(path))


def cells(frame):
    return {(r["day"], r["node"], r["minute_us"]): (r["event_count"], r["activity"], r["cumulative_count"], r["cumulative_activity"]) for r in frame.collect()}


def folders(path):
    return {p.relative_to(path).as_posix(): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_job_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    before = dict(spark.conf.getAll)
    got, want = registry.QUERIES[name](spark, str(DATA)).toPandas(), con.execute(registry.ORACLES[name]).fetchdf()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    after = dict(spark.conf.getAll)
    assert {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)} <= {"spark.checkpoint.dir"}


def test_only_new_files_are_taken_and_only_their_days_written(spark, tmp_path, caplog):
    events, out = tmp_path / "events", str(tmp_path / "out")
    deliver(spark, events, [(1, at(0, 1), 7, "view", 2.0), (2, at(0, 1, 0, 30), 7, "view", 0.5), (3, at(1, 5), 7, "click", 1.0)])
    activity_stream.run(spark, str(events), out, STREAM)
    first = folders(f"{out}/activity")
    with caplog.at_level(logging.INFO, "activity_stream"):
        again = cells(activity_stream.run(spark, str(events), out, STREAM))
    assert folders(f"{out}/activity") == first and "read 3" not in caplog.text
    minute = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) // 60 * 60_000_000
    assert again == {("2024-01-01", 7, minute(at(0, 1))): (2, 2.5, 2, 2.5), ("2024-01-02", 7, minute(at(1, 5))): (1, 1.0, 1, 1.0)}
    # a late record of the second day, a new day, and the second event delivered again with another value
    deliver(spark, events, [(4, at(1, 2), 7, "view", 4.0), (5, at(2, 3), 8, "signup", 8.0), (2, at(0, 1, 0, 30), 7, "view", 0.75)])
    with caplog.at_level(logging.INFO, "activity_stream"):
        grown = cells(activity_stream.run(spark, str(events), out, STREAM))
    assert "read 3 records, rejected 0" in caplog.text
    assert grown == {
        ("2024-01-01", 7, minute(at(0, 1))): (2, 2.75, 2, 2.75),
        ("2024-01-02", 7, minute(at(1, 2))): (1, 4.0, 1, 4.0),
        ("2024-01-02", 7, minute(at(1, 5))): (1, 1.0, 2, 5.0),
        ("2024-01-03", 8, minute(at(2, 3))): (1, 8.0, 1, 8.0),
    }
    # one whole run over all files gives the same
    assert cells(activity_stream.run(spark, str(events), str(tmp_path / "whole"), STREAM))[("2024-01-02", 7, minute(at(1, 5)))] == (1, 1.0, 2, 5.0)
    deliver(spark, events, [(6, at(9, 3), 8, "signup", 8.0)])
    second = folders(f"{out}/activity")
    activity_stream.run(spark, str(events), out, STREAM)
    third = folders(f"{out}/activity")
    assert {k: v for k, v in third.items() if "2024-01-10" not in k} == second and len(third) > len(second)
    days = {r["day"]: r["event_count"] for r in spark.read.parquet(f"{out}/days").withColumn("day", F.col("day").cast("string")).collect()}
    assert days == {"2024-01-01": 2, "2024-01-02": 2, "2024-01-03": 1, "2024-01-10": 1}


def test_a_lost_batch_is_taken_again_with_the_same_result(spark, tmp_path, monkeypatch):
    events, out = tmp_path / "events", str(tmp_path / "out")
    deliver(spark, events, [(1, at(0, 1), 7, "view", 2.0)])
    activity_stream.run(spark, str(events), out, STREAM)
    deliver(spark, events, [(2, at(0, 2), 7, "view", 3.0), (3, at(4, 2), 9, "view", 3.0)])
    whole = activity_stream.minutes

    def lost(records):
        raise RuntimeError("lost")

    monkeypatch.setattr(activity_stream, "minutes", lost)
    with pytest.raises(Exception, match="lost"):
        activity_stream.run(spark, str(events), out, STREAM)
    assert len(cells(activity_stream.result(spark, out))) == 1  # what stood before still stands
    monkeypatch.setattr(activity_stream, "minutes", whole)
    got = cells(activity_stream.run(spark, str(events), out, STREAM))
    assert got == cells(activity_stream.run(spark, str(events), str(tmp_path / "other"), STREAM)) and len(got) == 3
    records = spark.read.schema(activity_stream.RECORDS).parquet(f"{out}/records")
    assert records.count() == 3


def test_unsound_records_are_put_aside(spark, tmp_path):
    events, out = tmp_path / "events", str(tmp_path / "out")
    bad = [(None, at(0, 1), 7, "view", 1.0), (1, None, 7, "view", 1.0), (2, at(0, 1), None, "view", 1.0), (3, at(0, 1), 7, "noise", 1.0), (3, at(0, 1), 7, None, 1.0), (4, at(0, 1), 7, "view", float("nan")), (5, at(0, 1), 7, "view", -1.0), (6, at(0, 1), 7, "view", None)]
    deliver(spark, events, bad)
    assert activity_stream.run(spark, str(events), out, STREAM).count() == 0
    deliver(spark, events, [(9, at(0, 1), 7, "view", 1.0)])
    assert activity_stream.run(spark, str(events), out, STREAM).count() == 1
    faults = sorted(r["fault"] for r in spark.read.parquet(f"{out}/rejected").collect())
    assert faults == ["kind", "kind", "no id", "no position", "no time", "value", "value", "value"]


def test_too_many_days_and_missing_columns_are_errors(spark, tmp_path):
    deliver(spark, tmp_path / "events", [(i, at(i, 1), 7, "view", 1.0) for i in range(4)])
    with pytest.raises(Exception, match="over 3 days"):
        activity_stream.run(spark, str(tmp_path / "events"), str(tmp_path / "out"), replace(STREAM, most_days=3))
    with pytest.raises(DataError, match="other"):
        activity_stream.run(spark, str(tmp_path / "events"), str(tmp_path / "out"), replace(STREAM, id="other"))


def documents(spark, found):
    return spark.createDataFrame([(*r, 1, "x") for r in found], "doc_id long, text string, source string, lang string, n long, words string")


def test_texts_are_classed_and_runs_agree(spark, tmp_path):
    plain = "some words of quite different length stand in every single line of it"
    found = [(i, " ".join(plain.split()[i % 5 :]), "a", "en") for i in range(30)]
    found += [(100, None, "a", "en"), (101, "", None, None), (102, "one", "a", "en"), (103, "no " * 50, "a", "de"), (104, "x" * 60 + " and " + plain, "b", "en"), (105, "\x00\x01" + plain, "b", "en"), (None, plain, "a", "en"), (None, plain, "a", "en"), (106, plain + " " + "y" * 39, "a", "en")]
    documents(spark, found).write.parquet(str(tmp_path / "docs"))
    out = str(tmp_path / "out")
    first = sorted(text_quality.run(spark, str(tmp_path / "docs"), out, QUALITY).collect(), key=str)
    assert len(first) == len(found)
    told = {r["doc_id"]: r for r in first}
    assert {told[i]["qc_class"] for i in range(30)} == {"PASS"}
    assert told[100]["hard_reasons"] == "ZERO_OR_DEAD;NO_VARIANCE" and told[100]["words"] == 0 and (told[101]["source"], told[101]["lang"]) == ("(none)", "(none)")
    assert "FLATLINE" in told[103]["hard_reasons"] and "SATURATED" in told[104]["hard_reasons"] and "NONFINITE" in told[105]["hard_reasons"]
    assert told[106]["qc_class"] == "REVIEW" and told[106]["source_status"] == "WARN"
    again = sorted(text_quality.run(spark, str(tmp_path / "docs"), out, QUALITY).collect(), key=str)
    assert again == first
    by = {r["lang"]: r for r in spark.read.parquet(f"{out}/languages").collect()}
    assert by["de"]["hard_bad"] == 1 and by["en"]["texts"] == 37


def test_words_are_measured_in_one_pass(spark):
    """No lambda of SQL runs for every word, and odd characters count as before: no-break spaces and separators of
    Unicode don't part words, characters beyond the first plane are one, damaged bytes are replaced."""
    texts = ["a\u00a0b cc\x1cd\x0bee", "x  x\tx yyy\n \n\t\n", "\U0001f600\U0001f600 z", " \n  ", "", None, "w" * 40 + " v"]
    found = documents(spark, [(i, v, "a", "en") for i, v in enumerate(texts)]).unionByName(spark.sql("SELECT 7L doc_id, cast(unhex('4128C328FF2042') AS string) text, 'a' source, 'en' lang, 1L n, 'x' words"))
    made = text_quality.measured(found, QUALITY)
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r for r in made.collect()}
    assert [got[i]["words"] for i in range(8)] == [3, 4, 2, 0, 0, 0, 2, 2]
    assert [got[i]["mean"] for i in range(8)] == [3.0, 1.5, 1.5, None, None, None, 20.5, 3.0]
    assert [got[i]["max_jump"] for i in range(8)] == [2.0, 2.0, 1.0, 0.0, 0.0, 0.0, 39.0, 4.0]
    assert [got[i]["zero_fraction"] for i in range(4)] == [0.0, 0.5, 0.0, 1.0] and got[4]["zero_fraction"] == got[5]["zero_fraction"] == 1.0
    assert got[1]["flat_fraction"] == 2 / 3 and got[6]["saturation_fraction"] == 0.5
    assert got[0]["nonfinite_fraction"] == 1 / 11 and got[7]["nonfinite_fraction"] == 2 / 6
    assert got[1]["std"] == 0.75**0.5 and got[3]["std"] is None and got[3]["kurtosis"] is None


def test_no_texts(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "docs"))
    assert text_quality.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), QUALITY).count() == 0


def test_settings_of_unknown_names_are_refused(tmp_path):
    (tmp_path / "c.json").write_text('{"id": "a", "colour": 1}')
    with pytest.raises(DataError, match="colour"):
        settings.load(activity_stream.Settings, tmp_path / "c.json")
