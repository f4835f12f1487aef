"""Tables made unit by unit, and array containers: against whole runs and against numpy."""

from __future__ import annotations

import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.checks import DataError
from tremorlake.sources import arrays, incremental

SCHEMA = "n BIGINT, value DOUBLE"


def units(spark, versions):
    return spark.createDataFrame(list(versions.items()), "unit string, fingerprint string")


class Maker:
    """Rows of a unit by its version, and which units were asked for."""

    def __init__(self, spark, rows):
        self.spark, self.rows, self.asked = spark, rows, []

    def __call__(self, todo):
        self.asked = sorted(r["unit"] for r in todo.collect())
        own = [(u, i, float(v)) for u in self.asked for i, v in enumerate(self.rows[u])]
        return self.spark.createDataFrame(own, "unit string, n long, value double")

    def want(self, listed):
        return sorted((u, i, float(v)) for u in listed for i, v in enumerate(self.rows[u]))


def got(found):
    return sorted(tuple(r) for r in found.table.collect())


def times(path):
    return {p.parent.name: p.stat().st_mtime_ns for p in Path(path).rglob("data/unit=*/*.parquet")}


def test_one_changed_file_of_fifty_is_made_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    versions = {f"file {i:02d}": "1" for i in range(50)}
    make = Maker(spark, {u: [i, i + 1, i + 2] for i, u in enumerate(versions)})
    first = incremental.refresh(spark, path, units(spark, versions), {"a": 1}, SCHEMA, make)
    assert make.asked == sorted(versions) and got(first) == make.want(versions)
    assert {r["reason"] for r in first.made.collect()} == {"new"}
    before = times(path)
    again = incremental.refresh(spark, path, units(spark, versions), {"a": 1}, SCHEMA, lambda _: pytest.fail("nothing is to be made"))
    assert got(again) == got(first) and again.made.count() == 0 and times(path) == before
    make.rows["file 07"] = [70, 71]
    changed = incremental.refresh(spark, path, units(spark, versions | {"file 07": "2"}), {"a": 1}, SCHEMA, make)
    assert make.asked == ["file 07"] and [tuple(r) for r in changed.made.collect()] == [("file 07", "changed")]
    after = times(path)
    assert {u for u in after if after[u] != before.get(u)} == {"unit=file 07"}
    whole = incremental.refresh(spark, str(tmp_path / "other"), units(spark, versions | {"file 07": "2"}), {"a": 1}, SCHEMA, make)
    assert got(changed) == got(whole)
    # other settings have a table of their own
    make.rows = {u: [9] for u in versions}
    assert got(incremental.refresh(spark, path, units(spark, versions), {"a": 2}, SCHEMA, make)) == make.want(versions)
    make.rows = {u: [0] for u in versions}
    assert got(incremental.refresh(spark, path, units(spark, versions), {"a": 2}, SCHEMA, make)) != make.want(versions)


def test_units_that_come_go_and_turn_empty(spark, tmp_path):
    path = str(tmp_path / "cache")
    make = Maker(spark, {"a": [1, 2], "b": [3], "c": []})
    run = lambda versions: got(incremental.refresh(spark, path, units(spark, versions), 1, SCHEMA, make))
    assert run({}) == []
    assert run({"a": "1", "b": "1", "c": "1"}) == make.want("abc")
    assert run({"a": "1", "c": "1"}) == make.want("ac")
    make.rows["a"], make.rows["c"], make.asked = [], [5, 6], []
    assert run({"a": "2", "c": "2"}) == [("c", 0, 5.0), ("c", 1, 6.0)] and make.asked == ["a", "c"]
    make.asked = []
    assert run({"a": "2", "b": "1", "c": "2"}) == [("b", 0, 3.0), ("c", 0, 5.0), ("c", 1, 6.0)] and make.asked == []
    with pytest.raises(DataError, match="a is listed 2"):
        incremental.refresh(spark, path, units(spark, {"a": "2"}).union(units(spark, {"a": "2"})), 1, SCHEMA, make)


def test_unsound_units_are_repaired(spark, tmp_path):
    path = tmp_path / "cache"
    make = Maker(spark, {u: [1, 2, 3] for u in "abcd"})
    versions = dict.fromkeys("abcd", "1")
    rules = {"positive": F.col("value") > 0}
    run = lambda: incremental.refresh(spark, str(path), units(spark, versions), 1, SCHEMA, make, rules)
    run()
    data = next(path.rglob("data"))
    part = lambda u: next((data / f"unit={u}").glob("*.parquet"))
    part("a").unlink()
    for crc in (data / "unit=b").glob(".*.crc"):
        crc.unlink()
    part("b").write_bytes(b"not a table")
    spark.createDataFrame([(0, 1.0, "1"), (1, 2.0, "1"), (2, 4.0, "1")], "n long, value double, fingerprint string").coalesce(1).write.mode("overwrite").parquet(str(data / "unit=c"))
    found = run()
    assert {r["unit"]: r["reason"] for r in found.made.collect()} == {"a": "another number of rows", "b": "another number of rows", "c": "other rows"}
    assert make.asked == ["a", "b", "c"] and got(found) == make.want("abcd")
    make.rows["d"] = [1, -1]
    versions["d"] = "2"
    run()
    assert [tuple(r) for r in run().made.collect()] == [("d", "rows break positive")]


def test_a_lost_refresh_is_made_up_for(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    make = Maker(spark, {u: [1, 2] for u in "ab"})
    run = lambda versions: incremental.refresh(spark, path, units(spark, versions), 1, SCHEMA, make)
    run({"a": "1", "b": "1"})
    write = incremental._replace
    monkeypatch.setattr(incremental, "_replace", lambda frame, at: write(frame, at) if at.endswith("data") else 1 / 0)
    make.rows["a"] = [7, 8, 9]
    with pytest.raises(ZeroDivisionError):
        run({"a": "2", "b": "1"})
    monkeypatch.undo()
    assert got(run({"a": "2", "b": "1"})) == make.want("ab") and make.asked == ["a"]


def test_batches_follow_their_files_and_neighbours(spark):
    files = {f"f{i}": "1" for i in range(10)}
    told, members = incremental.batch_units(units(spark, files), F.col("unit"), 3)
    reads = {}
    for r in members.collect():
        reads.setdefault(r["unit"], {})[r["member"]] = r["core"]
    assert reads["batch_000001"] == {"f2": False, "f3": True, "f4": True, "f5": True, "f6": False}
    assert reads["batch_000003"] == {"f8": False, "f9": True} and len(reads) == 4
    prints = lambda f: {r["unit"]: r["fingerprint"] for r in incremental.batch_units(units(spark, f), F.col("unit"), 3)[0].collect()}
    before, after = prints(files), prints(files | {"f2": "2"})
    assert {u for u in before if before[u] != after[u]} == {"batch_000000", "batch_000001"}


# array containers


def stored(path, **members):
    path.parent.mkdir(exist_ok=True)
    np.savez(path, **members)
    return path


def cells(frame):
    return {(r["container"], r["member"], r["channel"], r["first_row"] + i): v for r in frame.collect() for i, v in enumerate(r["samples"])}


def of_array(container, member, x):
    x = x.reshape(len(x), -1)
    return {(container, member, c, i): float(x[i, c]) for i in range(x.shape[0]) for c in range(x.shape[1])}


@pytest.mark.parametrize("compressed", [True, False])
def test_containers_read_as_numpy_has_them(spark, tmp_path, compressed):
    rng = np.random.default_rng(1)
    save = np.savez_compressed if compressed else np.savez
    wave, counts, times_, cube = rng.normal(size=(103, 7)).astype("f4"), rng.integers(0, 99, (50, 3)).astype("i2"), np.arange(41, dtype="i8"), rng.normal(size=(5, 2, 3))
    save(tmp_path / "a.npz", wave=wave, counts=counts, times=times_, none=np.zeros((0, 4)))
    save(tmp_path / "b.npz", wave=wave[:10], cube=cube)
    read = lambda **o: arrays.read_containers(spark, str(tmp_path), block=8, slice_bytes=300, **o)
    want = of_array("a.npz", "wave", wave) | of_array("a.npz", "counts", counts) | of_array("a.npz", "times", times_) | of_array("b.npz", "wave", wave[:10]) | of_array("b.npz", "cube", cube)
    assert cells(read()) == want
    some = {k: v for k, v in want.items() if k[1] == "wave" and k[2] in (2, 6) and 13 <= k[3] <= 57}
    assert cells(read(members=["wave"], channels=[2, 6], first=13, last=57)) == some
    assert cells(arrays.read_containers(spark, f"{tmp_path}/b.npz", members="cube")) == of_array("b.npz", "cube", cube)
    assert read(members=["other"]).count() == 0 and read(channels=[99]).count() == 0


def test_pushed_filters_change_no_result(spark, tmp_path):
    wave = np.random.default_rng(2).normal(size=(103, 7))
    stored(tmp_path / "a.npz", wave=wave, other=wave[:, :2])
    rule = "member = 'wave' AND channel IN (1, 4) AND first_row >= 19 AND first_row < 80"
    read = lambda: arrays.read_containers(spark, str(tmp_path), block=8, slice_bytes=300).where(rule)
    want = cells(read())
    assert {k[3] for k in want} == set(range(24, 80)) and {k[2] for k in want} == {1, 4}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert cells(read()) == want
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = arrays.PushedReader({"path": str(tmp_path), "block": "8", "slice_bytes": "300"})
    left = list(reader.pushFilters([arrays.EqualTo(("member",), "wave"), arrays.In(("channel",), (1, 4)), arrays.GreaterThanOrEqual(("first_row",), 19), arrays.LessThan(("first_row",), 80)]))
    assert len(left) == 2 and reader.wanted == arrays.Wanted(frozenset({"wave"}), frozenset({1, 4}), 24, 79)


def test_only_the_wanted_bytes_are_read(tmp_path, monkeypatch):
    wave = np.random.default_rng(3).normal(size=(20_000, 16))
    stored(tmp_path / "a.npz", wave=wave, large=np.zeros((100_000, 8)))
    read = []
    plain = arrays.store

    class Counted:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def open_input_file(self, at):
            handle = self.files.open_input_file(at)

            class Handle:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    handle.close()

                def read(self, n=-1):
                    out = handle.read() if n is None or n < 0 else handle.read(n)
                    read.append(len(out))
                    return out

                def __getattr__(self, name):
                    return getattr(handle, name)

            return Handle()

    monkeypatch.setattr(arrays, "store", lambda path: (Counted(plain(path)[0]), plain(path)[1]))
    reader = arrays.ArrayReader({"path": str(tmp_path), "members": "wave", "channels": "5", "first": "8192", "last": "12287", "block": "1024"})
    parts = reader.partitions()
    assert sum(read) < 100_000  # the directory and two headers, of 9 MB
    read.clear()
    out = [b for p in parts for b in reader.read(p)]
    assert sum(read) == 4096 * 16 * 8
    assert np.array_equal(np.concatenate([np.asarray(b.column("samples")[0].values) for b in out]), wave[8192:12288, 5])


def rows_of(spark, containers):
    found = [(c, m, i, [float(v) for v in np.atleast_1d(x[i])], str(x.dtype.str), x.ndim == 1) for c, members in containers.items() for m, x in members.items() for i in range(len(x))]
    return spark.createDataFrame(found, "container string, member string, row long, samples array<double>, kind string, flat boolean")


@pytest.mark.parametrize("compressed", [True, False])
def test_written_containers_are_numpys_own(spark, tmp_path, compressed):
    rng = np.random.default_rng(4)
    want = {f"study {i}": {"counts": rng.integers(0, 9, (30, 4)).astype("<i4"), "maxima": rng.normal(size=17), "perm": rng.integers(0, 9, (11, 6)).astype("<i2")} for i in range(5)}
    out = tmp_path / "out"
    arrays.write_containers(rows_of(spark, want).orderBy(F.rand(1)), str(out), compressed)
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == sorted(f"{c}.npz" for c in want)
    for c, members in want.items():
        with np.load(out / f"{c}.npz", allow_pickle=False) as back:
            assert sorted(back.files) == sorted(members)
            for m, x in members.items():
                assert back[m].dtype == x.dtype and np.array_equal(back[m], x)
        kinds = {i.compress_type for i in zipfile.ZipFile(out / f"{c}.npz").infolist()}
        assert kinds == {zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED}
    back = cells(arrays.read_containers(spark, str(out)))
    assert back == {k: v for c, members in want.items() for m, x in members.items() for k, v in of_array(f"{c}.npz", m, x).items()}
    # appended to, and overwritten
    more = {"study 9": {"maxima": np.arange(3.0)}}
    arrays.write_containers(rows_of(spark, more), str(out))
    assert len(list(out.glob("*.npz"))) == 6
    arrays.write_containers(rows_of(spark, more), str(out), mode="overwrite")
    assert [p.name for p in out.glob("*.npz")] == ["study 9.npz"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    good = {f"c{i}": {"x": np.arange(12.0).reshape(6, 2)} for i in range(6)}
    arrays.write_containers(rows_of(spark, {"kept": {"x": np.arange(4.0)}}), str(out))
    before = {p.name: p.read_bytes() for p in out.iterdir() if not p.name.startswith(".")}
    bad = rows_of(spark, good).withColumn("samples", F.when((F.col("container") == "c3") & (F.col("row") == 4), F.array(F.lit(1.0))).otherwise(F.col("samples")))
    with pytest.raises(Exception, match="1 values in row 4|2 values"):
        arrays.write_containers(bad, str(out), mode="overwrite")
    with pytest.raises(Exception, match="lacks row"):
        arrays.write_containers(rows_of(spark, good).where("row <> 2"), str(out))
    assert {p.name: p.read_bytes() for p in out.iterdir() if not p.name.startswith(".")} == before


def test_arrays_that_cannot_be_read_are_errors(spark, tmp_path):
    stored(tmp_path / "a" / "x.npz", x=np.asfortranarray(np.ones((4, 3))))
    with pytest.raises(Exception, match="column order"):
        arrays.read_containers(spark, str(tmp_path / "a")).count()
    stored(tmp_path / "b" / "x.npz", x=np.array([{}], dtype=object))
    with pytest.raises(Exception, match="objects"):
        arrays.read_containers(spark, str(tmp_path / "b")).count()
    with pytest.raises(Exception, match="nowhere"):
        arrays.read_containers(spark, str(tmp_path / "nowhere")).count()
