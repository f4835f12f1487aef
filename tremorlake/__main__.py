"""python -m tremorlake COMMAND: whole studies over Parquet tables, and any query by its name."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from tremorlake.checks import DataError
from tremorlake.plans import catalogue, detection, reproduce, study
from tremorlake.schemas import LAYOUT
from tremorlake.session import get_spark
from tremorlake.sources import cache, sheets, sinks, tables
from tremorlake.spec import ExperimentSpec, ScanSettings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tremorlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("scan", help="spatial organisation of each study, corrected over all of them")
    c.add_argument("--study", nargs=5, action="append", required=True, metavar=("NAME", "EVENTS", "NODES", "START_US", "END_US"))
    c.add_argument("--simulations", type=int, default=5000)
    c.add_argument("--output", required=True)
    c = sub.add_parser("activity", help="gauge metrics of events from waveform blocks")
    for name in ("--blocks", "--events", "--layout", "--output"):
        c.add_argument(name, required=True)
    c.add_argument("--fs", type=float, default=5000.0)
    c.add_argument("--event-policy", default="auto_effective_plus_uncertain", choices=("auto_effective", "auto_effective_plus_uncertain", "manual_effective", "include_flag", "all"))
    c.add_argument("--cutoff-us", type=int, help="events that peak at or behind it are left out")
    c.add_argument("--start-us", type=int, help="with --cutoff-us: also minutes, snapshots and positions")
    c.add_argument("--snapshot-minutes", type=int, default=1)
    c.add_argument("--input-unit", default="microstrain_per_second", help="a label")
    c.add_argument("--max-events", type=int, help="for trials only")
    c = sub.add_parser("screen", help="votes of candidates against noise references")
    c.add_argument("--tasks", required=True)
    c.add_argument("--features", required=True, help="comma-separated columns")
    c.add_argument("--refine", help="comma-separated columns of the groups that raw features are standardised by")
    c.add_argument("--output", required=True)
    c = sub.add_parser("quality", help="channel quality control")
    for name in ("--samples", "--layout", "--output"):
        c.add_argument(name, required=True)
    c = sub.add_parser("catalog", help="from waveform blocks to a screened catalog; stages are kept, changed files detected again")
    for name, told in (("--blocks", "Parquet of waveform blocks"), ("--records", "file_name, start_us, end_us"), ("--layout", "sensors"), ("--nuisance", "kind, start_us, end_us"), ("--output", None)):
        c.add_argument(name, required=True, help=told)
    c = sub.add_parser("inspect", help="tables below a folder with their columns, or a waveform file's datasets")
    c.add_argument("path")
    c = sub.add_parser("frames", help="what figures of a saved scan show")
    c.add_argument("scan", help="a study's folder below the output of scan")
    c.add_argument("--output", required=True)
    c = sub.add_parser("reproduce", help="recompute deposited results and report what differs")
    c.add_argument("folder")
    c = sub.add_parser("checksums", help="files against a list of their SHA-256")
    c.add_argument("folder")
    c.add_argument("list")
    c = sub.add_parser("template", help="an empty CSV with a table's columns")
    c.add_argument("schema")
    c.add_argument("output")
    c = sub.add_parser("query", help="a query of the catalogue over a folder of tables")
    c.add_argument("name", choices=sorted(catalogue.queries()))
    c.add_argument("folder")
    c.add_argument("--output")
    return p


def inspect(spark, path: str) -> dict:
    """Columns of the tables below a folder, or of a waveform file the datasets of two dimensions."""
    if path.endswith((".h5", ".hdf5")):
        import h5py

        shapes: dict[str, tuple[tuple[int, ...], str]] = {}
        with h5py.File(path, "r") as handle:
            handle.visititems(lambda name, x: shapes.update({name: (x.shape, x.dtype.kind)}) if hasattr(x, "shape") else None)
        return {"datasets": {n: list(s) for n, (s, k) in shapes.items() if len(s) == 2 and k in "iuf"}}
    return {"tables": {p: sorted(c) for p, c in reproduce.listing(spark, path)}}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_spark()
    read = spark.read.parquet
    layout = lambda path: sheets.read_layout(spark, path, f"channel int, qc_group string, {LAYOUT}")
    if a.command == "scan":
        asked = {}
        for name, events, nodes, start, end in a.study:
            tables.require_files(spark, events=events, nodes=nodes)
            asked[name] = ExperimentSpec(name, int(start), int(end), ScanSettings(simulations=a.simulations, family=len(a.study))), read(events), read(nodes)
        found = study.run_scans(asked)
        for name in found:
            for part in ("merged", "membership", "windows", "edges", "pools"):
                getattr(found[name], part).write.mode("overwrite").parquet(f"{a.output}/{name}/{part}")
        adjusted, episodes = study.correct_studies(found, ScanSettings().alpha)
        adjusted.write.mode("overwrite").parquet(f"{a.output}/studies")
        for name, e in episodes.items():
            e.write.mode("overwrite").parquet(f"{a.output}/{name}/episodes")
        sinks.write_text(spark, f"{a.output}/report.md", sinks.markdown(adjusted, "Studies"))
        sinks.write_manifest(spark, f"{a.output}/manifest.json", {"simulations": a.simulations, "studies": [s[0] for s in a.study]})
    elif a.command == "activity":
        events = read(a.events)
        if a.event_policy != "all":
            events = study.select_events(events, a.event_policy, a.cutoff_us, a.max_events)
        metrics = study.run_activity(read(a.blocks), events, layout(a.layout), a.fs)
        metrics.write.mode("overwrite").parquet(f"{a.output}/events")
        if a.start_us is not None and a.cutoff_us is not None:
            full = events.join(read(f"{a.output}/events").select("event_id", F.col("integral_median").alias("activity")), "event_id").withColumn("position", F.col("channel"))
            told = study.accumulate(full, layout(a.layout).select(F.col("channel").alias("position")), a.start_us, a.cutoff_us, a.snapshot_minutes, a.input_unit)
            for part in ("minutes", "snapshots", "positions"):
                getattr(told, part).write.mode("overwrite").parquet(f"{a.output}/{part}")
    elif a.command == "screen":
        names = a.features.split(",")
        votes = study.run_refinement(read(a.tasks), names, a.refine.split(",")) if a.refine else study.run_screening(read(a.tasks), names)
        votes.write.mode("overwrite").parquet(a.output)
    elif a.command == "catalog":
        blocks, sensors = read(a.blocks), layout(a.layout)
        if dict(sensors.dtypes).get("channel") != "bigint":
            sensors = sensors.withColumn("channel", F.coalesce(*[F.col(x).cast("long") for x in ("channel", "data_channel") if x in sensors.columns]))
        given = detection.Inputs(blocks, read(a.records), sensors, read(a.nuisance))
        catalog, made, log = detection.run_catalog(spark, given, detection.stored_units(blocks), a.output)
        sinks.write_text(spark, f"{a.output}/stages.jsonl", log.text())
        print(json.dumps({"events": catalog.count(), "files_detected": made.count()}))
    elif a.command == "inspect":
        print(json.dumps(inspect(spark, a.path), indent=1))
    elif a.command == "frames":
        windows = read(f"{a.scan}/windows")
        critical = windows.agg(F.max("critical")).first()[0]
        for name, df in study.frames(windows, critical).items():
            df.write.mode("overwrite").parquet(f"{a.output}/{name}")
    elif a.command == "reproduce":
        found = reproduce.report(spark, a.folder).collect()  # a row a check
        print(json.dumps([r.asDict() for r in found], indent=1))
        return int(not found or any(r["violations"] for r in found))
    elif a.command == "checksums":
        verdicts = cache.check_digests(spark, a.folder, cache.read_checksums(spark, a.list))
        counts = {r["verdict"]: r["count"] for r in verdicts.groupBy("verdict").count().collect()}
        print(json.dumps(counts))
        return int(set(counts) != {"ok"})
    elif a.command == "quality":
        for name, df in zip(("channels", "summary", "files"), study.run_quality(read(a.samples), layout(a.layout)), strict=True):
            df.write.mode("overwrite").parquet(f"{a.output}/{name}")
    elif a.command == "template":
        from tremorlake import schemas

        text = getattr(schemas, a.schema.upper(), None)
        if text is None:
            raise DataError(f"no schema {a.schema}")
        sinks.write_template(spark, a.output, text)
    else:
        out = catalogue.queries()[a.name](spark, a.folder)
        if a.output:
            out.write.mode("overwrite").parquet(a.output)
        else:
            print(json.dumps([r.asDict() for r in out.limit(20).collect()], default=str, indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
