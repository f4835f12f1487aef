"""Recompute deposited results from the tables beside them: every table is known by its columns, wherever it stands.

A folder may hold, at any depth, minute tables of cumulative activity, and scans: a list of studies, and for each
study in a folder of its name the nodes with the counts of its strongest window, the pools and the episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.operators import inference, spatial, temporal
from tremorlake.sources import tables

# Tolerances of floats, and of sums of products.
RELATIVE, ABSOLUTE, SUMS = 1e-10, 1e-12, 2e-11

CUMULATIVE = {"minute_time", "event_count", "activity_increment", "cumulative_activity", "count_trailing_10min_mean"}
COUNTED_NODES = {"node_index", "x_cm", "y_cm", "z_cm", "permutation_group", "merged_local_event_records"}
POOLS = {"group_id", "permutation_group", "node_count", "exchangeable", "node_indices"}
EPISODES = {"episode_id", "observed_moran_i", "scan_z", "support_union_start", "significant_window_count"}
STUDIES = {"experiment", "edges", "global_p_scan", "global_p_study", "strongest_moran_i", "detected_episode_groups"}


def near(got: Column, want: Column, absolute: float = ABSOLUTE) -> Column:
    return F.abs(got - want) <= absolute + RELATIVE * F.abs(want)


def listing(spark: SparkSession, folder: str) -> list[tuple[str, set[str]]]:
    """Path and columns of every CSV below the folder; a deposit is some dozens of files."""
    found = [r["path"] for r in tables.discover(spark, folder, ".csv").select("path").orderBy("path").collect()]
    return [(p, {c.lstrip("\ufeff") for c in spark.read.csv(p, header=True).columns}) for p in found]


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    df = tables.read_csv(spark, path, schema)
    return df.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in df.columns])


def told(df: DataFrame, name: str, ok: Column) -> DataFrame:
    """check, compared, violations."""
    return df.agg(F.count("*").alias("compared"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations")).select(F.lit(name).alias("check"), "compared", "violations")


def cumulative_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    t = read(spark, path, "minute_time timestamp_ntz, event_count bigint, activity_increment double, cumulative_activity double, count_trailing_10min_mean double")
    t = t.select("minute_time", "event_count", "activity_increment", "cumulative_activity", "count_trailing_10min_mean")
    again = temporal.trailing_mean(temporal.cumulative(t, ["minute_time"], {"total": "activity_increment"}), "minute_time", "event_count", 10, "mean")
    gap = F.timestamp_diff("SECOND", F.lag("minute_time").over(Window.orderBy("minute_time")), F.col("minute_time"))  # a row a minute of one study
    again = again.withColumn("gap", F.coalesce(gap, F.lit(60)))
    ok = near(F.col("total"), F.col("cumulative_activity")) & near(F.col("mean"), F.col("count_trailing_10min_mean")) & (F.col("gap") == 60)
    return told(again, name, ok)


def study_tables(spark: SparkSession, name: str, nodes_path: str, study: DataFrame, pools_path: str | None, radius: float) -> list[DataFrame]:
    """Graph, strongest Moran's I and pools of one study, from its nodes."""
    nodes = read(spark, nodes_path, "node_index bigint, x_cm double, y_cm double, z_cm double, merged_local_event_records bigint")
    nodes = nodes.select(F.col("node_index").alias("node"), "x_cm", "y_cm", "z_cm", "permutation_group", F.col("merged_local_event_records").alias("n"))
    edges = spatial.radius_graph(nodes, radius)
    graph = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("links")), how="left", on=F.lit(True))
    both = study.join(F.broadcast(graph), how="left", on=F.lit(True))  # one row each
    out = [told(both, f"{name} graph", (F.col("selected_nodes") == F.col("nodes")) & (F.col("edges") == F.col("links")))]
    moran = spatial.moran(nodes.where("n > 0").select(F.lit(0).cast("long").alias("window_id"), "node", "n"), edges, nodes.count())
    out.append(told(study.join(F.broadcast(moran), how="left", on=F.lit(True)), f"{name} strongest", near(F.col("moran_i"), F.col("strongest_moran_i"), SUMS)))
    if pools_path:
        listed = read(spark, pools_path, "node_count bigint, exchangeable boolean").select("permutation_group", "node_count", "exchangeable", "node_indices")
        again = nodes.groupBy("permutation_group").agg(F.count("*").alias("size"), F.concat_ws(";", F.sort_array(F.collect_list("node"))).alias("own"))
        both = listed.join(again, "permutation_group", "full_outer")
        same = (F.col("size") == F.col("node_count")) & (F.col("exchangeable") == (F.col("size") > 1)) & (F.col("own") == F.col("node_indices"))
        out.append(told(both, f"{name} pools", same))
    return out


def report(spark: SparkSession, folder: str, radius: float = 35.0, alpha: float = 0.05) -> DataFrame:
    """check, compared, violations of everything that the folder allows to be recomputed."""
    parts: list[DataFrame] = []
    found = listing(spark, folder)
    under = lambda top, columns: [p for p, c in found if columns <= c and p.startswith(top)]
    for p, columns in found:
        label = p.rsplit("/", 2)[-2:]
        if columns >= CUMULATIVE:
            parts.append(cumulative_table(spark, p, f"{label[1]} running totals"))
        if columns >= STUDIES:
            top = p.rsplit("/", 1)[0]
            study = read(spark, p, "selected_nodes bigint, edges bigint, global_p_scan double, global_p_study double, strongest_moran_i double, detected_episode_groups bigint")
            tests = inference.holm(study.select(F.col("experiment").alias("test"), F.col("global_p_scan").alias("p"), "global_p_study"))
            parts.append(told(tests, f"{label[0]} Holm", near(F.col("p_adjusted"), F.col("global_p_study"))))
            for (name,) in study.select("experiment").orderBy("experiment").collect():  # a row a study
                nodes, pools, episodes = (under(f"{top}/{name}/", c) for c in (COUNTED_NODES, POOLS, EPISODES))
                own = study.where(F.col("experiment") == name)
                if nodes:
                    parts += study_tables(spark, f"{label[0]} {name}", nodes[0], own, pools[0] if pools else None, radius)
                if episodes:
                    e = read(spark, episodes[0], "p_scan_study double, significant_window_count bigint, support_union_start timestamp_ntz, support_union_end timestamp_ntz")
                    count = e.agg(F.count("*").alias("k"), F.count_if(F.col("p_scan_study") > alpha).alias("weak"))
                    parts.append(told(own.join(F.broadcast(count), how="left", on=F.lit(True)), f"{label[0]} {name} episodes", (F.col("k") == F.col("detected_episode_groups")) & (F.col("weak") == 0)))
    if not parts:
        return spark.createDataFrame([], "check string, compared long, violations long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
