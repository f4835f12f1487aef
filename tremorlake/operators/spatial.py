"""Sensors and their graph: nodes, gauge profiles, radius edges, components, Moran's I, exchangeable pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.operators.graph import components


def isclose(a: Column, b: float) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * abs(b)


def region_label(depth: str, x: str, z: str) -> Column:
    """Which part of the slope a sensor lies in."""
    d, x, z = F.col(depth), F.col(x), F.col(z)
    return (
        F.when(isclose(d, 2) & isclose(z, 98), "surface_2cm_top")
        .when(isclose(d, 2), "surface_2cm_slope")
        .when(isclose(d, 20), "platform_20cm")
        .when(isclose(d, 50) & isclose(x, 120), "near_face_50cm")
        .when(isclose(d, 80) & isclose(x, 150), "near_face_80cm")
        .otherwise("excluded_interior")
    )


def number(value: Column) -> Column:
    """A number without a trailing .0"""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def target_sensors(layout: DataFrame, depths: tuple[float, ...] = (2, 20, 50, 80)) -> DataFrame:
    """Ring and line sensors that aren't controls, at the depths that are scanned; one row a channel."""
    role = F.lower(F.coalesce("analysis_role", F.lit("")))
    keep = F.lower("geometry_type").isin("ring", "line") & ~role.contains("control") & F.col("burial_depth_cm").isin(*[float(d) for d in depths])
    return layout.where(keep).dropDuplicates(["data_channel"])


def control_channels(layout: DataFrame) -> DataFrame:
    return layout.where(F.lower("analysis_role").contains("control")).select("data_channel").distinct()


def required_channels(layout: DataFrame, half: int, channels: int) -> DataFrame:
    """Controls and all channels within half of a target, within the cable."""
    span = target_sensors(layout).select(F.greatest(F.col("data_channel") - half, F.lit(0)).alias("low"), F.least(F.col("data_channel") + half, F.lit(channels)).alias("high"))
    # sequence() runs downwards where a target lies beyond the cable; such a one asks for nothing
    around = span.where("low <= high").select(F.explode(F.sequence("low", "high")).alias("data_channel"))
    return control_channels(layout).unionByName(around).distinct()


def gauge_channels(centers: DataFrame, listed: DataFrame, half: int, center: str = "channel") -> DataFrame:
    """Listed channels within half of each centre: an equi-join on the 2 half + 1 offsets, not a range."""
    around = centers.withColumn("gauge_channel", F.explode(F.sequence(F.col(center) - half, F.col(center) + half)))
    return around.join(listed.select(F.col("channel").alias("gauge_channel")).distinct(), "gauge_channel")


def node_table(layout: DataFrame, half: int) -> DataFrame:
    """One node for each distinct place: its channels, segments, geometry, gauge profile and pool."""
    at = ["burial_depth_cm", "x_cm", "y_cm", "z_cm"]
    gauges = gauge_channels(layout.select(*at, "channel"), layout, half)
    sizes = gauges.groupBy(*at, "channel").agg(F.count("*").alias("g"), F.collect_set("gauge_channel").alias("support"))
    profile = sizes.groupBy(*at, "g").agg(F.count("*").alias("m")).groupBy(*at).agg(F.concat_ws(";", F.transform(F.sort_array(F.collect_list(F.struct("g", "m"))), lambda s: F.concat_ws(":", s["g"], s["m"]))).alias("gauge_opportunity_profile"))
    support = sizes.groupBy(*at).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("support")))).alias("gauge_support_channels"))
    own = layout.groupBy(*at).agg(
        F.sort_array(F.collect_set("channel")).alias("raw_channels"),
        F.sort_array(F.collect_set("segment_id")).alias("segment_ids"),
        F.when(F.bool_or(F.col("geometry_type") == "ring"), "ring").otherwise("line").alias("geometry_type"),
    )
    d = F.col("burial_depth_cm")
    stratum = F.when(isclose(d, 2), F.when(isclose(F.col("z_cm"), 98), "surface_2cm_top").otherwise("surface_2cm_slope")).otherwise(F.concat(F.lit("horizontal_"), number(d), F.lit("cm")))
    full = own.join(profile, at).join(support, at).withColumns({"stratum": stratum, "region": region_label("burial_depth_cm", "x_cm", "z_cm")})
    return full.withColumn("permutation_group", F.concat_ws("|", "stratum", "geometry_type", "gauge_opportunity_profile"))


def radius_graph(nodes: DataFrame, radius: float, key: str = "node") -> DataFrame:
    """node_i < node_j, distance_cm within the radius: an equi-join of neighbouring cells of that width."""
    cell = [F.floor(F.col(c) / radius).cast("long") for c in ("x_cm", "y_cm", "z_cm")]
    at = F.struct("x_cm", "y_cm", "z_cm")
    left = nodes.select(F.col(key).alias("node_i"), at.alias("p"), *[c.alias(n) for c, n in zip(cell, "abc", strict=True)])
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, j, k), "abc", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    near = left.withColumn("s", F.explode(steps)).select("node_i", "p", *[(F.col(n) + F.col(f"s.{n}")).alias(n) for n in "abc"])
    right = nodes.select(F.col(key).alias("node_j"), at.alias("q"), *[c.alias(n) for c, n in zip(cell, "abc", strict=True)])
    d = F.sqrt(sum(((F.col(f"p.{c}") - F.col(f"q.{c}")) ** 2 for c in ("x_cm", "y_cm", "z_cm")), F.lit(0.0)))
    return near.join(right, list("abc")).where("node_i < node_j").select("node_i", "node_j", d.alias("distance_cm")).where((F.col("distance_cm") > 1e-10) & (F.col("distance_cm") <= radius + 1e-9))


def shared_support(edges: DataFrame, nodes: DataFrame, key: str = "node") -> DataFrame:
    """How many gauge channels both ends of an edge lean on."""
    i = nodes.select(F.col(key).alias("node_i"), F.col("gauge_support_channels").alias("si"))
    j = nodes.select(F.col(key).alias("node_j"), F.col("gauge_support_channels").alias("sj"))
    return edges.join(i, "node_i").join(j, "node_j").withColumn("shared_gauge_channels", F.size(F.array_intersect("si", "sj"))).drop("si", "sj")


def component_sizes(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """component (its smallest node), size; isolated nodes are components of one."""
    found = components(edges.select(F.col("node_i").alias("a"), F.col("node_j").alias("b")))
    full = nodes.select(key).join(found, nodes[key] == found["node_id"], "left")
    return full.groupBy(F.coalesce("component", key).alias("component")).agg(F.count("*").alias("size"))


def moran(counts: DataFrame, edges: DataFrame, node_count: int) -> DataFrame:
    """Moran's I of every window from its sparse counts: n / E * sum_edges c_i c_j / sum c_i^2, c centred.

    With m the mean, sum_edges (v_i - m)(v_j - m) = sum v_i v_j - m sum_nodes degree v + E m^2, so only nodes
    that have records are touched and the window's zeros are never written out."""
    edge_count = edges.count()
    both = edges.select("node_i", "node_j").unionByName(edges.select(F.col("node_j").alias("node_i"), F.col("node_i").alias("node_j")))
    degree = both.groupBy(F.col("node_i").alias("node")).agg(F.count("*").alias("degree"))
    own = counts.join(degree, "node", "left").groupBy("window_id").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("n") * F.coalesce("degree", F.lit(0))).alias("dv"))
    a = counts.select("window_id", F.col("node").alias("node_i"), F.col("n").alias("vi"))
    b = counts.select("window_id", F.col("node").alias("node_j"), F.col("n").alias("vj"))
    cross = a.join(edges.select("node_i", "node_j"), "node_i").join(b, ["window_id", "node_j"]).groupBy("window_id").agg(F.sum(F.col("vi") * F.col("vj")).alias("x"))
    m = F.col("s") / node_count
    top = F.coalesce("x", F.lit(0)) - m * F.col("dv") + edge_count * m * m
    down = F.col("q") - node_count * m * m
    return own.join(cross, "window_id", "left").select("window_id", F.when(node_count * F.col("q") > F.col("s") * F.col("s"), node_count / edge_count * top / down).alias("moran_i"))


def permutation_pools(nodes: DataFrame, events: DataFrame, group: str, key: str = "node") -> DataFrame:
    """Pools of nodes whose histories may be exchanged, with their records."""
    per = events.groupBy(key).agg(F.count("*").alias("records"))
    full = nodes.join(per, key, "left").na.fill({"records": 0})
    return full.groupBy(group).agg(F.count("*").alias("node_count"), (F.count("*") > 1).alias("exchangeable"), F.concat_ws(";", F.sort_array(F.collect_list(key))).alias("nodes"), F.sum("records").alias("records"))
