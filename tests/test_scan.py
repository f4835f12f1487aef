"""Properties of the scan: islands, windows, permutations, Moran's I, inference, Holm."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest

from tremorlake.operators import inference, spatial, temporal
from tremorlake.plans import time_space, waveforms

SECOND = 1_000_000


def events(spark, data):
    return spark.createDataFrame(data, "event_id long, node long, start_us long, peak_us long, end_us long, activity double")


def test_islands_merge_within_a_node_and_keep_the_strongest(spark):
    s = SECOND
    e = events(spark, [(1, 0, 0, s, 2 * s, 1.0), (2, 0, s, 2 * s, 3 * s, 50.0), (3, 0, 5 * s // 2, 3 * s, 4 * s, 2.0), (4, 0, 6 * s, 13 * s // 2, 7 * s, 1.0), (5, 1, 0, s, 2 * s, 1.0)])
    merged, members = temporal.merge_overlapping(e)
    assert merged.count() == 3 and members.count() == 5
    big = merged.where("source_records = 3").first()
    assert (big["peak_us"], big["end_us"], big["representative_activity"]) == (2 * s, 4 * s, 50.0)


def test_touching_intervals_are_one_only_when_asked(spark):
    e = events(spark, [(1, 0, 0, 1, 2, 1.0), (2, 0, 2, 3, 4, 1.0)])
    for touching, n in ((True, 1), (False, 2)):
        assert temporal.islands(e, ["node"], "start_us", "end_us", ["event_id"], touching).select("island").distinct().count() == n


def test_windows_are_half_open_but_for_the_end(spark):
    end = 127 * SECOND
    w = temporal.candidate_windows(spark, 0, end, [60 * SECOND], 60 * SECOND)
    e = spark.createDataFrame([(0, t * SECOND) for t in (0, 60, 120, 127)], "node long, peak_us long")
    got = {r["window_id"]: r["n"] for r in temporal.window_counts(e, w, end, 60 * SECOND).collect()}
    assert [got[i] for i in range(3)] == [1, 1, 2]


def test_windows_longer_than_the_span_are_refused(spark):
    with pytest.raises(ValueError):
        temporal.candidate_windows(spark, 0, 10, [20], 5)


def test_permutations_keep_groups_and_totals():
    pools = [[0, 2, 4], [1], [3, 5]]
    p = inference.seeded_permutations(pools, 6, 30, 1)
    assert (p[0] == np.arange(6)).all()
    for row in p:
        for pool in pools:
            assert sorted(row[pool]) == sorted(pool)


def direct(x, edges):
    c = x - x.mean()
    return len(x) / len(edges) * sum(c[i] * c[j] for i, j in edges) / (c @ c)


def test_scores_equal_direct_moran_over_all_permutations(spark):
    x = np.array([[1, 0, 4, 2], [0, 3, 3, 1], [5, 0, 0, 1]])
    edges = np.array([(0, 1), (1, 2), (2, 3)])
    perms = np.array(list(itertools.permutations(range(4))))
    counts = spark.createDataFrame([(w, n, int(x[w, n])) for w in range(3) for n in range(4) if x[w, n]], "window_id long, node long, n long")
    got = {r["window_id"]: r["scores"] for r in inference.permutation_scores(counts, range(4), edges, perms).collect()}
    for w in range(3):
        assert np.allclose(got[w], [direct(x[w][p], edges) for p in perms], atol=1e-12)
    edge_frame = spark.createDataFrame(edges.tolist(), "node_i long, node_j long")
    plain = {r["window_id"]: r["moran_i"] for r in spatial.moran(counts, edge_frame, 4).collect()}
    for w in range(3):
        assert abs(plain[w] - direct(x[w], edges)) < 1e-12


def scan(spark, matrix):
    m = np.asarray(matrix, float)
    rows = [(w, p, float(m[p, w])) for p in range(m.shape[0]) for w in range(m.shape[1])]
    return {r["window_id"]: r for r in inference.max_scan(spark.createDataFrame(rows, "window_id long, perm_id long, score double")).collect()}


def test_a_constant_window_is_never_significant(spark):
    got = scan(spark, [[5, 1, 2], [1, 2, 2], [2, 3, 2], [0, 4, 2], [1, 0, 2]])
    assert got[0]["p_global"] == pytest.approx(0.2)
    assert not got[2]["informative"] and got[2]["p_window"] == 1


def test_all_constant_gives_one(spark):
    got = scan(spark, [[1, 1]] * 4)
    assert all(r["p_global"] == 1 and r["p_window"] == 1 for r in got.values())


def test_size_over_the_whole_orbit(spark):
    base = np.array([3.0, 1.0, 0.0, 2.0, 7.0, 4.0, 5.0, 6.0] * 3)[:20]
    significant = sum(scan(spark, np.roll(base, -k)[:, None])[0]["p_global"] <= 0.05 for k in range(0, 20, 4))
    assert significant <= 1


def test_a_planted_patch_is_found(spark):
    rng = np.random.default_rng(5)
    x = rng.poisson(3, (3, 30))
    x[1, 10:16] = 12
    edges = np.array([(i, i + 1) for i in range(29)])
    counts = spark.createDataFrame([(w, n, int(x[w, n])) for w in range(3) for n in range(30)], "window_id long, node long, n long")
    got = {r["window_id"]: r for r in inference.scan(spark, counts, range(30), edges, [range(30)], 199, 3).collect()}
    assert got[1]["p_global"] <= 0.05
    assert max(got, key=lambda w: got[w]["scan_z"]) == 1


def test_holm_on_three_tests(spark):
    p = [0.028994201159768, 0.002599480103979, 0.006398720255949]
    got = {r["test"]: r["p_adjusted"] for r in inference.holm(spark.createDataFrame(list(enumerate(p)), "test long, p double")).collect()}
    assert got == pytest.approx({0: p[0], 1: 3 * p[1], 2: 2 * p[2]})


def test_regions(spark):
    rows = [(2.0, 0.0, 98.0), (2.0, 0.0, 80.0), (20.0, 0.0, 80.0), (50.0, 120.0, 0.0), (80.0, 150.0, 0.0), (50.0, 60.0, 0.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "d double, x double, z double").select(spatial.region_label("d", "x", "z")).collect()]
    assert got == ["surface_2cm_top", "surface_2cm_slope", "platform_20cm", "near_face_50cm", "near_face_80cm", "excluded_interior"]


def test_targets_beyond_the_cable_ask_for_no_channel(spark):
    rows = [(498, "ring", 2.0, "target"), (510, "ring", 2.0, "target"), (505, "ring", 2.0, "target"), (700, "ring", 2.0, "control")]
    layout = spark.createDataFrame(rows, "data_channel long, geometry_type string, burial_depth_cm double, analysis_role string")
    got = {r[0] for r in spatial.required_channels(layout, 4, 500).collect()}
    assert got == {*range(494, 501), 700}


def test_required_channels_of_a_whole_long_cable(spark, tmp_path):
    spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-03 00:00:00' AS ts, id * 8 AS user_id, 'view' AS event_type, 1.0D AS value FROM range(120)").write.parquet(str(tmp_path / "events.parquet"))
    got = {r[0] for r in waveforms.QUERIES["required_channels"](spark, str(tmp_path)).collect()}
    controls = {n for n in range(0, 953, 8) if n % 9 == 0}
    targets = {n for n in range(0, 953, 8) if n % 9}
    assert got == controls | {c for n in targets for c in range(max(0, n - 4), min(n + 4, 952) + 1)}


def test_components_of_the_whole_radius_graph(spark, tmp_path):
    """Nodes 0 to 6 in a row, 40 alone, 94 and 95 together: every fifth one keeps its links."""
    ids = ", ".join(f"({i}L)" for i in [*range(7), 40, 94, 95])
    spark.sql(f"SELECT n AS event_id, timestamp_ntz'2024-01-03 00:00:00' AS ts, n AS user_id, 'view' AS event_type, 1.0D AS value FROM VALUES {ids} AS t(n)").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in time_space.QUERIES["graph_components"](spark, str(tmp_path)).collect()}
    assert got == {(0, 7), (40, 1), (94, 2)}


def scattered(spark, path):
    """Events of 60 nodes at hashed minutes, and a burst of a patch of nine on the fifth day."""
    spark.sql("""SELECT row_number() OVER (ORDER BY ts, user_id) AS event_id, ts, user_id, 'view' AS event_type, 0.1D AS value FROM (
        SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(pmod(xxhash64(id), 42000) AS INT)) AS ts, id % 60 AS user_id FROM range(1500)
        UNION ALL SELECT timestamp_ntz'2024-01-05 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)), id % 3 + 10 * (id div 3 % 3) FROM range(300))""").write.parquet(f"{path}/events.parquet")


def test_full_scans_draw_as_many_permutations_as_a_study(spark, tmp_path):
    scattered(spark, tmp_path)
    got = time_space.QUERIES["full_permutation_scan"](spark, str(tmp_path)).collect()
    p = np.array([r["p_window"] for r in got])
    assert len(got) and np.allclose(p * 5001, np.round(p * 5001), atol=0.01) and p.min() < 1 / 20
    assert time_space.full_scan_episodes(spark, str(tmp_path)).columns == time_space.QUERIES["scan_episodes"](spark, str(tmp_path)).columns


def test_null_statistics_equal_the_long_form(spark):
    rng = np.random.default_rng(3)
    scores = spark.createDataFrame([(w, rng.normal(size=50).tolist()) for w in range(4)], "window_id long, scores array<double>")
    a = sorted(tuple(r) for r in inference.null_statistics(scores).collect())
    b = sorted(tuple(r) for r in inference.null_summary(inference.long_scores(scores)).collect())
    assert np.allclose(a, b)


@pytest.mark.parametrize("kind", ["linear", "higher"])
def test_quantiles_by_brackets_are_exact(spark, kind):
    from tremorlake.operators.robust import exact_quantile

    rng = np.random.default_rng(8)
    groups = {"large": rng.normal(size=30_000), "ties": np.repeat([1.0, 2.0, 7.0], [9000, 500, 9000]), "skew": np.exp(rng.normal(size=9000) * 9), "one": np.array([3.0]), "two": np.array([3.0, 8.0]), "few": rng.normal(size=7)}
    rows = pd.DataFrame([(g, v) for g, values in groups.items() for v in rng.permutation(values)], columns=["g", "v"])
    df = spark.createDataFrame(rows).unionByName(spark.createDataFrame([("few", None), ("none", None), ("few", float("nan"))], "g string, v double")).repartition(6)
    for q in (0.0, 0.3, 0.5, 0.995, 1.0):
        got = {r["g"]: r["x"] for r in exact_quantile(df, ["g"], "v", q, "x", kind).collect()}
        want = {g: float(np.quantile(v, q, method=kind)) for g, v in groups.items()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want), q
    whole = np.concatenate(list(groups.values()))
    assert exact_quantile(df, [], "v", 0.5, "x", kind).first()[0] == pytest.approx(np.quantile(whole, 0.5, method=kind))
    assert exact_quantile(df.limit(0), ["g"], "v", 0.5, "x", kind).count() == 0


def test_numbers_by_ranges(spark):
    from tremorlake.operators.temporal import numbered

    df = spark.range(5000).selectExpr("id", "pmod(xxhash64(id), 700) AS t").repartition(7)
    got = numbered(df, ["t", "id"], "i").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(5000)) and [(r["t"], r["id"]) for r in got] == sorted((r["t"], r["id"]) for r in got)
    assert numbered(df.limit(0), ["t"], "i").count() == 0


def test_files_are_located_as_the_last_that_starts_before(spark):
    from tremorlake.sources import tables

    rng = np.random.default_rng(3)
    starts = sorted(int(v) for v in rng.integers(0, 50_000, 60)) + [10, 10]
    files = spark.createDataFrame([(s * 10**9, f"f{i:02d}") for i, s in enumerate(starts)], "start_ns long, file_name string")
    times = [int(v) for v in rng.integers(-500, 52_000, 800) * 10**9] + [s * 10**9 for s in starts]
    got = {(r["time_ns"], r["file_name"]) for r in tables.locate(spark.createDataFrame([(t,) for t in times], "time_ns long"), files, limit_s=600.05).collect()}
    want = set()
    for t in times:
        best = max(((s * 10**9, f"f{i:02d}") for i, s in enumerate(starts) if s * 10**9 <= t), default=None)
        want.add((t, best[1] if best and t - best[0] < 600.05e9 else None))
    assert got == want


def test_neighbours_in_blocks_equal_all_distances(spark, monkeypatch):
    from tremorlake.operators import neighbours, screening

    monkeypatch.setattr(neighbours, "BLOCK", 30)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).round(1).tolist(), "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "key long, vector array<double>, label string")
    x = np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {r["key"]: r["distances"] for r in screening.knn(df, df, 5).collect()}
    np.fill_diagonal(d, np.inf)
    assert all(np.allclose(got[i], np.sort(d[i])[:5]) for i in range(100))
    each = {(r["key"], r["label"]): r["distances"] for r in screening.knn(df, df, 4, per_label=True).collect()}
    assert len(each) == 200 and all(np.allclose(each[i, c], np.sort(d[i][[j for j in range(100) if "ab"[j % 2] == c]])[:4]) for i in range(100) for c in "ab")
    assert screening.knn(df, df.limit(0), 5).count() == 0


def test_greedy_split_of_a_long_component(spark):
    from tremorlake.operators import merge

    rng = np.random.default_rng(6)
    rules = merge.MergeRules(span=50, channel_span=4)
    rows, t = [], 0
    for i in range(400):
        t += int(rng.choice([0, 3, 10, 200]))
        rows.append((i, i % 3, t, t - int(rng.integers(0, 9)), t + int(rng.integers(0, 30)), int(rng.integers(0, 7))))
    got = merge.greedy_split(spark.createDataFrame(rows, "key long, component long, peak_us long, start_us long, end_us long, channel long"), rules).collect()
    want, part = {}, 0
    for c in range(3):
        box = None
        for k, _, _, s, e, ch in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0])):
            new = (min(box[0], s), max(box[1], e), min(box[2], ch), max(box[3], ch)) if box else (s, e, ch, ch)
            if box is None or new[1] - new[0] > 50 or new[3] - new[2] > 4:
                part, new = part + 1, (s, e, ch, ch)
            box = new
            want[k] = part
    parts = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert parts({r["key"]: (r["component"], r["part"]) for r in got}) == parts(want)


def test_large_groups_give_the_same_scales(spark, monkeypatch):
    from tremorlake.operators import robust

    df = spark.range(6000).selectExpr("id % 3 AS g", "CAST(pmod(xxhash64(id), 997) AS DOUBLE) / 7 AS v")
    def all_of():
        scale = sorted(tuple(r) for r in robust.robust_scale(df, ["g"], "v").collect())
        z = sorted(tuple(r) for r in robust.robust_z(df, ["g"], "v", "z").collect())
        high = sorted(tuple(r) for r in robust.quantile_higher(df, ["g"], "v", 0.95, "h").collect())
        filled = robust.impute_median(df.selectExpr("IF(v < 1, NULL, v) AS v"), ["v"]).selectExpr("sum(v)").first()[0]
        return [*scale, *z, *high, (filled,)]

    want = all_of()
    monkeypatch.setattr(robust, "LARGE", 100)
    assert np.allclose(np.concatenate([np.array(r, float) for r in all_of()]), np.concatenate([np.array(r, float) for r in want]))
