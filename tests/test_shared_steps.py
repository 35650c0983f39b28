"""What many queries share reads its input once and moves no more rows than it has to."""

import random

from roadloom.operators import components, dedup, ranking, spatial, temporal
from roadloom.plans import corpus, roads


def test_detections_are_read_once(spark, tmp_path):
    rows = [(1, t, "D00", t * 3 + k, 0.0, 0.0, 10.0, 5.0 + k, 0.5, 1920, 1080) for t in range(20) for k in range(3)]
    names = "survey_id bigint, track_id bigint, class_name string, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, confidence double, frame_w int, frame_h int"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "seen"))
    gps = spark.createDataFrame([(1, s, float(s), 13.0 + s * 8e-5, 80.0, 1.0) for s in range(30)], "survey_id bigint, seq bigint, timestamp_s double, lat double, lon double, accuracy_m double")
    found = dedup.locate(spark.read.parquet(str(tmp_path / "seen")), gps)
    assert found.count() == 20
    assert found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan parquet") <= 1


def test_edges_alone_are_settled_without_landing_candidates(spark, monkeypatch):
    names = "survey_id bigint, seq bigint, p_lat double, p_lon double, n_lat double, n_lon double, from_m double, step_m double"
    edges = spark.createDataFrame([(1, n, 13.0 + n * 8e-5, 80.0, 13.0 + (n + 1) * 8e-5, 80.0, n * 8.9, 8.9) for n in range(200)], names)
    rng = random.Random(7)
    places = [(1, 13.0 + rng.random() * 200 * 8e-5, 80.0 + rng.random() * 1e-5) for _ in range(50)]
    landed = []
    monkeypatch.setattr(spatial, "cut", lambda df: landed.append(df) or df)
    got = spatial._nearest_edges(spark.createDataFrame(places, "survey_id bigint, lat double, lon double"), edges, 5.0, False).collect()
    assert not landed
    assert {(r.lat, r.b.seq) for r in got} == {(lat, int((lat - 13.0) / 8e-5)) for _, lat, _ in places}


def test_cells_meet_in_a_coarse_grid(spark, monkeypatch):
    """A point far from all others meets a few coarse cells, not every fine one around it."""
    asked = []
    cover = components.cells.cover_box
    monkeypatch.setattr(components.cells, "cover_box", lambda *a: asked.append(a[-1] / a[-2]) or cover(*a))
    df = spark.createDataFrame([(1, n, 13.0 + n * 1e-2, 80.0) for n in range(5)], "survey_id bigint, track_id bigint, lat double, lon double")
    got = components.clusters(df, 5.0, ["survey_id"], "track_id").collect()
    assert {r.track_id: r.component for r in got} == {n: n for n in range(5)}
    assert asked and min(asked) >= 4


def test_counting_segments_rates_none(spark, monkeypatch):
    def never(*_):
        raise AssertionError("ratings are not asked for")

    monkeypatch.setattr(roads, "segment_table", never)
    folder = "/root/testdata/sf0.001"
    counts = {r.survey_id: r.n_segments for r in roads.a05(spark, folder).collect()}
    assert counts == {r.survey_id: r.n_segments for r in roads.q01(spark, folder).collect()}
    assert roads.f20(spark, folder).count() == 2 * len(counts)


def test_images_are_aggregated_once(spark):
    folder = "/root/testdata/sf0.001"
    found = corpus.images(spark, folder)
    assert "Aggregate" not in found._jdf.queryExecution().toString()
    assert found.count() == corpus.label_rows(spark, folder).select("image").distinct().count()


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line and "Reused" not in line]


def test_ranked_rows_are_dealt_once(spark):
    """Rows sorted and numbered in their range need no second shuffle for their rank."""
    df = spark.range(1000).selectExpr("id % 3 AS k", "id * 7 % 1009 AS id")
    got = ranking.blocked_rank(df, ["k"], "id", "rk")
    assert not exchanges(got)
    rows = sorted((r.k, r.id, r.rk) for r in got.collect())
    assert [rk for _, _, rk in rows] == [n for k in range(3) for n in range(1, 1 + len([r for r in rows if r[0] == k]))]


def test_very_many_blocks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW_BLOCKS", 2)
    got = ranking.blocked_rank(spark.range(100).selectExpr("id DIV 10 AS k", "-id AS id"), ["k"], "id", "rk")
    assert {(r.k, r.id): r.rk for r in got.collect()} == {(n // 10, -n): 10 - n % 10 for n in range(100)}


def test_chainage_deals_a_trace_once(spark):
    points = [(s, n, float(n), 13.0 + n * 1e-5, 80.0) for s in range(2) for n in range(500)]
    gps = spark.createDataFrame(points, ", ".join(f"{c} {t}" for c, t in zip(temporal.TRACE, ("bigint", "bigint", "double", "double", "double"))))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chain = temporal.chainage(gps, block_rows=100)
        # the windows, the last row and the sum of each block, each once for the sums and once for the rows
        dealt = len(exchanges(chain))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows = {(r.survey_id, r.seq): r.cum_m for r in chain.collect()}
    assert dealt <= 6 and abs(rows[(1, 499)] - 499 * 1.11195) < 0.1


def test_distinct_edges_are_not_landed_again(spark, monkeypatch):
    """A trace without equal edges goes to the nearest-edge search as it is; equal ones are made one."""
    names = "survey_id bigint, seq bigint, p_lat double, p_lon double, lat double, lon double, cum_m double, step_m double"
    apart = [(1, n, 13.0 + n * 8e-5, 80.0, 13.0 + (n + 1) * 8e-5, 80.0, (n + 1) * 8.9, 8.9) for n in range(50)]
    points = spark.createDataFrame([(1, 7, 13.0 + 10.5 * 8e-5, 80.0)], "survey_id bigint, defect_id bigint, lat double, lon double")
    landed = []
    monkeypatch.setattr(spatial, "cut", lambda df: landed.append(df.columns) or df)
    found = spatial.snap_to_trace(points, spark.createDataFrame(apart, names), ["defect_id"]).collect()
    assert abs(found[0].chain_m - 10.5 * 8.9) < 0.01 and not any("from_m" in c for c in landed)
    again = [(1, 50 + n, *row[2:6], 445 + row[6], row[7]) for n, row in enumerate(apart)]
    found = spatial.snap_to_trace(points, spark.createDataFrame(apart + again, names), ["defect_id"]).collect()
    assert abs(found[0].chain_m - 10.5 * 8.9) < 0.01 and any("from_m" in c for c in landed)
