"""Known small cases: segments, priority, budgets, verification, scores, data sets, files."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from roadloom.config import DEFAULTS
from roadloom.operators import dataset, hashing, imaging, metrics, nearest, priority, segments, selection, verification
from roadloom.sources import intake, readers
from roadloom.sources.store import SurveyStore, export_queue

GPS = "survey_id bigint, seq bigint, timestamp_s double, lat double, lon double"
DEFECT = "survey_id bigint, defect_id bigint, lat double, lon double, x1 double, y1 double, x2 double, y2 double"
M = 1.0 / 111_194.92664455873


def test_route_of_237_metres_has_five_segments(spark):
    gps = spark.createDataFrame([(1, n, float(n), 13.0 + n * M, 80.0) for n in range(238)], GPS)
    d = spark.createDataFrame(
        [(1, 1, 13.0 + 49.9 * M, 80.0, 0.0, 0.0, 100.0, 100.0), (1, 2, 13.0 + 50.1 * M, 80.0, 0.0, 0.0, 10.0, 10.0)], DEFECT
    )
    got = segments.build_segments(gps, d, 100, 100).orderBy("segment_id").collect()
    assert len(got) == 5 and got[4].end_m == pytest.approx(237.0, abs=0.01)
    assert [round(r.damage_index, 4) for r in got] == [1.0, 0.01, 0.0, 0.0, 0.0]
    assert [r.condition for r in got] == ["Poor", "Good", "Good", "Good", "Good"]


def test_gap_gives_no_data(spark):
    gps = spark.createDataFrame([(1, 1, 0.0, 13.0, 80.0), (1, 2, 10.0, 13.0 + 100 * M, 80.0)], GPS)
    none = spark.createDataFrame([], DEFECT)
    got = segments.build_segments(gps, none, 100, 100).collect()
    assert {r.condition for r in got} == {"NoData"} and len(got) in (2, 3)
    still = spark.createDataFrame([(1, 1, 0.0, 13.0, 80.0)], GPS)
    assert segments.build_segments(still, none, 100, 100).count() == 1


def test_priority_facts(spark):
    df = spark.createDataFrame([("High", "primary", True, True), ("Low", "residential", False, False), ("odd", "odd", False, False)], "s string, h string, e boolean, r boolean")
    got = df.select(priority.priority(*[F.col(c) for c in "sher"]).alias("p"), priority.cost(F.col("s")).alias("c")).collect()
    assert [r.p for r in got] == [10.125, 1.0, 1.0] and [r.c for r in got] == [4500.0, 750.0, 750.0]


def test_road_context_defaults_without_roads(spark):
    d = spark.createDataFrame([(1, 1, 13.0, 80.0)], "survey_id bigint, defect_id bigint, lat double, lon double")
    roads, places = readers.osm_cache(spark, "/tmp/no-such-cache.json")
    got = priority.with_exposure(priority.with_road_class(d, roads, ["defect_id"]), places).first()
    assert (got.highway, got.exposed) == ("residential", False)


def test_road_cache_file(spark, tmp_path):
    (tmp_path / "cache.json").write_text(
        '{"highways": [{"tags": {"highway": "primary"}, "geometry": [[13.0, 80.0], [13.001, 80.0]]},'
        ' {"tags": {}, "geometry": [[13.0, 80.001]]}], "amenities": [{"tags": {"amenity": "school"}, "lat": 13.0005, "lon": 80.0002}]}'
    )
    roads, places = readers.osm_cache(spark, str(tmp_path / "cache.json"))
    assert [(r.way_pos, r.vertex_pos, r.highway) for r in roads.orderBy("way_pos", "vertex_pos").collect()] == [(0, 0, "primary"), (0, 1, "primary"), (1, 0, "residential")]
    d = spark.createDataFrame([(1, 1, 13.0001, 80.0), (1, 2, 14.0, 81.0)], "survey_id bigint, defect_id bigint, lat double, lon double")
    got = {r.defect_id: (r.highway, r.exposed) for r in priority.with_exposure(priority.with_road_class(d, roads, ["defect_id"]), places).collect()}
    assert got == {1: ("primary", True), 2: ("residential", False)}


def test_budget_cases(spark):
    ranked = spark.createDataFrame([(1, n, c) for n, c in enumerate([200.0, 300.0, 50.0, 100.0], 1)], "survey_id bigint, queue_rank bigint, estimated_cost double")
    budgets = spark.createDataFrame([(1, n, b) for n, b in enumerate([200.0, 250.0, 0.0, 10000.0])], "survey_id bigint, budget_id int, budget double")
    marked, left = selection.select_within_budget(ranked, budgets)
    picked = {n: [] for n in range(4)}
    for r in marked.filter("selected").orderBy("queue_rank").collect():
        picked[r.budget_id].append(r.queue_rank)
    assert picked == {0: [1], 1: [1, 3], 2: [], 3: [1, 2, 3, 4]}
    assert {r.budget_id: r.remaining for r in left.collect()} == {0: 0.0, 1: 0.0, 2: 0.0, 3: 9350.0}


def test_verification_case(spark):
    schema = "defect_id bigint, class_name string, lat double, lon double, status string"
    old = spark.createDataFrame([(1, "D40", 10.0, 20.0, "Repaired"), (2, "D00", 10.0, 20.0001, "Open"), (3, "D10", 50.0, 60.0, "Open"), (7, "D10", 40.0, 60.0, "Failed")], schema)
    new = spark.createDataFrame([(4, "D40", 10.0, 20.0, "New"), (5, "D00", 10.0, 20.0001, "New"), (6, "D20", 30.0, 40.0, "New")], schema)
    path = spark.createDataFrame([(50.0, 60.00001)], "lat double, lon double")
    got = {(r.side, r.defect_id): (r.status, r.recurrence, r.unverified, r.matched_prev_id) for r in verification.verify(old, new, path).collect()}
    assert got == {
        ("old", 1): ("Failed", True, False, None), ("old", 2): ("Open", False, False, None), ("old", 3): ("Repaired", False, False, None),
        ("old", 7): ("Failed", False, True, None), ("new", 4): ("Failed", True, False, 1), ("new", 5): ("Open", False, False, 2),
        ("new", 6): ("New", False, False, None),
    }
    bare = verification.verify(old, new, path.limit(0)).filter("side = 'old' and defect_id = 3").first()
    assert (bare.status, bare.unverified) == ("Open", True)
    # two pairs with the same ids and places: the second has no new defect and another trace
    pair = lambda df, *k: df.crossJoin(spark.createDataFrame([(x,) for x in k], "pair bigint"))
    both = verification.verify(pair(old, 1, 2), pair(new, 1), pair(path, 1), keys=["pair"]).collect()
    assert {(r.side, r.defect_id): (r.status, r.recurrence, r.unverified, r.matched_prev_id) for r in both if r.pair == 1} == got
    assert {(r.side, r.defect_id, r.status, r.unverified) for r in both if r.pair == 2} == {
        ("old", 1, "Repaired", True), ("old", 2, "Open", True), ("old", 3, "Open", True), ("old", 7, "Failed", True)
    }


def test_lookup_and_accuracy(spark):
    truth = spark.createDataFrame([(1, "Repaired"), (2, "Open"), (3, "Failed"), (4, "Open"), (5, "lost")], "defect_id bigint, actual string")
    said = spark.createDataFrame([(1, "Open", 0), (1, "Repaired", 1), (2, "Open", 2), (3, "Failed", 3), (4, "what", 4)], "defect_id bigint, status string, pos int")
    looked = verification.lookup_predictions(truth, said)
    assert tuple(verification.accuracy(looked).first()) == (4, 3, 0.75)
    cells = {(r.actual, r.predicted): r.n for r in verification.confusion(looked).collect()}
    assert len(cells) == 25 and cells["Open", "unverified"] == 1 and sum(cells.values()) == 4


def test_detection_scores(spark):
    p = spark.createDataFrame([(n, "a") for n in range(8)], "defect_id bigint, class_name string")
    t = spark.createDataFrame([(n, "a") for n in range(10)] + [(99, "b")], "defect_id bigint, class_name string")
    m = spark.createDataFrame([(n,) for n in range(7)], "l_id bigint")
    got = {r.class_name: r for r in metrics.detection_scores(p, t.filter("class_name = 'a'"), m).collect()}["a"]
    assert (got.tp, got.fp, got.fn) == (7, 1, 3) and (got.precision, got.recall) == (0.875, 0.7) and got.f1 == pytest.approx(0.7777777, abs=1e-6)
    both = {r.class_name: r for r in metrics.detection_scores(p, t, m).collect()}
    assert (both["b"].precision, both["b"].recall, both["overall"].fn) == (0.0, 0.0, 4)
    none = metrics.detection_scores(p.limit(0), t.limit(0), m.limit(0)).collect()
    assert [(r.class_name, r.precision, r.recall) for r in none] in ([("overall", 1.0, 1.0)], [])


def test_kappa_facts(spark):
    one = [0, 0, 1, 1, 2, 2, 1, 0, 2, 1]
    two = [0, 1, 1, 1, 2, 1, 1, 0, 2, 2]

    def kappa(a, b):
        df = spark.createDataFrame(list(zip(a, b)), "i bigint, j bigint")
        return metrics.kappa(metrics.confusion_counts(df, F.col("i"), F.col("j")), []).first()

    n = len(one)
    seen = sum((a - b) ** 2 for a, b in zip(one, two)) / n
    chance = sum((a - b) ** 2 for a in one for b in two) / n / n
    assert kappa(one, two).kappa == pytest.approx(1 - seen / chance, abs=1e-9)
    assert kappa([0, 1, 2, 0], [0, 1, 2, 0]).kappa == pytest.approx(1.0)
    assert (kappa([0] * 4, [0] * 4).kappa, kappa([0] * 4, [0] * 4).note) == (None, "single category")
    assert kappa([0, 0], [0, 1]).note == "constant rater"


def test_threshold_search_beats_the_start(spark):
    crops = [(n, a, s) for n, (a, s) in enumerate([(0.01, 0)] * 12 + [(0.05, 1)] * 12 + [(0.12, 2)] * 12)]
    df = spark.createDataFrame(crops, "crop_id bigint, area_ratio double, consensus bigint")
    got = metrics.tune_thresholds(df).first()
    assert (got.n_samples, got.train_size, got.test_size) == (36, 25, 11) and got.tuned_train_kappa == 1.0 and got.low < got.med
    small = metrics.tune_thresholds(df.filter("crop_id % 2 = 0")).first()
    assert small.warnings == "small sample"


def test_rating_sheet_fills_up(spark):
    df = spark.createDataFrame([(n, "High" if n < 5 else "Low" if n < 90 else "odd") for n in range(120)], "crop_id bigint, system_severity string")
    sheet = dataset.rating_sheet(df, 60, 1).collect()
    assert len(sheet) == 60 and sorted(r.sheet_id for r in sheet) == list(range(1, 61)) and sum(r.system_severity == "High" for r in sheet) == 5
    assert [r.crop_id for r in dataset.rating_sheet(df, 60, 1).collect()] == [r.crop_id for r in sheet]


# data sets ---------------------------------------------------------------------------


@pytest.mark.parametrize("n,want", [(1, {"test"}), (2, {"val", "test"}), (20, {"train", "val", "test"})])
def test_split_keeps_groups_whole(spark, n, want):
    df = spark.createDataFrame([(f"g{g}_{k}.jpg", f"g{g}") for g in range(n) for k in range(3)], "image string, grp string")
    rows = dataset.grouped_split(df, 42).collect()
    assert len(rows) == 3 * n and {r.split for r in rows} == want
    assert all(len({r.split for r in rows if r.grp == g}) == 1 for g in {r.grp for r in rows})
    if n == 20:
        assert sum(r.split == "train" for r in rows) == 42 and sum(r.split == "val" for r in rows) == 9


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("seed,size,length", [(1, 40, 4), (2, 12, 7), (3, 5, 14), (4, 30, 5), (5, 14, 6)])
def test_nearest_cross_split_equals_all_pairs(spark, seed, size, length):
    rng = random.Random(seed)
    names = {"".join(rng.choice("abcd") for _ in range(rng.randint(length - 1, length + 1))) for _ in range(size)}
    rows = [(n, rng.choice("xy"), rng.choice(["train", "val"])) for n in sorted(names)]
    df = spark.createDataFrame(rows, "image string, grp string, split string")
    pairs = [(levenshtein(a[0], b[0]), a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0] and a[2] != b[2]]
    got = nearest.nearest_names(df).first()
    assert (got is None and not pairs) or (got.edit_distance, got.a, got.b) == min(pairs)
    count = {r.grp: (r.n_pairs, r.first_a, r.first_b) for r in dataset.cross_split_pairs(df).collect()}
    for g in {r[1] for r in rows}:
        mine = [(a, b) for _, a, b in pairs if a in {r[0] for r in rows if r[1] == g}]
        assert (count[g] == (len(mine), *min(mine))) if mine else g not in count


def test_audit_and_mapping(spark):
    id_map = {0: "D00", 1: "D10", 2: "D20", 3: "D40", 4: "D44"}
    images = spark.createDataFrame([("a", "train", True), ("b", "train", True), ("c", "val", True), ("d", "val", False)], "image string, split string, has_label boolean")
    labels = spark.createDataFrame([("a", 0, "0"), ("a", 1, "4"), ("a", 2, "9"), ("b", 0, "4"), ("a", 3, "D20")], "image string, box_idx bigint, raw_id string")
    status = dataset.image_status(images, labels, id_map)
    assert {r.image: r.state for r in status.collect()} == {"a": "labelled", "b": "excluded_only", "c": "empty_label", "d": "no_label"}
    assert {(r.box_idx, r.new_id) for r in dataset.three_class(labels, id_map).collect()} == {(0, 0), (3, 1)}
    assert dataset.excluded_policy(status, "drop").count() == 3 and dataset.excluded_policy(status, "drop", parity=True).count() == 4


@pytest.mark.parametrize("threshold", [3, 10])
def test_similar_hashes_equal_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(15)]
    values = []
    for b in base:
        for _ in range(4):
            v = b
            for bit in rng.sample(range(64), rng.randint(0, 8)):
                v ^= 1 << bit
            values.append(v - (1 << 64) if v >= 1 << 63 else v)
    df = spark.createDataFrame([(f"i{n}.jpg", v) for n, v in enumerate(values)] + [("none.jpg", None)], "image string, hash bigint")
    distinct = sorted(set(values))
    want = {(a, b) for n, a in enumerate(distinct) for b in distinct[n + 1:] if bin((a ^ b) & (1 << 64) - 1).count("1") <= threshold}
    assert {(r.a, r.b) for r in hashing.similar_pairs(df, threshold).collect()} == want
    groups = {r.image: r.grp for r in hashing.hash_groups(df, threshold).collect()}
    assert groups["none.jpg"] == "none" and len(groups) == len(values) + 1


def test_orientation_baseline_learns_the_aspect(spark):
    rows = [(f"i{n}", "train" if n < 40 else "val", n, "transverse" if n % 2 else "longitudinal", 3.0 if n % 2 else 0.3, float(n % 2)) for n in range(62)]
    got = dataset.orientation_baseline(spark.createDataFrame(rows, "image string, split string, box_idx bigint, label string, aspect double, is_wider double")).collect()
    assert {(r["class"], r.support, r.precision, r.recall, r.accuracy) for r in got} == {("longitudinal", 11, 1.0, 1.0, 1.0), ("transverse", 11, 1.0, 1.0, 1.0)}


def test_region_recall(spark):
    schema = "image_id bigint, kind string, pos bigint, x1 double, y1 double, x2 double, y2 double"
    labels = spark.createDataFrame([(1, "face", 0, 0.0, 0.0, 10.0, 10.0), (1, "face", 1, 50.0, 50.0, 60.0, 60.0), (2, "license_plate", 0, 0.0, 0.0, 40.0, 10.0)], schema)
    regions = spark.createDataFrame([(1, "face", 0, 2.0, 2.0, 12.0, 12.0), (2, "face", 0, 0.0, 0.0, 40.0, 10.0)], schema)
    assert {r.kind: (r.total, r.matched, r.recall) for r in imaging.region_recall(labels, regions).collect()} == {"face": (2, 1, 0.5), "license_plate": (1, 0, 0.0)}


# files -------------------------------------------------------------------------------


def test_gps_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "timestamp,lat,lon,accuracy_m,speed\n1700000000.0,13.0,80.0,2.0,10.0\ninvalid_time,13.0,80.0,,\n1700000001.0,13.0001,80.0001,2.0,10.0\n2023-11-14T22:13:22Z,13.0002,80.0002,,\n"
    )
    points, bad = readers.gps_csv(spark, str(tmp_path / "a.csv"))
    assert [r.timestamp_s for r in points.orderBy("timestamp_s").collect()] == [1700000000.0, 1700000001.0, 1700000002.0] and bad.first()[0] == 1
    (tmp_path / "a.gpx").write_text(
        '<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>'
        '<trkpt lat="13.0" lon="80.0"><time>2023-11-14T22:13:20Z</time></trkpt><trkpt lat="13.1" lon="80.0"></trkpt>'
        '<trkpt lat="13.2" lon="80.0"><time>2023-11-14T22:13:21+00:00</time></trkpt></trkseg></trk></gpx>'
    )
    points, bad = readers.gps_gpx(spark, str(tmp_path / "a.gpx"))
    assert sorted(r.lat for r in points.collect()) == [13.0, 13.2] and bad.first()[0] == 1
    assert sorted((r.lat, r.seq) for r in points.collect()) == [(13.0, 0), (13.2, 1)]


def test_traces_are_numbered_over_the_files_of_a_survey(spark, tmp_path):
    for survey, name, lats in ((1, "a", [1, 2]), (1, "b", [3]), (2, "a", [9, 8, 7])):
        (tmp_path / f"s{survey}").mkdir(exist_ok=True)
        (tmp_path / f"s{survey}" / f"{name}.csv").write_text("timestamp,lat,lon\n" + "".join(f"1,{lat},80\nx,1,1\n" for lat in lats))
    points, bad = readers.gps_csv(spark, str(tmp_path / "s*"), survey=r"/s(\d+)/")
    got = sorted((r.survey_id, r.seq, r.lat) for r in points.collect())
    assert got == [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (2, 0, 9.0), (2, 1, 8.0), (2, 2, 7.0)] and bad.first()[0] == 6
    unnamed, _ = readers.gps_csv(spark, str(tmp_path / "s*"), survey=r"/x(\d+)/")
    assert sorted((r.lat, r.seq) for r in unnamed.filter("survey_id is null").collect()) == [(1.0, 0), (2.0, 1), (3.0, 0), (7.0, 2), (8.0, 1), (9.0, 0)]


def test_cache_entries_are_numbered_over_documents(spark, tmp_path):
    line = '{"highways": [{"tags": {"highway": "%s"}, "geometry": [[1, 2], [3, 4]]}], "amenities": [{"tags": {}, "lat": 1, "lon": 2}]}\n'
    (tmp_path / "a.json").write_text(line % "primary" + '{"broken\n' + line % "tertiary")
    (tmp_path / "b.json").write_text(line % "service")
    roads, places = readers.osm_cache(spark, str(tmp_path), multi_line=False)
    assert sorted({(r.way_pos, r.highway) for r in roads.collect()}) == [(0, "primary"), (1, "tertiary"), (2, "service")]
    assert sorted(r.amenity_id for r in places.collect()) == [0, 1, 2]


def test_default_defect_ids_follow_file_names(spark, tmp_path):
    for name, rows in (("a", 1), ("b", 400), ("c", 30)):
        (tmp_path / f"{name}.csv").write_text("class,lat,lon\n" + "".join(f"{name}{k:03},1.0,2.0\n" for k in range(rows)))
    got = [r.class_name for r in readers.defects_csv(spark, str(tmp_path)).orderBy("defect_id").collect()]
    assert got == sorted(got) and len(got) == 431


def test_score_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text("﻿class_name,lat,lon\nD00,1.0,2.0\nD10,3.0,4.0\n", encoding="utf-8")
    assert sorted((r.defect_id, r.class_name) for r in readers.defects_csv(spark, str(tmp_path / "d.csv")).collect()) == [(1, "D00"), (2, "D10")]
    (tmp_path / "d.json").write_text('{"defects": [{"defect_id": 5, "class": "D40", "lat": 1.0, "lon": 2.0}], "pre_dedup_detections": 9}')
    rows, n = readers.defects_json(spark, str(tmp_path / "d.json"))
    assert (rows.first().class_name, n.first()[0]) == ("D40", 9)
    (tmp_path / "l.json").write_text('[{"defect_id": 5, "class_name": "D40", "lat": 1.0, "lon": 2.0}, {"defect_id": 6, "class": "D00", "lat": 1.0, "lon": 2.0}]')
    rows, n = readers.defects_json(spark, str(tmp_path / "l.json"))
    assert (rows.count(), n.first()[0]) == (2, 2)
    (tmp_path / "m.csv").write_text("defect_id,status\n1, Repaired \n2,\n")
    assert {(r.defect_id, r.status, r.lat) for r in readers.repair_manifest(spark, str(tmp_path / "m.csv")).collect()} == {(1, "Repaired", 0.0), (2, "Open", 0.0)}
    labels = tmp_path / "labels"
    labels.mkdir()
    (labels / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n\n  D44 0.1 0.2 0.3 0.4 \n")
    (labels / "b.txt").write_text("")
    got = sorted((r.file, r.box_idx, r.raw_id, r.h) for r in readers.yolo_labels(spark, str(labels)).collect())
    assert got == [("a.txt", 0, "0", 0.2), ("a.txt", 1, "D44", 0.4)]
    assert {(r.rel_path, r.ext) for r in readers.inventory(spark, str(labels), [".txt"]).collect()} == {("a.txt", ".txt"), ("b.txt", ".txt")}


def test_ground_truth_checks(spark):
    rows = [(2, "1", "D00", "13.0", "80.0"), (3, "1", "D00", "13.0", "80.0"), (4, "x", "D99", "99", "east"), (5, "-2", "D00", "13", "181"), (6, " ", "", "", "")]
    df = spark.createDataFrame(rows, "row_no bigint, defect_id string, class_name string, lat string, lon string")
    got = {r.row_no: r.errors for r in intake.validate_ground_truth(df).collect()}
    assert got == {2: [], 3: ["id_duplicate"], 4: ["id_not_integer", "class_unknown", "lat_range", "lon_not_number"], 5: ["id_not_positive", "lon_range"]}


def test_uploads_and_purge(spark, tmp_path):
    df = spark.createDataFrame([("a.mp4", 10, b"MZ.."), ("b.MKV", 10, b"fine"), ("c.csv", 10, b"a,b"), ("d.gpx", 10, b"none"), ("e.exe", 10, b""), ("f.avi", 60 << 20, b"ok")], "path string, length bigint, content binary")
    assert {r.path: r.reasons for r in intake.check_uploads(df).collect()} == {"a.mp4": ["executable"], "b.MKV": [], "c.csv": [], "d.gpx": ["gps_content"], "e.exe": ["extension"], "f.avi": ["size"]}
    import os

    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    for name, days in (("a.jpg", 5), ("b.mp4", 40), ("c.JPG", 50), ("d.txt", 90)):
        (tmp_path / name).write_text("x")
        stamp = now.timestamp() - days * 86400
        os.utime(tmp_path / name, (stamp, stamp))
    plan = intake.purge_plan(readers.inventory(spark, str(tmp_path)), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    assert tuple(intake.purge_counts(plan).first()) == (3, 2, 1) and len(os.listdir(tmp_path)) == 4
    assert intake.apply_purge(plan) == 2 and sorted(os.listdir(tmp_path)) == ["a.jpg", "d.txt"]


def test_store_round_trip(spark, tmp_path):
    store = SurveyStore(spark, str(tmp_path / "store"))
    store.add_surveys(spark.sql("SELECT 1L AS survey_id, DATE'2024-01-01' AS surveyed_on, 'r' AS route_name, 's' AS source UNION ALL SELECT 2, DATE'2024-02-01', 'r', 's'"))
    rows = [(s, n, "D00", 1.0, 2.0, "High", 10.7, 0.5, 0.0, 1.0, 2.0, 3.0) for s in (1, 2) for n in (1, 2)]
    d = spark.createDataFrame(rows, "survey_id bigint, defect_id bigint, class_name string, lat double, lon double, severity string, area_px double, confidence double, x1 double, y1 double, x2 double, y2 double")
    store.add_defects(d)
    store.add_defects(d.filter("survey_id = 2"))
    assert sorted(r.defect_id for r in store.read("defects").collect()) == [1, 2, 3, 4, 5, 6] and store.defects_of(2).count() == 4
    store.update_defects(spark.sql("SELECT 1L AS survey_id, 2L AS defect_id, 'Open' AS status, 9L AS matched_prev_id, true AS recurrence, false AS unverified"))
    got = store.defect(2).first()
    assert (got.status, got.matched_prev_id, got.recurrence, got.bbox_y2, got.area_px) == ("Open", 9, True, 3.0, 10) and store.defect(1).first().status == "New"
    store.set_survey_status(spark.sql("SELECT 1L AS survey_id, 'completed' AS status"))
    assert [(r.survey_id, r.status) for r in store.surveys_newest_first().collect()] == [(2, "processing"), (1, "completed")]
    assert {(r.survey_id, r.n_defects, r.n_segments) for r in store.survey_counts().collect()} == {(1, 2, 0), (2, 4, 0)}
    q = spark.sql("SELECT 1L AS queue_rank, 3L AS defect_id, 'D00' AS class_name, cast(null as string) AS severity, cast(null as double) AS priority, 750.0D AS estimated_cost, 'New' AS status")
    export_queue(q, str(tmp_path / "queue"))
    text = "".join(p.read_text() for p in (tmp_path / "queue").glob("part-*"))
    assert text.splitlines() == ["defect_id,class,severity,priority,estimated_cost,status", "3,D00,,0.00,750.00,New"]


def test_default_retention():
    assert (DEFAULTS.retention_days, DEFAULTS.max_upload_mb) == (30, 50)
