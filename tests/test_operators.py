"""Iterative and blocked operators against plain Python folds, with hand-made facts."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from roadloom.config import DEFAULTS
from roadloom.functions import boxes, text
from roadloom.operators import areas, components, hashing, imaging, matching, ranking, selection, spatial, temporal, tracks

R = 6_371_000.0


def hav(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    x = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def metres(lat_m, lon_m, base=(13.0, 80.0)):
    return base[0] + lat_m / 111_194.93, base[1] + lon_m / (111_194.93 * math.cos(math.radians(base[0])))


# ranking -----------------------------------------------------------------------------


def test_rank_of_sparse_negative_and_text_ids(spark):
    wide = spark.range(0, 20_000).selectExpr("(id - 10000) * 100003 AS id", "1 AS k", "cast(pmod(id, 5) as int) AS lead")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ranking.ranged(wide, ["k", "id"]).select("k", "_blk").distinct().count() == parts
    for name, order in (("id", lambda r: (-r.lead, r.id)), ("name", lambda r: (-r.lead, r.name))):
        got = ranking.blocked_rank(wide.withColumn("name", F.col("id").cast("string")), ["k"], name, "rk", lead=[("lead", False)]).collect()
        assert [r.rk for r in sorted(got, key=order)] == list(range(1, 20_001))



def test_blocked_rank_and_sum_cross_blocks(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 2), n, float(rng.randint(0, 9))) for k in (1, 2) for n in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "k int, lead int, id bigint, v double")
    got = ranking.blocked_rank(df, ["k"], "id", "rk", lead=[("lead", False)], block=F.floor(F.col("id") / 7)).collect()
    for k in (1, 2):
        want = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        assert {(r.lead, r.id): r.rk for r in got if r.k == k} == {(w[1], w[2]): n for n, w in enumerate(want, 1)}
    sums = ranking.blocked_running_sum(df, ["k"], "id", "v", "run", F.floor(F.col("id") / 7)).collect()
    for k in (1, 2):
        total = 0.0
        mine = {r.id: r.run for r in sums if r.k == k}
        for w in sorted((r for r in rows if r[0] == k), key=lambda r: r[2]):
            total += w[3]
            assert mine[w[2]] == pytest.approx(total)


def test_chainage_is_the_same_in_small_blocks(spark):
    pts = [(1, n, float(n + (20 if n > 30 else 0)), 13.0 + n * 8e-5, 80.0) for n in range(1, 61)]
    gps = spark.createDataFrame(pts, "survey_id bigint, seq bigint, timestamp_s double, lat double, lon double")
    a = {r.seq: (round(r.cum_m, 6), r.is_gap) for r in temporal.chainage(gps).collect()}
    b = {r.seq: (round(r.cum_m, 6), r.is_gap) for r in temporal.chainage(gps, block_rows=7).collect()}
    assert a == b and sum(g for _, g in a.values()) == 1 and a[1][0] == 0.0


# interpolation -----------------------------------------------------------------------


def interpolate(points, t, max_gap=5.0):
    if not points or t < points[0][0] or t > points[-1][0]:
        return None
    for p, q in zip(points, points[1:]):
        if p[0] <= t <= q[0]:
            gap = q[0] - p[0]
            if gap > max_gap:
                return None
            f = 0.0 if gap == 0 else (t - p[0]) / gap
            return p[1] + f * (q[1] - p[1]), p[2] + f * (q[2] - p[2])
    return None


@pytest.mark.parametrize("ordered", [True, False])
def test_interpolation_equals_the_list_walk(spark, ordered):
    rng = random.Random(7 if ordered else 8)
    traces, probes = {}, []
    for s in range(6):
        t, pts = 0.0, []
        for _ in range(60):
            t += rng.choice([0, 1, 1, 1, 2, 5, 6, 40, 3000])
            pts.append((t, 13 + rng.random() / 100, 80 + rng.random() / 100))
        if not ordered:
            for _ in range(8):
                i, j = rng.sample(range(60), 2)
                pts[i], pts[j] = pts[j], pts[i]
        traces[s] = pts
        times = [p[0] for p in pts] + [p[0] + rng.choice([0.5, -0.5, 2.0, 10.0]) for p in pts]
        probes += [(s, n, x) for n, x in enumerate(times)]
    gps = spark.createDataFrame(
        [(s, n, *p) for s, pts in traces.items() for n, p in enumerate(pts)],
        "survey_id bigint, seq bigint, timestamp_s double, lat double, lon double",
    )
    df = spark.createDataFrame(probes, "survey_id bigint, track_id bigint, t double")
    got = {(r.survey_id, r.track_id): (r.lat, r.lon) for r in temporal.interpolate(df, gps, ["survey_id", "track_id"]).collect()}
    assert len(got) == len(probes)
    for s, n, t in probes:
        want = interpolate(traces[s], t)
        assert got[(s, n)] == (None, None) if want is None else got[(s, n)] == pytest.approx(want)


def test_interpolation_facts(spark):
    gps = spark.createDataFrame(
        [(1, 1, 10.0, 10.0, 20.0), (1, 2, 12.0, 10.2, 20.2), (1, 3, 20.0, 11.0, 21.0)],
        "survey_id bigint, seq bigint, timestamp_s double, lat double, lon double",
    )
    probes = spark.createDataFrame([(1, n, t) for n, t in enumerate([11.0, 15.0, 9.0, 12.0])], "survey_id bigint, track_id bigint, t double")
    got = {r.track_id: r.lon for r in temporal.interpolate(probes, gps, ["survey_id", "track_id"]).collect()}
    assert got[0] == pytest.approx(20.1) and got[1] is None and got[2] is None and got[3] == pytest.approx(20.2)


# tracks and areas --------------------------------------------------------------------


def test_closest_approach_prefers_area_on_equal_bottom(spark):
    rows = [
        (1, 5, "D00", 1, 0.0, 0.0, 10.0, 100.0, 0.9, 640, 480),
        (1, 5, "D00", 2, 0.0, 0.0, 20.0, 100.0, 0.5, 640, 480),
        (1, 5, "D00", 3, 0.0, 0.0, 90.0, 99.0, 0.9, 640, 480),
        (1, 6, "D00", 3, 0.0, 0.0, 90.0, 99.0, 0.9, 640, 480),
    ]
    df = spark.createDataFrame(
        rows, "survey_id bigint, track_id bigint, class_name string, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, confidence double, frame_w int, frame_h int"
    )
    got = tracks.closest_approach(df).collect()
    assert [(r.track_id, r.frame_idx) for r in got] == [(5, 2)]


@pytest.mark.parametrize("crowded", [256, 0])
def test_union_area_equals_raster(spark, monkeypatch, crowded):
    monkeypatch.setattr(areas, "CROWDED", crowded)
    rng = random.Random(3)
    rows, want, plain = [], {}, {}
    sets = {0: [(0, 0, 40, 40)] * 2, 1: [(-5, -5, 10, 10), (5, 5, 15, 15)], 2: [(500, 500, 600, 600), (10, 10, 10, 20)]}
    for k in range(3, 25):
        sets[k] = [(a, b, a + rng.random() * 60, b + rng.random() * 60) for a, b in [(rng.random() * 90 - 5, rng.random() * 90 - 5) for _ in range(rng.randint(1, 12))]]
    for k, bs in sets.items():
        canvas = set()
        for x1, y1, x2, y2 in bs:
            rows.append((k, float(x1), float(y1), float(x2), float(y2), 100, 80))
            canvas |= {(x, y) for x in range(max(0, int(x1)), min(100, int(x2))) for y in range(max(0, int(y1)), min(80, int(y2)))}
        want[k] = len(canvas)
        plain[k] = sum(max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) for b in bs)
    df = spark.createDataFrame(rows, "k int, x1 double, y1 double, x2 double, y2 double, frame_w int, frame_h int")
    got = {r.k: r.union_px for r in areas.union_area(df, ["k"]).collect()}
    assert {k: v for k, v in want.items() if v} == got
    assert want[0] == 1600 and {r.k: r.sum_px for r in areas.summed_area(df, ["k"]).collect()} == pytest.approx(plain)


@pytest.mark.parametrize("width", [32768, 40000, 100000])
def test_union_area_in_wide_frames(spark, width):
    sizes = {1: 200, 2: 400}  # on both sides of the crowded case
    rows = [(k, 0.0, 0.0, float(width), 100.0, width, 480) for k in sizes]
    rows += [(k, 7.0 * i, 50.0, 7.0 * i + 5, 120.0, width, 480) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k int, x1 double, y1 double, x2 double, y2 double, frame_w int, frame_h int")
    got = {r.k: r.union_px for r in areas.union_area(df, ["k"]).collect()}
    assert got == {k: 100 * width + n * 5 * 20 for k, n in sizes.items()}


def test_hash_pairs_at_any_threshold(spark):
    rng = random.Random(9)
    values = [rng.getrandbits(63) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(63), 14)) for v in values[:20]]
    df = spark.createDataFrame([(v,) for v in values], "hash bigint")
    for threshold in (0, 10, 14, 20):
        got = {(r.a, r.b) for r in hashing.similar_pairs(df, threshold).collect()}
        assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= threshold}


def test_suppression_at_the_ends_of_the_scale(spark):
    df = spark.createDataFrame(
        [(1, 0, 0.9, 0.0, 0.0, 9.0, 9.0), (1, 1, 0.8, 0.0, 0.0, 9.0, 9.0), (1, 2, 0.7, 0.0, 0.0, 9000.0, 9000.0)],
        "image_id int, pos int, score double, x1 double, y1 double, x2 double, y2 double",
    )
    kept = lambda t: sorted(r.pos for r in imaging.suppress(df, replace(DEFAULTS, iou_threshold=t)).collect())
    assert kept(1.0) == [0, 1, 2] and kept(0.0) == [0]


def test_negative_costs_are_refused(spark):
    ranked = spark.createDataFrame([(1, 1, 5.0), (1, 2, -2.0)], "survey_id bigint, queue_rank bigint, estimated_cost double")
    budgets = spark.createDataFrame([(1, 1, 3.0)], "survey_id bigint, budget_id int, budget double")
    with pytest.raises(Exception, match="negative"):
        selection.select_within_budget(ranked, budgets)[0].collect()


def test_label_boundaries(spark):
    df = spark.createDataFrame([(0.0199,), (0.02,), (0.0799,), (0.08,), (0.05,), (0.15,)], "v double")
    got = [(r.s, r.c) for r in df.select(boxes.severity(F.col("v")).alias("s"), boxes.condition(F.col("v")).alias("c")).collect()]
    assert [g[0] for g in got] == ["Low", "Medium", "Medium", "High", "Medium", "High"]
    assert got[4][1] == "Fair" and got[5][1] == "Poor"


# clustering and radius operators ------------------------------------------------------


def brute_clusters(points, radius):
    parent = {p[0]: p[0] for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(points):
        for q in points[i + 1:]:
            if hav(p[1:], q[1:]) <= radius:
                a, b = sorted((find(p[0]), find(q[0])))
                parent[b] = a
    return {p[0]: find(p[0]) for p in points}


def crowd(rng, spread):
    pts = []
    for n in range(150):
        kind = rng.random()
        if kind < 0.3:
            lat, lon = metres(0.5 * rng.random(), 0.5 * rng.random())
        elif kind < 0.5:
            lat, lon = metres(2.0, 2.0)
        else:
            lat, lon = metres(rng.random() * spread, rng.random() * spread)
        pts.append((n, lat, lon))
    return pts


@pytest.mark.parametrize("seed,spread", [(1, 60), (2, 140), (3, 300)])
def test_clusters_equal_brute_force(spark, seed, spread):
    pts = crowd(random.Random(seed), spread)
    df = spark.createDataFrame([(1, *p) for p in pts], "survey_id bigint, track_id bigint, lat double, lon double")
    got = {r.track_id: r.component for r in components.clusters(df, 5.0, ["survey_id"], "track_id").collect()}
    assert got == brute_clusters(pts, 5.0)
    flags = {r.track_id: r.linked for r in components.linked_flags(df, 5.0, ["survey_id"], "track_id").collect()}
    assert flags == {p[0]: any(q[0] != p[0] and hav(p[1:], q[1:]) <= 5.0 for q in pts) for p in pts}


def test_chain_of_points_is_one_cluster(spark):
    pts = [(n, *metres(0.0, 4.9 * n)) for n in range(120)]
    random.Random(5).shuffle(pts)
    ids = {n: p for n, p in enumerate(pts)}
    df = spark.createDataFrame([(1, n, p[1], p[2]) for n, p in ids.items()], "survey_id bigint, track_id bigint, lat double, lon double")
    got = components.clusters(df, 5.0, ["survey_id"], "track_id").collect()
    assert {r.component for r in got} == {0}


def test_clusters_across_the_date_line_and_at_high_latitude(spark):
    pts = [(1, 0.0, 179.99999), (2, 0.0, -179.99999), (3, 78.0, 10.0), (4, 78.0, 10.0002), (5, 78.0, 10.01)]
    df = spark.createDataFrame([(1, *p) for p in pts], "survey_id bigint, track_id bigint, lat double, lon double")
    got = {r.track_id: r.component for r in components.clusters(df, 5.0, ["survey_id"], "track_id").collect()}
    assert got == brute_clusters(pts, 5.0) and got[2] == 1 and got[4] == 3


def test_flag_within_equals_brute_force(spark):
    rng = random.Random(11)
    pts, tgt = crowd(rng, 200), [(n, *metres(rng.random() * 200, rng.random() * 200)) for n in range(40)]
    tgt += [(100 + n, *metres(20 + rng.random(), 20 + rng.random())) for n in range(60)]
    p = spark.createDataFrame(pts, "id bigint, lat double, lon double")
    t = spark.createDataFrame(tgt, "id bigint, lat double, lon double")
    got = {r.id: r.near for r in spatial.flag_within(p, t, 15.0, "near").collect()}
    assert got == {a[0]: any(hav(a[1:], b[1:]) <= 15.0 for b in tgt) for a in pts}
    none = spatial.flag_within(p, t.limit(0), 15.0, "near").filter("near").count()
    assert none == 0


def test_snap_finds_far_edges(spark):
    gps = spark.createDataFrame(
        [(1, n, float(n), 13.0 + n * 8e-5, 80.0) for n in range(1, 40)], "survey_id bigint, seq bigint, timestamp_s double, lat double, lon double"
    )
    chain = temporal.chainage(gps)
    pts = spark.createDataFrame([(1, 1, 13.0012, 80.0), (1, 2, 13.002, 80.01), (1, 3, 14.5, 80.0), (2, 4, 13.0, 80.0)], "survey_id bigint, id bigint, lat double, lon double")
    got = {r.id: (r.chain_m, r.snap_m) for r in spatial.snap_to_trace(pts, chain, ["id"]).collect()}
    total = hav((13.0 + 8e-5, 80.0), (13.0 + 39 * 8e-5, 80.0))
    assert got[1][1] == pytest.approx(0.0, abs=1e-6) and got[2][1] == pytest.approx(0.01 * 111139 * math.cos(math.radians(13.002)), rel=1e-4)
    assert got[3][0] == pytest.approx(total) and got[4] == (0.0, None)


# matching ----------------------------------------------------------------------------


def greedy(old, new, radius):
    pairs = sorted(
        (round(hav(o[2:], n[2:]), 6), o[0], n[0]) for o in old for n in new if o[1] == n[1] and round(hav(o[2:], n[2:]), 6) <= radius
    )
    used_o, used_n, out = set(), set(), set()
    for _, o, n in pairs:
        if o not in used_o and n not in used_n:
            used_o.add(o)
            used_n.add(n)
            out.add((o, n))
    return out


@pytest.mark.parametrize("seed,grid", [(1, 0.0), (2, 1.1), (3, 1.1), (4, 3.0)])
def test_greedy_match_equals_the_sorted_walk(spark, seed, grid):
    """With a grid many distances tie and many places hold copies."""
    rng = random.Random(seed)

    def place():
        x, y = rng.random() * 25, rng.random() * 6
        return metres(round(x / grid) * grid, round(y / grid) * grid) if grid else metres(x, y)

    ids = rng.sample(range(1000), 140)
    old = [(n, rng.choice("ab"), *place()) for n in ids[:60]]
    new = [(n, rng.choice("ab"), *place()) for n in ids[60:]]
    schema = "defect_id bigint, class_name string, lat double, lon double"
    got = matching.greedy_match(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), 10.0).collect()
    assert {(r.l_id, r.r_id) for r in got} == greedy(old, new, 10.0) and len(got) == len({r.l_id for r in got})


def test_greedy_match_in_steps_gives_the_same(spark, monkeypatch):
    rng = random.Random(9)
    old = [(n, "a", *metres(rng.random() * 8, rng.random() * 8)) for n in range(50)]
    new = [(n, "a", *metres(rng.random() * 8, rng.random() * 8)) for n in range(70)]
    schema = "defect_id bigint, class_name string, lat double, lon double"
    monkeypatch.setattr(matching, "CROWDED", 0)
    got = matching.greedy_match(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), 10.0).collect()
    assert {(r.l_id, r.r_id) for r in got} == greedy(old, new, 10.0)


@pytest.mark.parametrize("block", [65_536, 10])
def test_copies_at_one_place_match_by_id(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    at = metres(0, 0)
    schema = "defect_id bigint, class_name string, lat double, lon double"
    old = spark.createDataFrame([(n, "a", *at) for n in range(200)], schema)
    new = spark.createDataFrame([(n * 2, "a", *at) for n in range(150)], schema)
    got = {(r.l_id, r.r_id) for r in matching.greedy_match(old, new, 10.0).collect()}
    assert got == {(n, 2 * n) for n in range(150)}


# selection and suppression -----------------------------------------------------------


@pytest.mark.parametrize("block", [3, 1000])
def test_selection_equals_the_walk(spark, block):
    rng = random.Random(block)
    queue, budgets = [], []
    for s in range(8):
        costs = [rng.choice([750.0, 2250.0, 4500.0, 100.01, 33.33, 0.0]) for _ in range(40)]
        queue += [(s, n, c) for n, c in enumerate(costs, 1)]
        budgets += [(s, b, v) for b, v in enumerate([0.0, 1000.0, rng.random() * 60000, 1e9])]
    ranked = spark.createDataFrame(queue, "survey_id bigint, queue_rank bigint, estimated_cost double")
    marked, left = selection.select_within_budget(
        ranked, spark.createDataFrame([(s, b, round(v, 2)) for s, b, v in budgets], "survey_id bigint, budget_id int, budget double"), block_rows=block
    )
    got = {(r.survey_id, r.budget_id, r.queue_rank): r.selected for r in marked.collect()}
    rest = {(r.survey_id, r.budget_id): r.remaining for r in left.collect()}
    for s, b, v in budgets:
        remaining = round(v * 100)
        for _, n, c in (q for q in queue if q[0] == s):
            take = round(c * 100) <= remaining
            remaining -= round(c * 100) if take else 0
            assert got[(s, b, n)] == take
        assert rest[(s, b)] == pytest.approx(remaining / 100)


def nms(bs, thr):
    kept = []
    for b in sorted(bs, key=lambda b: (-b[1], b[0])):
        def iou(k):
            w, h = min(b[4], k[4]) - max(b[2], k[2]), min(b[5], k[5]) - max(b[3], k[3])
            i = max(0.0, w) * max(0.0, h)
            return i / ((b[4] - b[2]) * (b[5] - b[3]) + (k[4] - k[2]) * (k[5] - k[3]) - i)
        if all(iou(k) <= thr for k in kept):
            kept.append(b)
    return {b[0] for b in kept}


def test_suppression_equals_greedy(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for image in range(12):
        bs = []
        for pos in range(40):
            x, y, w, h = rng.random() * 60, rng.random() * 60, 5 + rng.random() * 60, 5 + rng.random() * 60
            bs.append((pos, round(rng.random(), 1), x, y, x + w, y + h))
        bs[7] = (7, bs[3][1], *bs[3][2:])
        rows += [(image, *b) for b in bs]
        want[image] = nms(bs, 0.45)
    df = spark.createDataFrame(rows, "image_id bigint, pos bigint, score double, x1 double, y1 double, x2 double, y2 double")
    got = imaging.suppress(df).collect()
    assert {i: {r.pos for r in got if r.image_id == i} for i in want} == want


def test_decode_and_corners(spark):
    df = spark.createDataFrame(
        [(1, 0, 10.0, 10.0, 4.0, 4.0, [0.5, 0.5, 0.1, 0.1]), (1, 1, 10.0, 10.0, 4.0, 4.0, [0.25, 0.1, 0.1, 0.1])],
        "image_id bigint, pos bigint, cx double, cy double, w double, h double, scores array<double>",
    )
    got = imaging.decode(df).collect()
    assert [(r.class_name, r.x1, r.y1, r.x2, r.y2) for r in got] == [("D00", 8.0, 8.0, 12.0, 12.0)]
    assert imaging.decode(df, ["only"]).first().class_name == "only"


def test_connected_components_on_random_graphs(spark):
    rng = random.Random(6)
    edges = [(g, rng.randrange(60), rng.randrange(60)) for g in range(3) for _ in range(45)]
    df = spark.createDataFrame(edges, "g int, a bigint, b bigint")
    got = {(r.g, r.node): r.component for r in components.connected_components(df, ["g"]).collect()}
    for g in range(3):
        label = {}
        for _ in range(60):
            for _, a, b in (e for e in edges if e[0] == g and e[1] != e[2]):
                m = min(label.get(a, a), label.get(b, b))
                label[a] = label[b] = m
        assert {n: c for (k, n), c in got.items() if k == g} == label


def test_text_helpers(spark):
    df = spark.createDataFrame([("a/japan_000123.JPG",), ("ab",), ("abcdef.png",), (".hidden",)], "p string")
    got = df.select(
        text.stem(F.col("p")).alias("s"), text.extension(F.col("p")).alias("e"), text.prefix_group(F.col("p")).alias("g"), text.window_group(F.col("p")).alias("w")
    ).collect()
    assert [tuple(r) for r in got] == [("japan_000123", ".jpg", "japan", "12"), ("ab", "", "ab", "ab"), ("abcdef", ".png", "abcd", "abcd"), (".hidden", "", ".hid", ".hid")]
    half = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(text.severity_name(F.col("v")).alias("n")).collect()
    assert [r.n for r in half] == ["Low", "High", "High"]


def test_default_parameters():
    assert (DEFAULTS.merge_radius_m, DEFAULTS.match_radius_m, DEFAULTS.coverage_radius_m) == (5.0, 10.0, 15.0)


@pytest.mark.parametrize("seed", range(4))
def test_budget_walk_with_thousands_of_costs(spark, monkeypatch, seed):
    """Phases stay below four for each binary digit of the budget, though nearly all items are refused."""
    rng = random.Random(seed)
    rows, budgets, want = [], [], {}
    for survey in range(3):
        n = 3000 if survey < 2 else 30
        costs = [rng.choice([rng.randrange(1, 10**7), rng.randrange(1, 900), 0, 5000 * 2**rng.randrange(12)]) for _ in range(n)]
        if survey == 1:
            costs = sorted(range(10**6, 10**6 + n), reverse=True)
        rows += [(survey, i + 1, c / 100) for i, c in enumerate(costs)]
        for b, budget in enumerate([0, 1, rng.randrange(10**4), rng.randrange(10**6, 10**7), 10**9, -5]):
            budgets.append((survey, b, budget / 100))
            left = budget
            for i, c in enumerate(costs):
                if c <= left:
                    left -= c
                    want[survey, b, i + 1] = True
            want[survey, b] = left
    calls, phase = [], selection._phase
    monkeypatch.setattr(selection, "_phase", lambda *a: calls.append(1) or phase(*a))
    marked, left = selection.select_within_budget(
        spark.createDataFrame(rows, "survey_id bigint, queue_rank bigint, estimated_cost double"),
        spark.createDataFrame(budgets, "survey_id bigint, budget_id int, budget double"), block_rows=256,
    )
    got = {(r.survey_id, r.budget_id, r.queue_rank): True for r in marked.filter("selected").collect()}
    got |= {(r.survey_id, r.budget_id): round(r.remaining * 100) for r in left.collect()}
    assert got == want
    assert marked.count() == len(rows) * 6 and len(calls) <= 4 * 30


@pytest.mark.parametrize("order", ["growing", "shuffled"])
def test_matching_along_a_line_of_growing_gaps(spark, monkeypatch, order):
    """2 000 places in a row: each pair frees the next, yet the rounds stay below fifteen."""
    rng = random.Random(4)
    gaps = [0.5 + 0.004 * i for i in range(1999)]
    if order == "shuffled":
        rng.shuffle(gaps)
    at, places = 0.0, [0.0]
    for g in gaps:
        at += g
        places.append(at)
    rows = [(i + 1, "D00", 13.0 + p / 111_194.93, 80.0) for i, p in enumerate(places)]
    schema = "defect_id bigint, class_name string, lat double, lon double"
    calls, one = [], matching._round
    monkeypatch.setattr(matching, "_round", lambda *a: calls.append(1) or one(*a))
    got = {(r.l_id, r.r_id) for r in matching.greedy_match(spark.createDataFrame(rows[::2], schema), spark.createDataFrame(rows[1::2], schema), 10.0).collect()}
    free, want = set(range(1, 2001)), set()
    pairs = [(round(hav(a[2:], b[2:]), 6), a[0], b[0]) for a in rows[::2] for b in rows[max(a[0] - 40, 0) : a[0] + 40] if b[0] % 2 == 0]
    for d, a, b in sorted(pairs):
        if d <= 10.0 and a in free and b in free:
            want.add((a, b))
            free -= {a, b}
    assert got == want and len(calls) < 15


@pytest.mark.parametrize("walked", [10**6, 0])
def test_suppression_of_tall_columns_and_random_boxes(spark, monkeypatch, walked):
    """A column of equal boxes is divided along y: compared pairs stay below 30 a box."""
    monkeypatch.setattr(imaging, "WALKED", walked)
    rng = random.Random(12)
    rows = [(1, n, rng.choice([0.5, 0.9, rng.random()]), 100.0, 7.0 * n, 140.0, 7.0 * n + 20 + n % 3) for n in range(700)]
    for n in range(250):
        x, y, w, h = (rng.random() * 300 for _ in range(4))
        rows.append((2, n, round(rng.random(), 1), x, y, x + w, y + h * rng.choice([0.02, 1, 1])))
    df = spark.createDataFrame(rows, "image_id int, pos int, score double, x1 double, y1 double, x2 double, y2 double")
    if walked:
        column = df.filter("image_id = 1")
        assert imaging.blocked_pairs(column, column, ["image_id"], 0.45).count() < 30 * 700
    for threshold in (0.45, 0.8):
        want = set()
        for image in (1, 2):
            live = sorted((r for r in rows if r[0] == image), key=lambda r: (-r[2], r[1]))
            while live:
                best = live.pop(0)
                want.add(best[:2])
                live = [r for r in live if overlap(best[3:], r[3:]) <= threshold]
        got = {(r.image_id, r.pos) for r in imaging.suppress(df, replace(DEFAULTS, iou_threshold=threshold)).collect()}
        assert got == want


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both, 1e-12)


def test_snapping_where_edges_and_points_crowd(spark):
    """1 500 short edges and 1 500 points at one place, beside an ordinary trace; copies of both."""
    rng = random.Random(3)

    def near(spread):
        return metres(rng.uniform(-spread, spread), rng.uniform(-spread, spread))

    lines = [(1, n, *near(0.6), *near(0.6)) for n in range(1500)] + [(1, 1500 + n, *metres(20 * n, 40), *metres(20 * n + 20, 40)) for n in range(50)]
    lines += [(2, n, *metres(0, 0), *metres(0, 0)) for n in range(30)] + [(1, 1600 + n, *lines[n][2:]) for n in range(100)]
    points = [(1, n, *near(rng.choice([0.5, 4, 12]))) for n in range(1500)] + [(1, 1500 + n, *metres(400 + n, 30 * n)) for n in range(40)] + [(2, 1, *metres(3, 4)), (3, 1, *metres(0, 0))]
    chain = spark.createDataFrame([(s, n, a, b, c, d, 10.0 * n + 10, 10.0) for s, n, a, b, c, d in lines], "survey_id int, seq int, p_lat double, p_lon double, lat double, lon double, cum_m double, step_m double")
    pts = spark.createDataFrame(points + [(s, n + 5000, a, b) for s, n, a, b in points[:200]], "survey_id int, id int, lat double, lon double")
    got = {(r.survey_id, r.id): (r.snap_m, r.chain_m) for r in spatial.snap_to_trace(pts, chain, ["id"]).collect()}
    assert got[3, 1] == (None, 0.0) and len(got) == len(points) + 200
    for s, n, lat, lon in points[:300] + points[1500:1541]:
        best = min((*planar(lat, lon, line), line[1]) for line in lines if line[0] == s)
        snap, chain_m = got[s, n]
        assert snap == pytest.approx(best[0], abs=1e-7)
        ties = [10.0 * line[1] + 10.0 * planar(lat, lon, line)[1] for line in lines if line[0] == s and planar(lat, lon, line)[0] <= best[0] + 1e-9]
        assert min(abs(chain_m - t) for t in ties) < 1e-4
        assert got[s, n] == got.get((s, n + 5000), got[s, n])


def planar(lat, lon, line):
    k, m = math.cos(math.radians(line[2])), 111_139
    px, py, ax, ay, bx, by = (lon * k * m, lat * m, line[3] * k * m, line[2] * m, line[5] * k * m, line[4] * m)
    length = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length)) if length else 0.0
    return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)), t
