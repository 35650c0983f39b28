"""Queries over GPS traces and detections: positions, tracks, defects."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from roadloom.config import DEFAULTS
from roadloom.functions import boxes, geo, text
from roadloom.operators import areas, components, dedup, temporal, tracks
from roadloom.plans.fixtures import FPS, view
from roadloom.plans.registry import cte, hav, query, shared
from roadloom.session import cut

CFG = replace(DEFAULTS, fps=FPS)
KEYS = ["survey_id", "track_id"]


def deg(c, alias=None):
    return F.round(c, 6).alias(alias or c)


def met(c, alias=None):
    return F.round(c, 4).alias(alias or c)


def ratio(c, alias=None):
    """Ten decimals: a share of the frame's pixels is never half a unit there."""
    return F.round(c, 10).alias(alias or c)


# shared intermediates ----------------------------------------------------------------


@shared
def positions(spark, sf):
    return cut(dedup.locate(view(spark, sf, "v_det"), view(spark, sf, "v_gps"), CFG))


@shared
def members(spark, sf):
    return cut(dedup.cluster_tracks(dedup.located(positions(spark, sf)), CFG))


@shared
def defects(spark, sf):
    return cut(dedup.number_defects(cut(dedup.roll_up(members(spark, sf), CFG))))


@shared
def chain(spark, sf):
    return cut(temporal.chainage(view(spark, sf, "v_gps").select(*temporal.TRACE), CFG))


# oracle building blocks --------------------------------------------------------------

cte("o_edge", """SELECT survey_id, seq, timestamp_s, lat, lon, lag(timestamp_s) OVER w AS p_t, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon
FROM v_gps WINDOW w AS (PARTITION BY survey_id ORDER BY seq)""")
cte("o_step", f"SELECT *, coalesce({hav('p_lat', 'p_lon', 'lat', 'lon')}, 0e0) AS step_m FROM o_edge")
cte("o_chain", """SELECT *, sum(step_m) OVER (PARTITION BY survey_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum_m,
coalesce(timestamp_s-p_t > 5e0, false) AS is_gap FROM o_step""")
cte("o_obs", """SELECT *, (x2-x1)*(y2-y1) AS area, count(*) OVER t AS n_obs, max(confidence) OVER t AS max_confidence
FROM v_det WHERE track_id IS NOT NULL WINDOW t AS (PARTITION BY survey_id, track_id)""")
cte("o_rep", """SELECT * EXCLUDE (rn), frame_idx/5e0 AS t FROM (SELECT *, row_number() OVER (PARTITION BY survey_id, track_id
ORDER BY y2 DESC, area DESC, confidence DESC, frame_idx, x1 DESC) AS rn FROM o_obs) WHERE rn=1 AND n_obs>=3""")
cte("o_hit", """SELECT r.survey_id, r.track_id, r.t, e.seq, e.p_t, e.timestamp_s, e.p_lat, e.p_lon, e.lat, e.lon,
row_number() OVER (PARTITION BY r.survey_id, r.track_id ORDER BY e.seq) AS rn
FROM o_rep r JOIN o_edge e ON r.survey_id=e.survey_id AND r.t BETWEEN e.p_t AND e.timestamp_s""")
cte("o_pos", """SELECT r.*, CASE WHEN h.timestamp_s-h.p_t<=5e0 THEN CASE WHEN h.timestamp_s=h.p_t THEN h.p_lat ELSE h.p_lat+(h.t-h.p_t)/(h.timestamp_s-h.p_t)*(h.lat-h.p_lat) END END AS lat,
CASE WHEN h.timestamp_s-h.p_t<=5e0 THEN CASE WHEN h.timestamp_s=h.p_t THEN h.p_lon ELSE h.p_lon+(h.t-h.p_t)/(h.timestamp_s-h.p_t)*(h.lon-h.p_lon) END END AS lon
FROM o_rep r LEFT JOIN o_hit h ON r.survey_id=h.survey_id AND r.track_id=h.track_id AND h.rn=1""")
cte("o_loc", "SELECT * FROM o_pos WHERE lat IS NOT NULL")
cte("o_link", f"""SELECT a.survey_id, a.track_id AS a, b.track_id AS b FROM o_loc a JOIN o_loc b
ON a.survey_id=b.survey_id AND a.class_name=b.class_name AND a.track_id<>b.track_id AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}<=5e0""")
cte("o_reach", """SELECT survey_id, track_id AS node, track_id AS root FROM o_loc
UNION SELECT l.survey_id, l.b, r.root FROM o_reach r JOIN o_link l ON l.survey_id=r.survey_id AND l.a=r.node""", recursive=True)
cte("o_member", """SELECT l.*, c.component FROM o_loc l JOIN (SELECT survey_id, node, min(root) AS component FROM o_reach GROUP BY ALL) c
ON l.survey_id=c.survey_id AND l.track_id=c.node""")
cte("o_best", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY survey_id, component ORDER BY area DESC, track_id) AS rn,
max(max_confidence) OVER c AS conf, count(*) OVER c AS n_tracks, max(track_id) OVER c AS last_track FROM o_member WINDOW c AS (PARTITION BY survey_id, component)) WHERE rn=1""")
cte("o_defect", """SELECT survey_id, CAST(row_number() OVER (PARTITION BY survey_id ORDER BY component) AS BIGINT) AS defect_id, class_name, component,
lat, lon, x1, y1, x2, y2, frame_w, frame_h, conf AS confidence, n_tracks, component AS first_track, last_track, area AS area_px,
greatest(0e0, least(frame_w, x2)-greatest(0e0,x1))*greatest(0e0, least(frame_h,y2)-greatest(frame_h*5e-1,y1))/(frame_w*(frame_h-frame_h*5e-1)) AS area_ratio FROM o_best""")
cte("o_def", """SELECT *, CASE WHEN area_ratio<2e-2 THEN 'Low' WHEN area_ratio<8e-2 THEN 'Medium' ELSE 'High' END AS severity FROM o_defect""")


# GPS ---------------------------------------------------------------------------------


@query("f01_accuracy_filter", "SELECT survey_id, seq, timestamp_s, accuracy_m FROM v_gps WHERE accuracy_m IS NULL OR accuracy_m <= 8e0")
def f01(spark, sf):
    return temporal.accuracy_filter(view(spark, sf, "v_gps"), 8.0).select("survey_id", "seq", "timestamp_s", "accuracy_m")


@query("w03_chainage", "SELECT survey_id, seq, round(step_m,4) AS step_m, round(cum_m,4) AS cum_m, is_gap FROM o_chain")
def w03(spark, sf):
    c = temporal.chainage(view(spark, sf, "v_gps"), CFG)
    return c.select("survey_id", "seq", met("step_m"), met("cum_m"), "is_gap")


@query("a08_route_length", "SELECT survey_id, round(sum(step_m)/1e3,6) AS route_km FROM o_step GROUP BY survey_id")
def a08(spark, sf):
    return temporal.route_length_km(view(spark, sf, "v_gps")).select("survey_id", deg("route_km"))


@query("g01_haversine", f"SELECT survey_id, seq, round({hav('lat', 'lon', '13e0', '80e0')},4) AS dist_m FROM v_gps")
def g01(spark, sf):
    d = geo.haversine_m("lat", "lon", "13D", "80D")
    return view(spark, sf, "v_gps").select("survey_id", "seq", met(d, "dist_m"))


@query("g02_project", """SELECT g.survey_id, seq, round(6371000e0*radians(lon-clon)*cos(radians(clat)),3) AS x_m, round(6371000e0*radians(lat-clat),3) AS y_m
FROM v_gps g JOIN (SELECT survey_id, (min(lat)+max(lat))/2e0 AS clat, (min(lon)+max(lon))/2e0 AS clon FROM v_gps GROUP BY survey_id) c ON g.survey_id=c.survey_id""")
def g02(spark, sf):
    g = view(spark, sf, "v_gps")
    centre = g.groupBy("survey_id").agg(
        ((F.min("lat") + F.max("lat")) / 2.0).alias("clat"), ((F.min("lon") + F.max("lon")) / 2.0).alias("clon")
    )
    x, y = geo.project_x_m(F.col("lon"), F.col("clat"), F.col("clon")), geo.project_y_m(F.col("lat"), F.col("clat"))
    return g.join(centre, "survey_id").select("survey_id", "seq", F.round(x, 3).alias("x_m"), F.round(y, 3).alias("y_m"))


BEARING = """((degrees(atan2(sin(radians(lon-p_lon))*cos(radians(lat)), cos(radians(p_lat))*sin(radians(lat))-sin(radians(p_lat))*cos(radians(lat))*cos(radians(lon-p_lon))))+360e0)%360e0)"""
cte("o_bearing", f"SELECT *, {BEARING} AS bearing FROM o_edge WHERE p_t IS NOT NULL")


@query("g03_bearing", "SELECT survey_id, seq, round(bearing,4) AS bearing FROM o_bearing")
def g03(spark, sf):
    e = temporal.edges(view(spark, sf, "v_gps")).filter("p_lat is not null")
    b = geo.bearing_deg(*[F.col(c) for c in ("p_lat", "p_lon", "lat", "lon")])
    return e.select("survey_id", "seq", met(b, "bearing"))


@query("g04_shift", """SELECT survey_id, seq, round(degrees(p2),6) AS lat, round(degrees(radians(lon)+atan2(sin(radians(bearing))*sin(d)*cos(radians(lat)), cos(d)-sin(radians(lat))*sin(p2))),6) AS lon
FROM (SELECT *, asin(sin(radians(lat))*cos(d)+cos(radians(lat))*sin(d)*cos(radians(bearing))) AS p2 FROM (SELECT *, 12e0/6371000e0 AS d FROM o_bearing))""")
def g04(spark, sf):
    e = temporal.edges(view(spark, sf, "v_gps")).filter("p_lat is not null")
    e = e.withColumn("b", geo.bearing_deg(*[F.col(c) for c in ("p_lat", "p_lon", "lat", "lon")]))
    ahead = F.lit(12.0)
    lat = geo.shifted_lat(F.col("lat"), F.col("b"), ahead)
    lon = geo.shifted_lon(F.col("lat"), F.col("lon"), F.col("b"), ahead)
    return e.select("survey_id", "seq", deg(lat, "lat"), deg(lon, "lon"))


@query("g05_point_to_edge", """SELECT survey_id, seq, round(t,6) AS t, round(sqrt(pow(px-(ax+t*(bx-ax)),2e0)+pow(py-(ay+t*(b_y-ay)),2e0)),4) AS dist_m FROM (
SELECT *, CASE WHEN l2=0e0 THEN 0e0 ELSE greatest(0e0,least(1e0,((px-ax)*(bx-ax)+(py-ay)*(b_y-ay))/l2)) END AS t FROM (
SELECT *, (bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay) AS l2 FROM (
SELECT survey_id, seq, 0e0 AS ax, 0e0 AS ay, (lon-p_lon)*111139e0 AS bx, (lat-p_lat)*111139e0 AS b_y, accuracy_m AS px, speed_mps AS py FROM
(SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM v_gps WINDOW w AS (PARTITION BY survey_id ORDER BY seq)) WHERE p_lat IS NOT NULL)))""")
def g05(spark, sf):
    g = view(spark, sf, "v_gps")
    e = temporal.edges(g).filter("p_lat is not null").select(
        "survey_id", "seq", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"),
        ((F.col("lon") - F.col("p_lon")) * 111139.0).alias("bx"), ((F.col("lat") - F.col("p_lat")) * 111139.0).alias("by"),
        F.col("accuracy_m").alias("px"), F.col("speed_mps").alias("py"),
    )
    args = [F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")]
    return e.select("survey_id", "seq", deg(geo.edge_fraction(*args), "t"), met(geo.edge_distance(*args), "dist_m"))


# detections and tracks ---------------------------------------------------------------


@query("f02_frame_stride", "SELECT survey_id, frame_idx, count(*) AS n FROM v_det WHERE frame_idx%3=0 GROUP BY ALL")
def f02(spark, sf):
    return tracks.strided(view(spark, sf, "v_det"), 3).groupBy("survey_id", "frame_idx").agg(F.count("*").alias("n"))


@query("f03_tracked_only", "SELECT survey_id, class_name, count(*) AS n, count(track_id) AS n_tracked FROM v_det WHERE track_id IS NOT NULL GROUP BY ALL")
def f03(spark, sf):
    return tracks.tracked(view(spark, sf, "v_det")).groupBy("survey_id", "class_name").agg(
        F.count("*").alias("n"), F.count("track_id").alias("n_tracked")
    )


@query("f07_near_zone_ratio", """SELECT survey_id, track_id, frame_idx, x1, y1, round(greatest(0e0, least(frame_w, x2)-greatest(0e0,x1))*greatest(0e0, least(frame_h,y2)-greatest(frame_h*5e-1,y1))/(frame_w*(frame_h-frame_h*5e-1)),10) AS area_ratio FROM v_det""")
def f07(spark, sf):
    return tracks.with_severity(view(spark, sf, "v_det")).select(*KEYS, "frame_idx", "x1", "y1", ratio("area_ratio"))


@query("f08_severity", """SELECT survey_id, severity, count(*) AS n FROM (SELECT survey_id, CASE WHEN r<2e-2 THEN 'Low' WHEN r<8e-2 THEN 'Medium' ELSE 'High' END AS severity FROM (
SELECT survey_id, greatest(0e0, least(frame_w, x2)-greatest(0e0,x1))*greatest(0e0, least(frame_h,y2)-greatest(frame_h*5e-1,y1))/(frame_w*(frame_h-frame_h*5e-1)) AS r FROM v_det)) GROUP BY ALL""")
def f08(spark, sf):
    return tracks.with_severity(view(spark, sf, "v_det")).groupBy("survey_id", "severity").agg(F.count("*").alias("n"))


@query("g13_frame_time", "SELECT survey_id, frame_idx, round(CASE WHEN fps>0 THEN frame_idx/fps ELSE frame_idx/3e1 END + 15e-1*survey_id,6) AS t FROM (SELECT DISTINCT survey_id, frame_idx, CAST(survey_id-3 AS DOUBLE) AS fps FROM v_det)")
def g13(spark, sf):
    d = view(spark, sf, "v_det").select("survey_id", "frame_idx").distinct()
    t = text.frame_time(F.col("frame_idx"), (F.col("survey_id") - 3).cast("double"), 1.5 * F.col("survey_id"))
    return d.select("survey_id", "frame_idx", deg(t, "t"))


@query("a01_track_assembly", "SELECT survey_id, track_id, count(*) AS n_obs, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, round(max(confidence),6) AS max_confidence FROM v_det WHERE track_id IS NOT NULL GROUP BY ALL HAVING count(*)>=3")
def a01(spark, sf):
    return tracks.assemble(view(spark, sf, "v_det"), CFG).withColumn("max_confidence", deg("max_confidence"))


@query("w01_closest_approach", "SELECT survey_id, track_id, n_obs, frame_idx, class_name, x1, y1, x2, y2, round(confidence,6) AS confidence FROM o_rep")
def w01(spark, sf):
    r = tracks.closest_approach(view(spark, sf, "v_det"), CFG)
    return r.select(*KEYS, "n_obs", "frame_idx", "class_name", "x1", "y1", "x2", "y2", deg("confidence"))


@query("j01_gps_interpolation", "SELECT survey_id, track_id, round(t,4) AS t, round(lat,6) AS lat, round(lon,6) AS lon FROM o_pos")
def j01(spark, sf):
    p = dedup.locate(view(spark, sf, "v_det"), view(spark, sf, "v_gps"), CFG)
    return p.select(*KEYS, met("t"), deg("lat"), deg("lon"))


@query("u02_unlocated_tracks", "SELECT survey_id, track_id, n_obs FROM o_pos WHERE lat IS NULL")
def u02(spark, sf):
    p = positions(spark, sf)
    return dedup.unlocated(p, dedup.located(p)).select(*KEYS, "n_obs")


@query("j02_radius_links", "SELECT l.survey_id, l.track_id, l.class_name, k.a IS NOT NULL AS linked FROM o_loc l LEFT JOIN (SELECT DISTINCT survey_id, a FROM o_link) k ON l.survey_id=k.survey_id AND l.track_id=k.a")
def j02(spark, sf):
    found = dedup.located(positions(spark, sf))
    return components.linked_flags(found, CFG.merge_radius_m, ["survey_id", "class_name"], "track_id").select(
        *KEYS, "class_name", "linked"
    )


@query("c01_components", "SELECT survey_id, track_id, component FROM o_member")
def c01(spark, sf):
    return dedup.cluster_tracks(dedup.located(positions(spark, sf)), CFG).select(*KEYS, "component")


@query("a02_cluster_rollup", "SELECT survey_id, component, class_name, n_tracks, first_track, last_track, round(confidence,6) AS confidence, round(area_px,4) AS area_px, severity, round(lat,6) AS lat, round(lon,6) AS lon FROM o_def")
def a02(spark, sf):
    return dedup.roll_up(members(spark, sf), CFG).select(
        "survey_id", "component", "class_name", "n_tracks", "first_track", "last_track",
        deg("confidence"), met("area_px"), "severity", deg("lat"), deg("lon"),
    )


@query("w02_defect_ids", "SELECT survey_id, component, defect_id FROM o_def")
def w02(spark, sf):
    return dedup.number_defects(dedup.roll_up(members(spark, sf), CFG)).select("survey_id", "component", "defect_id")


@query("c04_dedup_tracks", "SELECT survey_id, defect_id, class_name, n_tracks, round(lat,6) AS lat, round(lon,6) AS lon, severity, round(area_px,4) AS area_px, round(confidence,6) AS confidence FROM o_def")
def c04(spark, sf):
    d, _, _ = dedup.deduplicate(view(spark, sf, "v_det"), view(spark, sf, "v_gps"), CFG)
    return d.select(
        "survey_id", "defect_id", "class_name", "n_tracks", deg("lat"), deg("lon"), "severity", met("area_px"), deg("confidence")
    )


@query("c04_defect_tracks", "SELECT m.survey_id, d.defect_id, m.track_id, m.frame_idx, m.class_name FROM o_member m JOIN o_def d ON d.survey_id=m.survey_id AND d.component=m.component")
def c04_tracks(spark, sf):
    found = dedup.defect_tracks(defects(spark, sf), members(spark, sf))
    return found.select("survey_id", "defect_id", "track_id", "frame_idx", "class_name")


@query("a02_defect_boxes", "SELECT survey_id, defect_id, x1, y1, x2, y2, frame_w, frame_h FROM o_def")
def a02_boxes(spark, sf):
    return defects(spark, sf).select("survey_id", "defect_id", "x1", "y1", "x2", "y2", "frame_w", "frame_h")


CLOCK = "SELECT DISTINCT survey_id, CASE survey_id%3 WHEN 0 THEN 7e0 WHEN 1 THEN 11e0 ELSE 0e0 END AS fps, 12345678e-7*(survey_id+1) AS offset_s FROM v_det WHERE survey_id<>7"
cte("o_clocked", f"SELECT r.* EXCLUDE (t), r.frame_idx/CASE WHEN fps IS NULL THEN 5e0 WHEN fps>0 THEN fps ELSE 3e1 END+coalesce(offset_s,0e0) AS t FROM o_rep r LEFT JOIN ({CLOCK}) c USING (survey_id)")
cte("o_clock_hit", """SELECT r.survey_id, r.track_id, r.t, e.p_t, e.timestamp_s, e.p_lat, e.p_lon, e.lat, e.lon, row_number() OVER (PARTITION BY r.survey_id, r.track_id ORDER BY e.seq) AS rn
FROM o_clocked r JOIN o_edge e ON r.survey_id=e.survey_id AND r.t BETWEEN e.p_t AND e.timestamp_s""")


@query("g13_survey_clocks", """SELECT r.survey_id, r.track_id, round(r.t,6) AS t, round(CASE WHEN h.timestamp_s-h.p_t<=5e0 THEN CASE WHEN h.timestamp_s=h.p_t THEN h.p_lat ELSE h.p_lat+(h.t-h.p_t)/(h.timestamp_s-h.p_t)*(h.lat-h.p_lat) END END,6) AS lat,
round(CASE WHEN h.timestamp_s-h.p_t<=5e0 THEN CASE WHEN h.timestamp_s=h.p_t THEN h.p_lon ELSE h.p_lon+(h.t-h.p_t)/(h.timestamp_s-h.p_t)*(h.lon-h.p_lon) END END,6) AS lon
FROM o_clocked r LEFT JOIN o_clock_hit h ON h.survey_id=r.survey_id AND h.track_id=r.track_id AND h.rn=1""")
def g13_clocks(spark, sf):
    """Tracks located with a frame rate and clock offset per survey; one survey has none given."""
    det = view(spark, sf, "v_det")
    clocks = spark.sql(CLOCK.replace("v_det", "{det}"), det=det)
    found = dedup.locate(det, view(spark, sf, "v_gps"), CFG, clocks)
    return found.select("survey_id", "track_id", deg("t"), deg("lat"), deg("lon"))


@query("a18_dedup_reduction", """SELECT survey_id, n_before, n_after, round((n_before-n_after)*1e2/n_before,4) AS reduction_pct FROM
(SELECT survey_id, count(*) AS n_before FROM o_loc GROUP BY survey_id) JOIN (SELECT survey_id, count(*) AS n_after FROM o_def GROUP BY survey_id) USING (survey_id)""")
def a18(spark, sf):
    before = members(spark, sf).groupBy("survey_id").agg(F.count("*").alias("n_before"))
    after = defects(spark, sf).groupBy("survey_id").agg(F.count("*").alias("n_after"))
    return before.join(after, "survey_id").withColumn(
        "reduction_pct", F.round(dedup.reduction_pct(F.col("n_before"), F.col("n_after")), 4)
    )


# boxes -------------------------------------------------------------------------------


@query("a04_summed_area", "SELECT survey_id, frame_idx, round(sum(greatest(0e0,x2-x1)*greatest(0e0,y2-y1)),4) AS sum_px, round(least(1e0, sum(greatest(0e0,x2-x1)*greatest(0e0,y2-y1))/(1920e0*1080e0)),10) AS capped_index FROM v_det GROUP BY ALL")
def a04(spark, sf):
    s = areas.summed_area(view(spark, sf, "v_det"), ["survey_id", "frame_idx"])
    return s.select(
        "survey_id", "frame_idx", met("sum_px"), F.round(F.least(F.lit(1.0), F.col("sum_px") / (1920.0 * 1080.0)), 10).alias("capped_index")
    )


def union_ctes(prefix: str, source: str, keys: str) -> None:
    """Union area by vertical strips for ``source`` (keys, x1..y2, frame_w, frame_h)."""
    k = keys.split(", ")
    using = f"USING ({keys})"
    cte(f"{prefix}_px", f"""SELECT {keys}, greatest(0,CAST(trunc(x1) AS BIGINT)) AS bx1, greatest(0,CAST(trunc(y1) AS BIGINT)) AS by1,
least(frame_w,CAST(trunc(x2) AS BIGINT)) AS bx2, least(frame_h,CAST(trunc(y2) AS BIGINT)) AS by2 FROM {source}""")
    cte(f"{prefix}_ok", f"SELECT DISTINCT * FROM {prefix}_px WHERE bx1<bx2 AND by1<by2")
    cte(f"{prefix}_cut", f"SELECT DISTINCT {keys}, sx FROM (SELECT {keys}, bx1 AS sx FROM {prefix}_ok UNION ALL SELECT {keys}, bx2 FROM {prefix}_ok)")
    cte(f"{prefix}_strip", f"SELECT {keys}, sx, lead(sx) OVER (PARTITION BY {keys} ORDER BY sx)-sx AS sw FROM {prefix}_cut")
    cte(f"{prefix}_run", f"""SELECT {keys}, sw, by1, by2, coalesce(max(by2) OVER (PARTITION BY {keys}, sx ORDER BY by1, by2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS pv
FROM {prefix}_ok JOIN {prefix}_strip {using} WHERE sx>=bx1 AND sx<bx2""")
    cte(f"{prefix}_union", f"SELECT {keys}, CAST(sum(sw*greatest(0,by2-greatest(by1,pv))) AS BIGINT) AS union_px FROM {prefix}_run GROUP BY ALL")
    assert k


union_ctes("o_fr", "v_det", "survey_id, frame_idx")


@query("a03_union_area", "SELECT survey_id, frame_idx, union_px FROM o_fr_union")
def a03(spark, sf):
    return areas.union_area(view(spark, sf, "v_det"), ["survey_id", "frame_idx"])


@query("f21_damage_index", "SELECT survey_id, frame_idx, coalesce(union_px,0) AS union_px, round(coalesce(union_px,0)/(1920e0*540e0),10) AS damage_index FROM (SELECT DISTINCT survey_id, frame_idx FROM v_det) LEFT JOIN o_fr_union USING (survey_id, frame_idx)")
def f21(spark, sf):
    d = areas.damage_index(view(spark, sf, "v_det"), ["survey_id", "frame_idx"], near_zone_top=0.5)
    return d.select("survey_id", "frame_idx", "union_px", ratio("damage_index"))


@query("f09_condition", "SELECT survey_id, frame_idx, CASE WHEN i<5e-2 THEN 'Good' WHEN i<15e-2 THEN 'Fair' ELSE 'Poor' END AS condition FROM (SELECT survey_id, frame_idx, coalesce(union_px,0)/(1920e0*1080e0) AS i FROM (SELECT DISTINCT survey_id, frame_idx FROM v_det) LEFT JOIN o_fr_union USING (survey_id, frame_idx))")
def f09(spark, sf):
    d = areas.damage_index(view(spark, sf, "v_det"), ["survey_id", "frame_idx"])
    return d.select("survey_id", "frame_idx", boxes.condition(F.col("damage_index")).alias("condition"))
