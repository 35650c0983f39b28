"""Queries that land the tables as files and read them back through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.operators import metrics
from roadloom.plans.corpus import f12_origins, label_rows, split_manifest
from roadloom.plans.fixtures import view
from roadloom.plans.process import load_surveys
from roadloom.plans.registry import cte, query
from roadloom.plans.roads import queue, segment_table, surveys
from roadloom.plans.telemetry import CFG, deg, defects
from roadloom.session import cut, landing_path
from roadloom.sources import intake, readers
from roadloom.sources.landing import land_files
from roadloom.sources.store import SurveyStore, export_queue, write_csv, write_report
from roadloom.streaming import tracks as live

START = 1_704_067_200


def landed_gps(spark, sf) -> str:
    """Every second time as ISO text, every seventh accuracy empty, every thirteenth row broken."""
    path = landing_path(spark, "gps")
    g = view(spark, sf, "v_gps")
    t = F.col("timestamp_s") + START
    iso = F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stamp = F.when(F.col("seq") % 13 == 0, F.lit("yesterday")).when(F.col("seq") % 2 == 0, iso).otherwise(t.cast("string"))
    rows = g.select(
        "survey_id", "seq", stamp.alias("timestamp"), "lat", "lon",
        F.when(F.col("seq") % 7 != 0, F.col("accuracy_m").cast("string")).alias("accuracy_m"), F.col("speed_mps").alias("speed"),
    )
    write_csv(rows, path)
    return path


GPS_COLUMNS = ["survey_id", "seq", "timestamp", "lat", "lon", "accuracy_m", "speed"]


@query("s01_gps_csv", "SELECT survey_id, seq, timestamp_s+1704067200e0 AS timestamp_s, round(lat,6) AS lat, round(lon,6) AS lon, CASE WHEN seq%7<>0 THEN accuracy_m END AS accuracy_m, speed_mps FROM v_gps WHERE seq%13<>0")
def s01(spark, sf):
    points, _ = readers.gps_csv(spark, landed_gps(spark, sf), GPS_COLUMNS)
    return points.select(
        F.col("survey_id").cast("bigint").alias("survey_id"), F.col("seq").cast("bigint").alias("seq"),
        "timestamp_s", deg("lat"), deg("lon"), "accuracy_m", "speed_mps",
    )


@query("s01_malformed_rows", "SELECT CAST(count_if(seq%13=0) AS BIGINT) AS malformed FROM v_gps")
def s01_malformed(spark, sf):
    return readers.gps_csv(spark, landed_gps(spark, sf), GPS_COLUMNS)[1]


@query("s02_gpx", """SELECT survey_id, CAST(row_number() OVER (PARTITION BY survey_id ORDER BY seq) AS BIGINT)-1 AS seq, timestamp_s+1704067200e0 AS timestamp_s, round(lat,6) AS lat, round(lon,6) AS lon, CAST(NULL AS DOUBLE) AS accuracy_m FROM v_gps WHERE seq%11<>0""")
def s02(spark, sf):
    """Track points in the order of their survey's files; the number of a survey is in the path."""
    path = landing_path(spark, "gpx")
    iso = F.date_format(F.timestamp_seconds(F.col("timestamp_s") + START), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = view(spark, sf, "v_gps").orderBy("survey_id", "seq").select(
        F.col("survey_id").alias("folder"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.when(F.col("seq") % 11 != 0, iso).alias("time")
    )
    rows.write.partitionBy("folder").format("xml").option("rootTag", "trkseg").option("rowTag", "trkpt").save(path)
    points, _ = readers.gps_gpx(spark, path, r"/folder=(\d+)/")
    return points.select("survey_id", "seq", "timestamp_s", deg("lat"), deg("lon"), "accuracy_m")


def landed_elements(spark, sf) -> str:
    """Raw map elements, one document per line: ways with their vertices, and nodes."""
    path = landing_path(spark, "osm")
    v = view(spark, sf, "v_road_vertex")
    ways = v.groupBy("way_pos", "highway").agg(
        F.array_sort(F.collect_list(F.struct("vertex_pos", "lat", "lon"))).alias("g")
    ).select(
        F.struct(
            F.lit("way").alias("type"), F.col("way_pos").alias("id"), F.create_map(F.lit("highway"), F.col("highway")).alias("tags"),
            F.transform("g", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("geometry"),
        ).alias("e")
    ).select(F.to_json(F.struct(F.array("e").alias("elements"))).alias("value"))
    nodes = view(spark, sf, "v_amenity").select(
        F.struct(
            F.lit("node").alias("type"), F.col("amenity_id").alias("id"), "lat", "lon",
            F.create_map(F.lit("amenity"), F.col("amenity")).alias("tags"),
        ).alias("e")
    ).select(F.to_json(F.struct(F.array("e").alias("elements"))).alias("value"))
    ways.union(nodes).write.text(path)
    return path


@query("s03_osm_cache", """SELECT 'vertex' AS kind, dense_rank() OVER (ORDER BY way_pos)-1 AS item_pos, highway AS label, vertex_pos, round(lat,6) AS lat, round(lon,6) AS lon FROM v_road_vertex
UNION ALL SELECT 'amenity', row_number() OVER (ORDER BY amenity_id)-1, amenity, CAST(NULL AS BIGINT), round(lat,6), round(lon,6) FROM v_amenity""")
def s03(spark, sf):
    raw = readers.raw_osm(spark, landed_elements(spark, sf), multi_line=False)
    highways, amenities = readers.osm_elements(raw)
    path = landing_path(spark, "osmcache")
    h = highways.orderBy("id").select(F.to_json(F.struct(F.array(F.struct("tags", "geometry")).alias("highways"))).alias("value"))
    a = amenities.orderBy("id").select(F.to_json(F.struct(F.array(F.struct("tags", "lat", "lon")).alias("amenities"))).alias("value"))
    h.union(a).write.text(path)
    vertices, places = readers.osm_cache(spark, path, multi_line=False)
    none = F.lit(None).cast("bigint")
    return vertices.select(
        F.lit("vertex").alias("kind"), F.col("way_pos").alias("item_pos"), F.col("highway").alias("label"), "vertex_pos", deg("lat"), deg("lon")
    ).unionByName(
        places.select(F.lit("amenity").alias("kind"), F.col("amenity_id").alias("item_pos"), F.col("amenity").alias("label"), none.alias("vertex_pos"), deg("lat"), deg("lon"))
    )


@query("s04_osm_elements", "SELECT 'way' AS kind, way_pos AS id, highway AS label, count(*) AS n_points FROM v_road_vertex GROUP BY ALL UNION ALL SELECT 'node', amenity_id, amenity, CAST(1 AS BIGINT) FROM v_amenity")
def s04(spark, sf):
    highways, amenities = readers.osm_elements(readers.raw_osm(spark, landed_elements(spark, sf), multi_line=False))
    h = highways.select(F.lit("way").alias("kind"), "id", F.col("tags")["highway"].alias("label"), F.size("geometry").cast("bigint").alias("n_points"))
    a = amenities.select(F.lit("node").alias("kind"), "id", F.col("tags")["amenity"].alias("label"), F.lit(1).cast("bigint").alias("n_points"))
    return h.unionByName(a)


@query("s05_defect_list", "SELECT defect_id, class_name, round(lat,6) AS lat, round(lon,6) AS lon, CASE WHEN defect_id%2=0 THEN 'High' ELSE 'Low' END AS severity FROM v_new")
def s05(spark, sf):
    path = landing_path(spark, "defects")
    note = F.when(F.col("defect_id") % 2 == 0, "High").otherwise("Low")
    write_csv(view(spark, sf, "v_new").withColumn("severity_note", note), path)
    return readers.defects_csv(spark, path).select("defect_id", "class_name", deg("lat"), deg("lon"), "severity")


@query("s05_defect_json", "SELECT defect_id, class_name, round(lat,6) AS lat, round(lon,6) AS lon, CASE WHEN defect_id%2=0 THEN 'High' ELSE 'Low' END AS severity, (SELECT 7+max(defect_id)%50 FROM v_new) AS pre_dedup FROM v_new")
def s05_json(spark, sf):
    """Many files: lists of defects, and objects with a list and the number before deduplication."""
    d = view(spark, sf, "v_new")
    top = d.agg(F.max("defect_id")).scalar()
    item = F.struct("defect_id", F.when(F.col("defect_id") % 3 == 0, F.col("class_name")).alias("class"), F.when(F.col("defect_id") % 3 != 0, F.col("class_name")).alias("class_name"),
                    "lat", "lon", F.when(F.col("defect_id") % 2 == 0, F.lit("High")).alias("severity"))
    files = d.groupBy((F.col("defect_id") % 50).alias("f")).agg(F.collect_list(item).alias("l")).select(
        F.concat(F.lit("d"), F.col("f").cast("string"), F.lit(".json")).alias("rel_path"),
        F.when(F.col("f") == top % 50, F.to_json(F.struct(F.col("l").alias("defects"), (F.col("f") + 7).alias("pre_dedup_detections")))).otherwise(F.to_json("l")).alias("content"),
    )
    rows, before = readers.defects_json(spark, land_texts(files, "defects"))
    return rows.select("defect_id", "class_name", deg("lat"), deg("lon"), "severity", before.scalar().alias("pre_dedup"))


@query("s06_repair_manifest", "SELECT defect_id, status, CASE WHEN defect_id%3=0 THEN 0e0 ELSE round(lat,6) END AS lat, round(lon,6) AS lon FROM v_old")
def s06(spark, sf):
    path = landing_path(spark, "manifest")
    old = view(spark, sf, "v_old")
    write_csv(
        old.select(
            "defect_id", F.concat(F.lit("  "), "status", F.lit(" ")).alias("actual_status"),
            F.when(F.col("defect_id") % 3 != 0, F.col("lat")).alias("lat"), "lon",
        ),
        path,
    )
    return readers.repair_manifest(spark, path).select("defect_id", "status", deg("lat"), deg("lon"))


@query("s07_score_sheets", "SELECT CAST(count_if(automated_time_s>0) AS BIGINT) AS n_runs, round(avg(route_distance_km/(automated_time_s/36e2)),6) AS auto_kmh, round(avg(CASE WHEN manual_time_s>0 THEN route_distance_km/(manual_time_s/36e2) END),6) AS manual_kmh, 'rater_1,rater_2' AS raters FROM v_timing")
def s07(spark, sf):
    sheet, times = landing_path(spark, "ratings"), landing_path(spark, "timing")
    r = view(spark, sf, "v_rating")
    write_csv(r.select("crop_id", "filename", "system_severity", "rater_1", "rater_2", F.lit("").alias("rater_3")), sheet)
    write_csv(
        view(spark, sf, "v_timing").withColumnsRenamed(
            {"automated_time_s": "automated_duration_s", "manual_time_s": "manual_duration_s", "latency_s": "detection_to_ticket_s"}
        ),
        times,
    )
    _, raters = readers.ratings_csv(spark, sheet)
    t = metrics.throughput(readers.timings_csv(spark, times))
    return t.select("n_runs", deg("auto_kmh"), deg("manual_kmh"), F.lit(",".join(raters)).alias("raters"))


def land_texts(texts, name):
    """Lands one file per row (rel_path, content) and returns their folder."""
    path = landing_path(texts.sparkSession, name)
    land_files(texts, path)
    return path


@query("s08_label_text", "SELECT replace(image,'.jpg','.txt') AS file, box_idx, raw_id, cx, cy, w, h FROM v_label_box WHERE raw_id IS NOT NULL")
def s08(spark, sf):
    """Label files, one per image, with blank lines in between, written and read again."""
    rows = label_rows(spark, sf).filter("raw_id is not null")
    line = F.concat_ws(" ", "raw_id", "cx", "cy", "w", "h")
    texts = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("box_idx", line.alias("l")))).alias("f")).select(
        F.concat(F.col("image").substr(F.lit(1), F.instr("image", "_") - 1), F.lit("/"), F.replace("image", F.lit(".jpg"), F.lit(".txt"))).alias("rel_path"),
        F.array_join(F.transform("f", lambda x: x["l"]), "\n\n").alias("content"),
    )
    return readers.yolo_labels(spark, land_texts(texts, "labels"))


@query("s09_file_inventory", "SELECT 'texts/'||coalesce(source,'none')||'/d'||doc_id||CASE doc_id%3 WHEN 0 THEN '.TXT' ELSE '.md' END AS rel_path, CASE doc_id%3 WHEN 0 THEN '.txt' ELSE '.md' END AS ext, CAST(octet_length(encode(coalesce(text,''))) AS BIGINT) AS length, true AS dated FROM documents WHERE doc_id%3<2")
def s09(spark, sf):
    """The texts as files: two extensions of three are asked for; every name, length and time is returned."""
    ext = F.element_at(F.array(F.lit(".TXT"), F.lit(".md"), F.lit(".log")), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.concat(F.lit("texts/"), F.coalesce("source", F.lit("none")), F.lit("/d"), F.col("doc_id").cast("string"), ext)
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(name.alias("rel_path"), F.coalesce("text", F.lit("")).alias("content"))
    files = readers.inventory(spark, land_texts(texts, "texts"), [".txt", ".md"])
    return files.select("rel_path", "ext", "length", (F.unix_timestamp("mtime") > START).alias("dated"))


UPLOAD = """SELECT c_custkey AS n, CASE c_custkey%8 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MKV' WHEN 2 THEN '.avi' WHEN 3 THEN '.csv' WHEN 4 THEN '.GPX' WHEN 5 THEN '.csv' WHEN 6 THEN '.exe' ELSE '' END AS ext,
CASE c_custkey%7 WHEN 0 THEN 'MZ' WHEN 1 THEN '<?xml' WHEN 2 THEN 'time,lat' WHEN 3 THEN '' WHEN 4 THEN 'ftyp' ELSE repeat('x',64)||',' END AS body FROM {customer}"""


@query("s14_landed_uploads", f"""SELECT 'u'||(n//100)||'/f'||n||ext AS rel_path, CAST(length(body) AS BIGINT) AS length, concat_ws(',', CASE WHEN lower(ext) NOT IN ('.mp4','.avi','.mkv','.csv','.gpx') THEN 'extension' END,
CASE WHEN lower(ext) IN ('.mp4','.avi','.mkv') AND body='MZ' THEN 'executable' END, CASE WHEN lower(ext) IN ('.csv','.gpx') AND NOT contains(substr(body,1,64),'xml') AND NOT contains(substr(body,1,64),',') THEN 'gps_content' END) AS reasons
FROM ({UPLOAD.replace("{customer}", "customer")})""")
def s14_landed(spark, sf):
    """Uploads in folders of a landing zone, checked by their names, sizes and heads."""
    rows = spark.sql(UPLOAD.replace("{customer}", f"parquet.`{sf}/customer.parquet`"))
    files = rows.select(F.expr("concat('u', n div 100, '/f', n, ext)").alias("rel_path"), F.col("body").alias("content"))
    return intake.check_landed_uploads(spark, land_texts(files, "uploads")).select("rel_path", "length", F.array_join("reasons", ",").alias("reasons"))


SHEET = """SELECT c_custkey div 50 AS f, c_custkey%50 AS k, c_custkey AS n, CASE WHEN c_custkey%50=17 THEN 'x7' WHEN c_custkey%50=21 THEN '-3' WHEN c_custkey%50 IN (30,33) THEN '5' ELSE CAST(c_custkey+10 AS VARCHAR(20)) END AS id,
CASE WHEN c_custkey%40=3 THEN 'rutting' ELSE 'pothole' END AS cls, CASE WHEN c_custkey%60=4 THEN '999.0' WHEN c_custkey%60=5 THEN 'north' ELSE '13.5' END AS lat, CASE WHEN c_custkey%70=6 THEN '-181' ELSE '80.2' END AS lon FROM {customer}"""

cte("sheet", SHEET.replace("{customer}", "customer").replace(" div ", "//"))


@query("f14_truth_file", f"""SELECT f, k+2 AS row_no, CASE WHEN n%11=6 THEN 'columns' ELSE concat_ws(',', CASE WHEN id='x7' THEN 'id_not_integer' WHEN id='-3' THEN 'id_not_positive' WHEN k=33 AND EXISTS (SELECT 1 FROM sheet o WHERE o.f=s.f AND o.k=30 AND o.n%11<>6 AND o.n%13<>7) THEN 'id_duplicate' END,
CASE WHEN cls<>'pothole' THEN 'class_unknown' END, CASE lat WHEN 'north' THEN 'lat_not_number' WHEN '999.0' THEN 'lat_range' END, CASE WHEN lon='-181' THEN 'lon_range' END) END AS errors
FROM sheet s WHERE f%7<>3 AND f%7<>5 AND n%13<>7 UNION ALL SELECT DISTINCT f, 1, 'header' FROM sheet WHERE f%7=3 UNION ALL SELECT DISTINCT f, 0, 'empty_file' FROM sheet WHERE f%7=5""")
def f14_file(spark, sf):
    """Sheets of 50 rows: some with a byte-order mark, a wrong header or nothing at all; short rows,
    blank rows, quoted notes over two lines, quotes inside a note."""
    rows = spark.sql(SHEET.replace("{customer}", f"parquet.`{sf}/customer.parquet`"))
    note = F.when(F.col("n") % 4 == 0, F.lit('"deep, wide\nnear ""kerb"""')).when(F.col("n") % 4 == 1, F.lit('5" wide')).otherwise(F.lit(""))
    line = F.when(F.col("n") % 13 == 7, F.element_at(F.array(F.lit(""), F.lit(" , ,,,")), (F.col("n") % 2 + 1).cast("int"))).when(
        F.col("n") % 11 == 6, F.concat_ws(",", "id", "cls", "lat")).otherwise(F.concat_ws(",", "id", F.concat(F.lit(" "), "cls"), "lat", "lon", note))
    sheets = rows.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))).alias("ls"))
    head = F.when(F.col("f") % 7 == 3, F.lit("id,class,lat,lon,note\n")).when(F.col("f") % 7 == 1, F.lit("\ufeffdefect_id,class,lat,lon,severity_note\r\n")).otherwise(F.lit("defect_id, class,lat,lon,severity_note\n"))
    body = F.when(F.col("f") % 7 == 5, F.lit("")).otherwise(F.concat(head, F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\n")))
    path = land_texts(sheets.select(F.concat(F.lit("s"), F.col("f").cast("string"), F.lit(".csv")).alias("rel_path"), body.alias("content")), "truth")
    found = intake.check_truth_files(spark, path, ["pothole"])
    return found.select(F.regexp_extract("file", "s([0-9]+)[.]csv$", 1).cast("bigint").alias("f"), "row_no", F.array_join("errors", ",").alias("errors"))


def filled_store(spark, sf) -> SurveyStore:
    store = SurveyStore(spark, landing_path(spark, "store"))
    s = surveys(spark, sf).select(
        "survey_id", F.to_date("surveyed_on").alias("surveyed_on"), F.lit("route").alias("route_name"), F.lit("video.mp4").alias("source")
    )
    store.add_surveys(s)
    store.add_defects(defects(spark, sf))
    store.add_segments(segment_table(spark, sf))
    return store


cte("o_stored", "SELECT *, CAST(row_number() OVER (ORDER BY survey_id, defect_id) AS BIGINT) AS stored_id FROM o_def")


@query("s10_append_store", "SELECT survey_id, stored_id AS defect_id, class_name, severity, round(lat,6) AS lat, round(lon,6) AS lon, 'New' AS status, CAST(trunc(area_px) AS BIGINT) AS area_px, x1 AS bbox_x1 FROM o_stored")
def s10(spark, sf):
    store = filled_store(spark, sf)
    return store.read("defects").select(
        "survey_id", "defect_id", "class_name", "severity", deg("lat"), deg("lon"), "status", "area_px", "bbox_x1"
    )


@query("s11_status_update", "SELECT survey_id, stored_id AS defect_id, CASE WHEN severity='High' THEN 'Repaired' ELSE 'New' END AS status, CASE WHEN severity='High' THEN stored_id+1 END AS matched_prev_id, severity='High' AS recurrence FROM o_stored")
def s11(spark, sf):
    store = filled_store(spark, sf)
    high = store.read("defects").filter("severity = 'High'").select(
        "survey_id", "defect_id", F.lit("Repaired").alias("status"), (F.col("defect_id") + 1).alias("matched_prev_id"),
        F.lit(True).alias("recurrence"), F.lit(False).alias("unverified"),
    )
    store.update_defects(high)
    store.set_survey_status(store.read("surveys").select("survey_id", F.lit("completed").alias("status")))
    return store.read("defects").select("survey_id", "defect_id", "status", "matched_prev_id", "recurrence")


@query("s12_queue_export", "SELECT survey_id, CAST(defect_id AS VARCHAR) AS defect_id, class_name AS class, severity, printf('%.2f', floor(priority*1e2+5e-1)/1e2) AS priority, printf('%.2f', estimated_cost) AS estimated_cost, 'New' AS status FROM o_queue")
def s12(spark, sf):
    path = landing_path(spark, "queue")
    export_queue(queue(spark, sf).withColumn("status", F.lit("New")), path)
    return readers.csv_strings(spark, path).withColumn("survey_id", F.col("survey_id").cast("bigint"))


@query("q05_from_files", """SELECT s.survey_id, s.stored_id AS defect_id, s.class_name, s.severity, round(q.priority,6) AS priority, round(s.lat,6) AS lat, round(s.lon,6) AS lon, 'completed' AS status
FROM o_stored s JOIN o_queue q USING (survey_id, defect_id)""")
def q05_files(spark, sf):
    """Plain GPS files, one folder per survey, through readers and processing into a store; the
    first load breaks off before it is complete, the second one replaces it."""
    traces = landing_path(spark, "traces")
    g = view(spark, sf, "v_gps").orderBy("survey_id", "seq").select(
        F.col("survey_id").alias("folder"), F.col("timestamp_s").alias("timestamp"), "lat", "lon", "accuracy_m", F.col("speed_mps").alias("speed")
    )
    g.write.option("header", True).partitionBy("folder").csv(traces)
    points, _ = readers.gps_csv(spark, traces, survey=r"/folder=(\d+)/")
    store = SurveyStore(spark, landing_path(spark, "store"))
    known = surveys(spark, sf).select(
        "survey_id", F.to_date("surveyed_on").alias("surveyed_on"), F.lit("route").alias("route_name"), F.lit("video.mp4").alias("source")
    )
    store.add_surveys(known)
    store.add_defects(defects(spark, sf).filter("survey_id % 2 = 0"))
    inputs = {
        "detections": view(spark, sf, "v_det"), "gps": cut(points.drop("folder")), "vertices": view(spark, sf, "v_road_vertex"),
        "amenities": view(spark, sf, "v_amenity"), "frame_w": 1920, "frame_h": 1080,
    }
    load_surveys(store, known, inputs, CFG)
    done = store.read("surveys").select("survey_id", "status")
    return store.read("defects").drop("status").join(done, "survey_id").select(
        "survey_id", "defect_id", "class_name", "severity", deg("priority"), deg("lat"), deg("lon"), "status"
    )


@query("s13_manifest_files", "SELECT image, grp, split, 'manifest' AS file FROM o_manifest UNION ALL SELECT image, CAST(box_idx AS VARCHAR), name, 'origins' FROM o_conv WHERE new_id=0")
def s13(spark, sf):
    m, o = landing_path(spark, "split"), landing_path(spark, "origins")
    write_csv(split_manifest(spark, sf), m)
    write_csv(f12_origins(spark, sf), o)
    a = readers.csv_strings(spark, m, ["image", "grp", "split"]).withColumn("file", F.lit("manifest"))
    b = readers.csv_strings(spark, o, ["image", "grp", "split"]).withColumn("file", F.lit("origins"))
    return a.unionByName(b)


@query("s13_report_files", "SELECT survey_id, severity, count(*) AS n, round(sum(estimated_cost),2) AS cost FROM o_queue GROUP BY survey_id, severity")
def s13_report(spark, sf):
    """A report as JSON lines, read again."""
    path = landing_path(spark, "report")
    report = queue(spark, sf).groupBy("survey_id", "severity").agg(F.count("*").alias("n"), F.round(F.sum("estimated_cost"), 2).alias("cost"))
    write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("f20_store_lookup", """SELECT w.survey_id, w.stored_id AS defect_id, s.class_name, s.severity, s.stored_id IS NOT NULL AS found FROM (
SELECT survey_id, stored_id FROM o_stored WHERE stored_id%5=0 UNION ALL SELECT survey_id+1, max(stored_id) FROM o_stored GROUP BY survey_id) w LEFT JOIN o_stored s ON s.survey_id=w.survey_id AND s.stored_id=w.stored_id""")
def f20_store(spark, sf):
    """Every fifth stored defect, and the last of each survey under the wrong survey."""
    store = filled_store(spark, sf)
    stored = store.read("defects").select(F.col("survey_id").cast("bigint").alias("survey_id"), "defect_id")
    wrong = stored.groupBy("survey_id").agg(F.max("defect_id").alias("defect_id")).select(F.col("survey_id") + 1, "defect_id")
    found = store.lookup(cut(stored.filter("defect_id % 5 = 0").union(wrong)))
    return found.select("survey_id", "defect_id", "class_name", "severity", "found")


#: silence that ends a track (no two frames are that far apart), how late rows may be, and how far back the held-up rows lie
SILENCE, LATENESS, HELD_UP = "20100 milliseconds", "5 seconds", 40
LATE = f"track_id%97=5 AND frame_idx/5e0<=(SELECT max(frame_idx) FROM v_det)*75e-2/5e0-{HELD_UP}"
cte("o_session", f"""SELECT *, sum(fresh) OVER (PARTITION BY survey_id, track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS part FROM (
SELECT *, CASE WHEN frame_idx/5e0-lag(frame_idx/5e0) OVER (PARTITION BY survey_id, track_id ORDER BY frame_idx)<=201e-1 THEN 0 ELSE 1 END AS fresh FROM v_det WHERE track_id IS NOT NULL AND NOT ({LATE}))""")


@query("x01_streaming_closest_approach", """SELECT survey_id, track_id, n_obs, frame_idx, class_name, x1, y1, x2, y2 FROM (SELECT *, count(*) OVER s AS n_obs,
row_number() OVER (s ORDER BY y2 DESC, (x2-x1)*(y2-y1) DESC, confidence DESC, frame_idx, x1 DESC) AS rn FROM o_session WINDOW s AS (PARTITION BY survey_id, track_id, part)) WHERE rn=1 AND n_obs>=3""")
def x01(spark, sf):
    """Streams the detections in four batches by time. Tracks fall silent and return as new ones;
    some early rows come with the last batch and are too late; a row far ahead closes all tracks."""
    source, target, state = (landing_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    d = view(spark, sf, "v_det")
    last = d.agg(F.max("frame_idx")).scalar()
    held_up = (F.col("track_id") % 97 == 5) & (F.col("frame_idx") / 5.0 <= last * 0.75 / 5.0 - HELD_UP)
    quarter = F.when(F.coalesce(held_up, F.lit(False)), 3).otherwise(F.least(F.floor(F.col("frame_idx") * 4 / last), F.lit(3)))
    rows = cut(d.withColumn("ts", F.timestamp_seconds(START + F.col("frame_idx") / 5.0)).withColumn("quarter", quarter.cast("int")))
    end = rows.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts"))
    ids = ("survey_id", "track_id")
    blank = [F.lit(-1 if f.name in ids else None).cast(f.dataType).alias(f.name) for f in d.schema.fields]

    def arrive(batch):
        batch.write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        (
            live.closest_approach_stream(stream, SILENCE, LATENESS, CFG).writeStream.format("parquet").option("checkpointLocation", state).option("path", target)
            .trigger(availableNow=True).start().awaitTermination()
        )

    for q in range(4):
        arrive(rows.filter(F.col("quarter") == q).drop("quarter"))
    arrive(end.select(*blank, "ts"))
    return spark.read.parquet(target).select("survey_id", "track_id", "n_obs", "frame_idx", "class_name", "x1", "y1", "x2", "y2")


@query("x02_streaming_survey_load", """SELECT survey_id, class_name, severity, round(priority,6) AS priority, round(estimated_cost,2) AS estimated_cost, round(lat,6) AS lat, round(lon,6) AS lon, 'New' AS status, 'completed' AS survey_status,
2 AS n_loads FROM o_queue""")
def x02(spark, sf):
    """Detections arrive in two batches, those of some surveys in both; the second one runs twice."""
    source, state = landing_path(spark, "arrivals"), landing_path(spark, "load-state")
    d = view(spark, sf, "v_det")
    store = SurveyStore(spark, landing_path(spark, "store"))
    known = surveys(spark, sf).select(
        "survey_id", F.to_date("surveyed_on").alias("surveyed_on"), F.lit("route").alias("route_name"), F.lit("video.mp4").alias("source")
    )
    maps = {"vertices": view(spark, sf, "v_road_vertex"), "amenities": view(spark, sf, "v_amenity"), "frame_w": 1920, "frame_h": 1080}

    def read_surveys(touched):
        here = [spark.read.parquet(source), view(spark, sf, "v_gps"), known]
        detections, gps, rows = (df.join(touched, "survey_id", "left_semi") for df in here)
        return rows, {"detections": detections, "gps": gps, **maps}

    batch = F.when(F.col("survey_id") < 3, F.col("frame_idx") % 2).otherwise(F.col("survey_id") % 2)
    for n in range(2):
        d.filter(batch == n).write.mode("append").parquet(source)
        stream = spark.readStream.schema(d.schema).parquet(source)
        live.load_surveys_stream(stream, read_surveys, store, state, cfg=CFG).awaitTermination()
    live.batch_loader(read_surveys, store, "arrivals", CFG)(d.filter(batch == 1), 1)  # has run already: nothing happens
    done = store.read("surveys").select("survey_id", F.col("status").alias("survey_status"))
    return store.read("defects").join(done, "survey_id").select(
        F.col("survey_id").cast("bigint").alias("survey_id"), "class_name", "severity", deg("priority"), F.round("estimated_cost", 2).alias("estimated_cost"),
        deg("lat"), deg("lon"), "status", "survey_status", store.read("loads").agg(F.count("*")).scalar().cast("int").alias("n_loads"),
    )
