"""Survey relations derived from the driver's tables, as one text for Spark and for the oracle.

``{table}`` marks a base table, `` div `` integer division, ``{K5}`` and ``{K8}`` the numbers from 0 to
4 and 7, ``{E1}`` to ``{E8}`` the values of the ``k``-th eight of an embedding.
All rows of the tables take part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.ranking import blocked_rank
from roadloom.session import cut

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

FPS = 5.0
ID_MAP = {0: "D00", 1: "D10", 2: "D20", 3: "D40", 4: "D44", 5: "D43"}

VIEWS = {
    "v_gps": """
SELECT survey_id, seq, CAST((seq-1)+10*(seq div 100) AS DOUBLE) AS timestamp_s,
       13e0+survey_id*5e-2+seq*8e-5 AS lat, 8022e-2+seq*15e-6 AS lon,
       CAST(1+event_id%12 AS DOUBLE) AS accuracy_m, value AS speed_mps
FROM (SELECT event_id, value, user_id%20 AS survey_id,
             CAST(row_number() OVER (PARTITION BY user_id%20 ORDER BY ts, event_id) AS BIGINT) AS seq FROM {events}) e""",
    "v_det": """
SELECT l_orderkey%20 AS survey_id,
       CASE WHEN l_linenumber=7 AND l_tax>=8e-2 THEN NULL ELSE l_orderkey END AS track_id,
       CASE ((l_orderkey div 20)%4) WHEN 0 THEN 'D00' WHEN 1 THEN 'D10' WHEN 2 THEN 'D20' ELSE 'D40' END AS class_name,
       l_partkey AS frame_idx, CAST((l_suppkey*37)%1500 AS DOUBLE) AS x1, CAST((l_partkey*53)%800 AS DOUBLE) AS y1,
       (l_suppkey*37)%1500+8e0*l_quantity AS x2, (l_partkey*53)%800+5e0*l_quantity AS y2,
       1e0-5e0*l_discount AS confidence, 1920 AS frame_w, 1080 AS frame_h
FROM {lineitem}""",
    "v_road_vertex": """
SELECT way_pos, CAST(k AS BIGINT) AS vertex_pos,
       CASE nation%4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'residential' ELSE 'tertiary' END AS highway,
       13e0+(way_pos%20)*5e-2+((way_pos div 20)*60+k*12)*8e-5 AS lat,
       8022e-2+((way_pos div 20)*60+k*12)*15e-6+(way_pos%3)*2e-4 AS lon
FROM (SELECT s_suppkey AS way_pos, s_nationkey AS nation, {K5} AS k FROM {supplier}) w""",
    "v_amenity": """
SELECT p_partkey AS amenity_id, CASE p_size WHEN 1 THEN 'school' WHEN 2 THEN 'hospital' ELSE 'other' END AS amenity,
       13e0+(p_partkey%20)*5e-2+(p_partkey div 20)*5*8e-5 AS lat, 8022e-2+(p_partkey div 20)*5*15e-6+p_size*1e-4 AS lon
FROM {part}""",
    "v_old": """
SELECT c_custkey+1 AS defect_id, CASE ((c_custkey div 3)%4) WHEN 0 THEN 'D00' WHEN 1 THEN 'D10' WHEN 2 THEN 'D20' ELSE 'D40' END AS class_name,
       13e0+(((c_custkey div 3)*7919)%10000)*1e-4+(c_custkey%3)*5e-5 AS lat, 80e0+(((c_custkey div 3)*104729)%10000)*1e-4 AS lon,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'Repaired' WHEN 'BUILDING' THEN 'New' WHEN 'AUTOMOBILE' THEN 'Failed' ELSE 'Open' END AS status
FROM {customer}""",
    "v_new": """
SELECT o_orderkey+1 AS defect_id, CASE ((o_custkey div 3)%4) WHEN 0 THEN 'D00' WHEN 1 THEN 'D10' WHEN 2 THEN 'D20' ELSE 'D40' END AS class_name,
       13e0+(((o_custkey div 3)*7919)%10000)*1e-4+(o_orderkey%23)*1e-5 AS lat, 80e0+(((o_custkey div 3)*104729)%10000)*1e-4 AS lon
FROM {orders}""",
    "v_path": """
SELECT c_custkey AS seq, 13e0+(((c_custkey div 3)*7919)%10000)*1e-4+CASE WHEN (c_custkey div 3)%3=0 THEN 15e-1 ELSE 4e-5 END AS lat,
       80e0+(((c_custkey div 3)*104729)%10000)*1e-4 AS lon
FROM {customer}""",
    "v_label_box": """
SELECT d.doc_id, d.source||'_'||lpad(CAST(d.doc_id AS VARCHAR(20)),6,'0')||'.jpg' AS image,
       CASE (d.doc_id div 7)%10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS leaky_split,
       CAST(row_number() OVER (PARTITION BY d.doc_id ORDER BY l.l_linenumber, l.l_suppkey, l.l_partkey, l.l_quantity, l.l_tax) AS BIGINT)-1 AS box_idx,
       CAST(l.l_linenumber-1 AS VARCHAR(20)) AS raw_id,
       (l.l_suppkey%100)/1e2 AS cx, (l.l_partkey%100)/1e2 AS cy, l.l_quantity/2e2 AS w, l.l_tax*2e0 AS h
FROM {documents} d LEFT JOIN (SELECT *, l_orderkey%(7*(SELECT count(*) FROM {documents}) div 8) AS at FROM {lineitem}) l ON l.at=d.doc_id""",
    "v_rating": """
SELECT crop_id, 'crops/crop_'||CAST(crop_id AS VARCHAR(20))||'.png' AS filename, area_ratio,
       CASE WHEN area_ratio<2e-2 THEN 'Low' WHEN area_ratio<8e-2 THEN 'Medium' ELSE 'High' END AS system_severity,
       CAST(CASE WHEN area_ratio<2e-2 THEN 0 WHEN area_ratio<8e-2 THEN 1 ELSE 2 END AS BIGINT) AS system,
       CAST(greatest(0,least(2,b+CASE (c+0)%7 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)) AS BIGINT) AS rater_1,
       CAST(greatest(0,least(2,b+CASE (c+5)%7 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)) AS BIGINT) AS rater_2,
       CAST(greatest(0,least(2,b+CASE (c+3)%7 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)) AS BIGINT) AS rater_3
FROM (SELECT o_orderkey AS crop_id, o_custkey AS c, ((o_orderkey*37)%1000)/5e3 AS area_ratio,
             CASE WHEN (o_orderkey*37)%1000<150 THEN 0 WHEN (o_orderkey*37)%1000<500 THEN 1 ELSE 2 END AS b
      FROM {orders}) t""",
    "v_timing": """
SELECT o_orderkey AS run_id, 1e0+o_orderkey%9 AS route_distance_km, 6e1+o_custkey%600 AS automated_time_s,
       CASE WHEN o_orderkey%5=0 THEN 0e0 ELSE 36e2+o_custkey%5000 END AS manual_time_s, 1e1+(o_orderkey%300)/1e1 AS latency_s
FROM {orders}""",
    "v_media": """
SELECT event_id, 'm/'||CAST(user_id AS VARCHAR(20))||'/'||CAST(event_id AS VARCHAR(20))||CASE event_type WHEN 'click' THEN '.JPG' WHEN 'view' THEN '.mp4' WHEN 'error' THEN '.txt' ELSE '.png' END AS path, ts AS mtime
FROM {events}""",
    "v_truth_raw": """
SELECT c_custkey+2 AS row_no, CASE WHEN c_custkey%50=0 THEN 'x7' WHEN c_custkey%50=1 THEN '-3' WHEN c_custkey%50=2 THEN '5' ELSE CAST(c_custkey+10 AS VARCHAR(20)) END AS defect_id,
       CASE WHEN c_custkey%40=3 THEN 'rutting' ELSE 'pothole' END AS class_name,
       CASE WHEN c_custkey%60=4 THEN '999.0' WHEN c_custkey%60=5 THEN 'north' ELSE '13.5' END AS lat, CASE WHEN c_custkey%70=6 THEN '-181' ELSE '80.2' END AS lon
FROM {customer}""",
    "v_raw_pred": """
SELECT vec_id div 10 AS image_id, vec_id%10*8+k AS pos, 320+400*{E1} AS cx, 320+400*{E2} AS cy, 120+200*abs({E3}) AS w, 120+200*abs({E4}) AS h,
       4*abs({E5}) AS s1, 4*abs({E6}) AS s2, 4*abs({E7}) AS s3, 4*abs({E8}) AS s4
FROM (SELECT vec_id, embedding, CAST(k AS BIGINT) AS k FROM (SELECT vec_id, embedding, {K8} AS k FROM {embeddings}) v) e""",
}

# twenty pairs of surveys with the same ids and places in each pair
for _name, _key in (("v_old", "c_custkey"), ("v_new", "o_orderkey"), ("v_path", "c_custkey")):
    _text = VIEWS[_name].replace("c_custkey", "(c_custkey div 20)").replace("o_custkey", "(o_custkey div 20)")
    _text = _text.replace("o_orderkey+1", "o_orderkey div 20+1").replace("SELECT ", f"SELECT {_key}%20 AS pair_id, ", 1)
    VIEWS[_name.replace("v_", "v_pair_")] = _text


def spark_text(name: str, sf_dir: str) -> str:
    out = VIEWS[name].replace("{K5}", "explode(sequence(0,4))").replace("{K8}", "explode(sequence(0,7))")
    out = re.sub(r"\{E(\d)\}", r"CAST(element_at(embedding,CAST(8*k+\1 AS INT)) AS DOUBLE)", out)
    for t in TABLES:
        out = out.replace("{" + t + "}", f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`")
    return out


def duck_text(name: str) -> str:
    out = VIEWS[name].replace("{K5}", "unnest(range(5))").replace("{K8}", "unnest(range(8))").replace(" div ", " // ")
    out = re.sub(r"\{E(\d)\}", r"CAST(embedding[8*k+\1] AS DOUBLE)", out)
    for t in TABLES:
        out = out.replace("{" + t + "}", t)
    return out


_traces: dict[tuple, DataFrame] = {}


def _gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_gps``: the numbering runs in blocks of a minute, so no trace is sorted in one task.

    Kept per session, as the landed traces would be.
    """
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _traces:
        e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").selectExpr(
            "event_id", "ts", "value", "user_id % 20 AS survey_id"
        )
        minute = F.substring(F.col("ts").cast("string"), 1, 16)
        ranked = blocked_rank(e, ["survey_id"], "ts", "seq", block=minute, tail=["event_id"])
        _traces[at] = cut(spark.sql(VIEWS["v_gps"].split("\nFROM")[0] + "\nFROM {ranked}", ranked=ranked))
    return _traces[at]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _gps(spark, sf_dir) if name == "v_gps" else spark.sql(spark_text(name, sf_dir))
