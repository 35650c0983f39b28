"""Readers for the file formats surveys, label sets and score sheets arrive in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom import schemas
from roadloom.functions.text import epoch_seconds
from roadloom.operators.ranking import blocked_rank, blocked_running_sum
from roadloom.sources.landing import landed_files


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _text(name: str, columns: Sequence[str]) -> Column:
    return F.col(name) if name in columns else F.lit(None).cast("string")


def csv_strings(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """A header CSV with every column as text. With ``names`` nothing is inferred up front."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8")
    if names is not None:
        reader = reader.schema(_strings(*names))
    return reader.csv(path)


PLACE = ("_file", "_split", "_at")


def file_order(scan: DataFrame) -> DataFrame:
    """Adds PLACE, three columns that sort the rows of a plain file scan as they lie in the files.

    Tasks read file pieces in any order, but the rows of one piece in file order.
    """
    return scan.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )


def numbered(rows: DataFrame, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Numbers rows that carry PLACE from 1 per ``keys``; no task sorts more than a piece of a file."""
    return blocked_rank(rows, keys, "_at", out, lead=[("_file", True), ("_split", True)], block=F.lit(0))


def _traced(points: DataFrame, survey: str | None) -> DataFrame:
    """Replaces PLACE by survey_id and seq, where the file has no such columns.

    ``survey`` is a pattern whose first group is the survey's number in the file path. ``seq``
    counts from 0 in file order over all files of a survey, or over the file if it has none.
    """
    if survey is not None and "survey_id" not in points.columns:
        points = points.withColumn("survey_id", F.regexp_extract("_file", survey, 1).try_cast("bigint"))
    if "seq" not in points.columns:
        owner = F.concat(F.lit("f"), "_file")
        if "survey_id" in points.columns:
            owner = F.coalesce(F.concat(F.lit("s"), F.col("survey_id").cast("string")), owner)
        points = numbered(points.withColumn("_trace", owner), "seq", ["_trace"]).withColumn("seq", F.col("seq") - 1).drop("_trace")
    return points.drop(*PLACE)


def gps_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, survey: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(points, one row with the malformed count).

    Time is a float epoch or ISO-8601; lat and lon are required; empty accuracy and speed
    are null, other text that is no number makes the row malformed. Points carry ``seq`` and,
    with a ``survey`` pattern, ``survey_id`` (see ``_traced``); malformed rows are not numbered.
    """
    raw = csv_strings(spark, path, columns)
    have = raw.columns
    acc, speed = _text("accuracy_m", have), _text("speed", have)
    ts = epoch_seconds(F.col("timestamp"))
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")

    def optional_ok(c: Column) -> Column:
        return c.isNull() | (c == "") | c.try_cast("double").isNotNull()

    extra = [c for c in have if c not in ("timestamp", "lat", "lon", "accuracy_m", "speed")]
    parsed = file_order(raw).select(
        *extra,
        *PLACE,
        ts.alias("timestamp_s"),
        lat.alias("lat"),
        lon.alias("lon"),
        acc.try_cast("double").alias("accuracy_m"),
        speed.try_cast("double").alias("speed_mps"),
        (ts.isNotNull() & lat.isNotNull() & lon.isNotNull() & optional_ok(acc) & optional_ok(speed)).alias("_ok"),
    )
    points = _traced(parsed.filter("_ok").drop("_ok"), survey)
    return points, parsed.agg(F.count_if(~F.col("_ok")).alias("malformed"))


def gps_gpx(spark: SparkSession, path: str, survey: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, malformed count) of GPX track points; a point without a time is malformed.

    ``seq`` and ``survey_id`` as in ``gps_csv``.
    """
    schema = "_lat string, _lon string, time string"
    raw = spark.read.format("xml").option("rowTag", "trkpt").option("mode", "PERMISSIVE").schema(schema).load(path)
    lat, lon = F.col("_lat").try_cast("double"), F.col("_lon").try_cast("double")
    iso = F.unix_micros(F.try_to_timestamp(F.trim(F.col("time")))) / F.lit(1e6)
    parsed = file_order(raw).select(*PLACE, iso.alias("timestamp_s"), lat.alias("lat"), lon.alias("lon")).withColumn(
        "_ok", F.col("timestamp_s").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )
    null = F.lit(None).cast("double")
    points = parsed.filter("_ok").select(
        *PLACE, "timestamp_s", "lat", "lon", null.alias("accuracy_m"), null.alias("speed_mps")
    )
    return _traced(points, survey), parsed.agg(F.count_if(~F.col("_ok")).alias("malformed"))


def _json_or_empty(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return file_order(spark.read.schema(schema).option("multiLine", multi_line).json(path))
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], f"{schema}, _file string, _split bigint, _at bigint")


def _entries(docs: DataFrame, name: str, pos: str) -> DataFrame:
    """(pos, entry) of list ``name``, numbered from 0 over all documents in file order."""
    sized = docs.select("_doc", name, F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)).alias("_n"))
    before = blocked_running_sum(sized, [], "_doc", "_n", "_to").withColumn("_from", F.col("_to") - F.col("_n"))
    return before.select("_from", F.posexplode(name).alias("_k", "entry")).select(
        (F.col("_from") + F.col("_k")).cast("bigint").alias(pos), "entry"
    )


def osm_cache(
    spark: SparkSession, path: str, default_class: str = "residential", multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(road vertices, amenities) of a road cache; a missing or corrupt file gives no rows.

    ``multi_line=False`` reads one cache document per line, which splits large files. ``way_pos``
    and ``amenity_id`` count on over all documents, in file order.
    """
    docs = numbered(_json_or_empty(spark, path, schemas.OSM_CACHE, multi_line), "_doc")
    vertices = _entries(docs, "highways", "way_pos").select(
        "way_pos",
        F.coalesce(F.try_element_at("entry.tags", F.lit("highway")), F.lit(default_class)).alias("highway"),
        F.posexplode("entry.geometry").alias("vertex_pos", "pt"),
    ).select(
        "way_pos", F.col("vertex_pos").cast("bigint").alias("vertex_pos"), "highway",
        F.col("pt")[0].alias("lat"), F.col("pt")[1].alias("lon"),
    )
    amenities = _entries(docs, "amenities", "amenity_id").select(
        "amenity_id", F.try_element_at("entry.tags", F.lit("amenity")).alias("amenity"), "entry.lat", "entry.lon",
    )
    return vertices, amenities


def osm_elements(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(highways, amenities) of raw map elements, as rows of the road cache's two lists."""
    e = raw.select(F.explode("elements").alias("e")).select("e.*")
    highways = e.filter("type = 'way' and tags['highway'] is not null").select(
        "id", "tags", F.transform("geometry", lambda p: F.array(p["lat"], p["lon"])).alias("geometry")
    )
    amenities = e.filter("type = 'node' and tags['amenity'] is not null").select("id", "tags", "lat", "lon")
    return highways, amenities


def raw_osm(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schemas.OSM_RAW).option("multiLine", multi_line).json(path)


DEFECT_COLUMNS = ("defect_id", "class", "class_name", "lat", "lon", "severity", "severity_note")


def defects_csv(spark: SparkSession, path: str) -> DataFrame:
    """Defect list CSV with its column aliases; a missing defect_id column counts up from 1 in
    file order, over several files in the order of their names."""
    raw = file_order(csv_strings(spark, path))
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    have = raw.columns
    given = _text("defect_id", have).try_cast("bigint")
    if "defect_id" not in have:
        raw = numbered(raw, "_line")
        given = F.col("_line")
    return raw.select(
        given.alias("defect_id"),
        F.coalesce(_text("class", have), _text("class_name", have), F.lit("")).alias("class_name"),
        _text("lat", have).try_cast("double").alias("lat"),
        _text("lon", have).try_cast("double").alias("lon"),
        F.coalesce(_text("severity", have), _text("severity_note", have), F.lit("Low")).alias("severity"),
    )


_DEFECT_ITEM = "struct<defect_id:bigint,class:string,class_name:string,lat:double,lon:double,severity:string>"


def defects_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(defects, one row with pre_dedup) from a JSON list or from {defects, pre_dedup_detections}."""
    item = T._parse_datatype_string(_DEFECT_ITEM)
    schema = T.StructType(
        [T.StructField("defects", T.ArrayType(item)), T.StructField("pre_dedup_detections", T.LongType()), *item.fields]
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    flat = raw.filter("defects is null and lat is not null").select(*[f.name for f in item.fields])
    nested = raw.filter("defects is not null").select(F.explode("defects").alias("d")).select("d.*")
    rows = flat.unionByName(nested).select(
        "defect_id", F.coalesce("class", "class_name", F.lit("")).alias("class_name"), "lat", "lon",
        F.coalesce("severity", F.lit("Low")).alias("severity"),
    )
    n = rows.agg(F.count("*")).scalar()
    return rows, raw.agg(F.max("pre_dedup_detections").alias("p")).select(F.coalesce("p", n).alias("pre_dedup"))


def repair_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Repair list: status trimmed and Open by default, position 0 by default."""
    raw = csv_strings(spark, path)
    have = raw.columns
    status = F.coalesce(_text("actual_status", have), _text("status", have), F.lit("Open"))
    return raw.select(
        _text("defect_id", have).try_cast("bigint").alias("defect_id"),
        F.trim(status).alias("status"),
        F.coalesce(_text("lat", have).try_cast("double"), F.lit(0.0)).alias("lat"),
        F.coalesce(_text("lon", have).try_cast("double"), F.lit(0.0)).alias("lon"),
    )


def filled_raters(ratings: DataFrame) -> list[str]:
    """The rater columns that hold anything, found in one aggregation."""
    names = [c for c in ratings.columns if c.startswith("rater_")]
    if not names:
        return []
    row = ratings.agg(*[F.max(F.trim(F.coalesce(c, F.lit(""))) != "").alias(c) for c in names]).first()
    return [c for c in names if row[c]]


def ratings_csv(spark: SparkSession, path: str, required: str = "system_severity") -> tuple[DataFrame, list[str]]:
    """(ratings as text, rater columns in use); no rows when the required column is missing."""
    raw = csv_strings(spark, path)
    if required not in raw.columns:
        return raw.limit(0), []
    return raw, filled_raters(raw)


def timings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Survey timings with their column aliases; empty cells are null."""
    raw = csv_strings(spark, path)
    have = raw.columns

    def first(*names: str) -> Column:
        given = next((n for n in names if n in have), None)  # an alias counts only where the column is absent
        return F.nullif(F.trim(F.col(given)), F.lit("")).try_cast("double") if given else F.lit(None).cast("double")

    return raw.select(
        first("route_distance_km").alias("route_distance_km"),
        F.coalesce(first("automated_time_s", "automated_duration_s"), F.lit(0.0)).alias("automated_time_s"),
        F.coalesce(first("manual_time_s", "manual_duration_s"), F.lit(0.0)).alias("manual_time_s"),
        first("detection_to_ticket_s", "latency_s").alias("latency_s"),
    )


def label_lines(text: Column) -> Column:
    """Non-blank lines of a label file, in order, each as its whitespace-separated fields."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda s: F.trim(s) != "")
    return F.transform(lines, lambda s: F.split(F.trim(s), r"\s+"))


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, box_idx, raw_id, cx, cy, w, h) of label text files; one file is one short text."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("file"),
        F.posexplode(label_lines(F.col("value"))).alias("box_idx", "f"),
    )

    def num(n: int) -> Column:
        return F.try_element_at("f", F.lit(n)).try_cast("double")

    return rows.select(
        "file", F.col("box_idx").cast("bigint").alias("box_idx"), F.col("f")[0].alias("raw_id"),
        num(2).alias("cx"), num(3).alias("cy"), num(4).alias("w"), num(5).alias("h"),
    )


def inventory(spark: SparkSession, path: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """(path, rel_path, mtime, length, ext) of all files below a folder, empty ones included.

    Contents are not read; the extensions are compared while listing.
    """
    files = landed_files(spark, path).select("path", "rel_path", "mtime", "length", "ext")
    return files if extensions is None else files.filter(F.col("ext").isin(*extensions))
