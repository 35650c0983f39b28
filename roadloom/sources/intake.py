"""Quality jobs over landed files: intake checks, ground-truth validation, retention."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.config import CLASS_CODES, DEFAULTS, GPS_EXTENSIONS, MEDIA_EXTENSIONS, VIDEO_EXTENSIONS, Settings
from roadloom.functions.text import extension
from roadloom.operators.ranking import blocked_previous, blocked_running_sum
from roadloom.session import cut
from roadloom.sources.landing import landed_files
from roadloom.sources.readers import file_order, numbered

# Leading bytes of executable files (hex).
EXECUTABLE_MAGIC = ("4D5A", "7F454C46", "FEEDFA", "CEFAED")


def upload_reasons(path: Column, length: Column, head: Column, cfg: Settings = DEFAULTS) -> Column:
    """Why an upload is refused, as an array of words; ``head`` is its first 64 bytes as binary."""
    ext = extension(path)
    video, gps = ext.isin(*VIDEO_EXTENSIONS), ext.isin(*GPS_EXTENSIONS)
    hexed = F.hex(head)
    executable = F.lit(False)
    for magic in EXECUTABLE_MAGIC:
        executable = executable | hexed.startswith(magic)
    text = F.decode(head, "ISO-8859-1")
    tracklike = F.contains(text, F.lit("xml")) | F.contains(text, F.lit(","))
    checks = F.array(
        F.when(~video & ~gps, F.lit("extension")),
        F.when(length > cfg.max_upload_mb * 1024 * 1024, F.lit("size")),
        F.when(video & executable, F.lit("executable")),
        F.when(gps & ~tracklike, F.lit("gps_content")),
    )
    return F.filter(checks, lambda r: r.isNotNull())


def check_uploads(files: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """files: path, length, content (only its first 64 bytes are used)."""
    head = F.substring(F.col("content"), 1, 64)
    return files.select("path", "length", upload_reasons(F.col("path"), F.col("length"), head, cfg).alias("reasons"))


def check_landed_uploads(spark: SparkSession, path: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """path, rel_path, length, reasons of every file in a landing zone; 64 bytes of each are read."""
    files = landed_files(spark, path, head_bytes=64)
    return files.select("path", "rel_path", "length", upload_reasons(F.col("path"), F.col("length"), F.col("head"), cfg).alias("reasons"))


TRUTH_COLUMNS = ("defect_id", "class", "lat", "lon", "severity_note")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, fields) of all records of CSV files, numbered from 1 per file in file order.

    Fields are counted before any schema is applied. A byte-order mark is no part of the first
    field. Quoted fields may hold commas and line ends; a blank line is a record with one empty
    field. Lines are numbered by pieces of a file: a line that opens more quoted fields than it
    closes starts a longer record, up to the line that closes it. A quote inside an unquoted
    field is an ordinary character, unless it ends the field.
    """
    lines = numbered(file_order(spark.read.text(path)), "line", ["_file"]).select("_file", "line", "value")
    lines = cut(lines.withColumn("value", F.when(F.col("line") == 1, F.ltrim(F.col("value"), F.lit("\ufeff"))).otherwise(F.col("value"))))
    bare = F.replace("value", F.lit('""'), F.lit(""))
    net = F.regexp_count(bare, F.lit('(^|,)"')) - F.regexp_count(bare, F.lit('"(,|$)'))
    turning = lines.select("_file", "line", F.signum(net).cast("int").alias("net")).filter("net <> 0")
    turning = blocked_previous(turning, ["_file"], "line", ["net"])
    opened = F.col("p_net") == 1
    step = F.when((F.col("net") == 1) & ~F.coalesce(opened, F.lit(False)), 1).when((F.col("net") == -1) & opened, -1).otherwise(0)
    stepped = lines.join(turning.select("_file", "line", step.alias("step")), ["_file", "line"], "left").withColumn("step", F.coalesce("step", F.lit(0)))
    inside = blocked_running_sum(stepped, ["_file"], "line", "step", "inside").withColumn("start", F.when(F.col("inside") - F.col("step") == 0, 1).otherwise(0))
    rows = blocked_running_sum(inside, ["_file"], "line", "start", "row_no")
    whole = rows.groupBy("_file", "row_no").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l"))
    record = F.array_join(F.transform("l", lambda x: x["value"]), "\n")
    fields = F.split(record, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    plain = F.split(record, ",")
    # quotes that come in no pairs are text, so such a record has no quoted field
    fields = F.when(F.regexp_count(record, F.lit('"')) % 2 == 0, fields).otherwise(plain)
    unquoted = F.transform(fields, lambda f: F.when(f.rlike('(?s)^".*"$') & (F.length(f) > 1), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    return whole.select(F.col("_file").alias("file"), "row_no", unquoted.alias("fields"))


def check_truth_files(spark: SparkSession, path: str, classes: Iterable[str] = CLASS_CODES) -> DataFrame:
    """(file, row_no, errors) of ground-truth sheets: a file, or all files of a folder.

    A file without any record is ``empty_file`` (row 0). A wrong header is ``header`` (row 1), and
    nothing else is said of its file. Rows with another number of fields are ``columns``; blank
    ones are skipped but counted. The others are judged by ``validate_ground_truth``, ids per file.
    """
    records = cut(csv_records(spark, path))
    texts = F.transform("fields", lambda f: F.trim(f))
    records = records.withColumn("fields", texts)
    header = records.filter("row_no = 1").select("file", (F.col("fields") == F.array(*map(F.lit, TRUTH_COLUMNS))).alias("fits"))
    wrong = header.filter("not fits").select("file", F.lit(1).cast("bigint").alias("row_no"), F.array(F.lit("header")).alias("errors"))
    rows = records.filter("row_no > 1").join(header.filter("fits").select("file"), "file").filter(F.array_join("fields", "") != "")
    size = F.size("fields") == len(TRUTH_COLUMNS)
    ragged = rows.filter(~size).select("file", "row_no", F.array(F.lit("columns")).alias("errors"))
    named = rows.filter(size).select("file", "row_no", *[F.col("fields")[i].alias(c) for i, c in enumerate(("defect_id", "class_name", "lat", "lon"))])
    judged = validate_ground_truth(named, classes, ["file"]).select("file", "row_no", "errors")
    empty = landed_files(spark, path).filter("length <= 3").select(F.expr("regexp_extract(path, '([^/]*)$', 1)").alias("_name"), F.col("path").alias("file"))
    seen = records.select(F.expr("regexp_extract(file, '([^/]*)$', 1)").alias("_name")).distinct()
    empty = empty.join(seen, "_name", "left_anti").select("file", F.lit(0).cast("bigint").alias("row_no"), F.array(F.lit("empty_file")).alias("errors"))
    return judged.unionByName(ragged).unionByName(wrong).unionByName(empty)


def validate_ground_truth(rows: DataFrame, classes: Iterable[str] = CLASS_CODES, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``errors`` to the text rows of a ground-truth sheet; entirely blank rows are skipped.

    rows: row_no, defect_id, class_name, lat, lon (text), and ``keys`` that tell sheets apart. A
    positive id met again in a sheet is flagged on the later row.
    """
    text = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("defect_id", "class_name", "lat", "lon")}
    whole = F.when(text["defect_id"].rlike(r"^[+-]?\d+$"), text["defect_id"].try_cast("bigint"))
    named = rows.filter(F.concat(*text.values()) != "").withColumn("_id", whole)
    first = named.filter("_id is not null").groupBy(*keys, "_id").agg(F.min("row_no").alias("_first"))
    j = named.join(first, [*keys, "_id"], "left")
    lat, lon = text["lat"].try_cast("double"), text["lon"].try_cast("double")
    errors = F.array(
        F.when(F.col("_id").isNull(), F.lit("id_not_integer"))
        .when(F.col("_id") <= 0, F.lit("id_not_positive"))
        .when(F.col("row_no") > F.col("_first"), F.lit("id_duplicate")),
        F.when(~text["class_name"].isin(*classes), F.lit("class_unknown")),
        F.when(lat.isNull(), F.lit("lat_not_number")).when(~lat.between(-90.0, 90.0), F.lit("lat_range")),
        F.when(lon.isNull(), F.lit("lon_not_number")).when(~lon.between(-180.0, 180.0), F.lit("lon_range")),
    )
    return j.withColumn("errors", F.filter(errors, lambda e: e.isNotNull())).drop("_id", "_first")


def expired(path: Column, mtime: Column, now: Column, days: float = DEFAULTS.retention_days) -> Column:
    age = F.unix_micros(now) - F.unix_micros(mtime)
    return age > F.lit(int(days * 86400) * 1_000_000)


def purge_plan(files: DataFrame, now: Column, days: float = DEFAULTS.retention_days) -> DataFrame:
    """Media files with ``purge`` set on those older than the retention time (strictly)."""
    media = files.filter(extension(F.col("path")).isin(*MEDIA_EXTENSIONS))
    return media.withColumn("purge", expired(F.col("path"), F.col("mtime"), now, days))


def purge_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count("*").alias("scanned"), F.count_if("purge").alias("purged"), F.count_if(~F.col("purge")).alias("retained")
    )


def apply_purge(plan: DataFrame) -> int:
    """Deletes the planned files where the tasks run; returns how many paths were named.

    Uses the file system client of Arrow, which reads the scheme from the path. Deleting a
    path that is gone already is not an error, so a task may run again.
    """

    def delete(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            n = 0
            for uri in batch.column("path").to_pylist():
                if uri.startswith("file:/") and not uri.startswith("file://"):
                    uri = "file://" + uri[5:]
                store, name = fs.FileSystem.from_uri(uri)
                if store.get_file_info(name).type != fs.FileType.NotFound:
                    store.delete_file(name)
                n += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    named = plan.filter("purge").select("path").mapInArrow(delete, "n bigint")
    return int(named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
