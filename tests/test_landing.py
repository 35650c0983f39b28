"""Landed files as a source, upload checks on heads, ground-truth sheets as files."""

import csv
import io
import os

import pytest
from pyspark.sql import functions as F

from roadloom.sources import intake, landing, readers


def put(root, files):
    for name, content in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)


def test_heads_of_large_and_small_files(spark, tmp_path):
    put(tmp_path, {"a/clip.MP4": b"MZ" + b"x" * 99, "a/b/ride.mp4": b"ftyp" * 99, "t.csv": b"time,lat", "t.gpx": b"plain text", "none": b"", "a/run.exe": b"ok"})
    big = tmp_path / "a" / "big.avi"
    big.write_bytes(b"RIFF")
    os.truncate(big, 2**31 + 5)  # sparse: takes no room, and no array could hold its body
    got = {r.rel_path: (r.length, r.reasons) for r in intake.check_landed_uploads(spark, str(tmp_path)).collect()}
    assert got == {
        "a/clip.MP4": (101, ["executable"]), "a/b/ride.mp4": (396, []), "t.csv": (8, []), "t.gpx": (10, ["gps_content"]), "none": (0, ["extension"]),
        "a/run.exe": (2, ["extension"]), "a/big.avi": (2**31 + 5, ["size"]),
    }


def test_filters_reach_the_listing(spark, tmp_path):
    put(tmp_path, {f"d/{i}.jpg": b"j" * i for i in range(6)} | {"d/x.txt": b"tttt"})
    files = landing.landed_files(spark, str(tmp_path), head_bytes=2)
    wanted = files.filter((F.col("ext") == ".jpg") & (F.col("length") > 2) & F.col("rel_path").startswith("d/") & (F.col("length") % 2 == 0))
    assert [r["rel_path"] for r in wanted.collect()] == ["d/4.jpg"]
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "% 2" in plan and "> 2" not in plan.split("PushedFilters")[0], plan


def test_a_wide_folder_is_listed_in_several_tasks(spark, tmp_path):
    put(tmp_path, {f"wide/{i:04d}": b"" for i in range(500)} | {"wide/deep/er/x": b"1"})
    files = landing.landed_files(spark, str(tmp_path), share=60)
    per = files.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per) == 501 and len(per) >= 9 and max(r["count"] for r in per) < 120


def test_a_file_a_missing_and_an_empty_folder(spark, tmp_path):
    put(tmp_path, {"one.csv": b"a,b"})
    (tmp_path / "empty").mkdir()
    assert [(r.rel_path, r.length) for r in landing.landed_files(spark, str(tmp_path / "one.csv")).collect()] == [("one.csv", 3)]
    assert landing.landed_files(spark, str(tmp_path / "empty")).count() == landing.landed_files(spark, str(tmp_path / "gone")).count() == 0


def test_written_files_come_back(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i % 3}/f{i}.txt", f"text {i}") for i in range(20)], "rel_path string, content string")
    assert landing.land_files(df, str(tmp_path)) == 20
    assert {(r.rel_path, r.length) for r in readers.inventory(spark, str(tmp_path)).collect()} == {(f"p{i % 3}/f{i}.txt", len(f"text {i}")) for i in range(20)}


HEADER = "defect_id,class,lat,lon,severity_note\n"


def errors(spark, tmp_path, text, classes=("pothole", "crack")):
    put(tmp_path, {"gt.csv": text if isinstance(text, bytes) else text.encode()})
    return {r.row_no: r.errors for r in intake.check_truth_files(spark, str(tmp_path / "gt.csv"), classes).collect()}


def test_truth_sheet_known_cases(spark, tmp_path):
    good = HEADER + "1,pothole,13.0827,80.2707,Deep pothole\n2,crack,13.0828,80.2708,Longitudinal\n"
    assert errors(spark, tmp_path, good) == {2: [], 3: []}
    assert errors(spark, tmp_path, b"\xef\xbb\xbf" + good.replace("\n", "\r\n").encode()) == {2: [], 3: []}
    assert errors(spark, tmp_path, "wrong,header,lat,lon,note\nbad_id,unknown_class,999.0,not_lon,\n") == {1: ["header"]}
    assert errors(spark, tmp_path, "") == {0: ["empty_file"]}
    assert errors(spark, tmp_path, HEADER) == {}
    assert errors(spark, tmp_path, "\n" + good) == {1: ["header"]}
    bad = HEADER + "\n , ,,,\n1,pothole,91,80\n1,pothole,91,80,x,y\n7,pothole,91,-181,a\n7,rut,n,80,\n0,crack,1,2,3\nx,crack,1,2,3\n"
    assert errors(spark, tmp_path, bad) == {
        4: ["columns"], 5: ["columns"], 6: ["lat_range", "lon_range"], 7: ["id_duplicate", "class_unknown", "lat_not_number"], 8: ["id_not_positive"], 9: ["id_not_integer"],
    }


@pytest.mark.parametrize("note", ['plain', '5" wide', 'two\nlines', 'comma, and "quotes"', 'ends "here"', '', 'a\n\nb,\n"c'])
def test_records_as_the_csv_module_reads_them(spark, tmp_path, note):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for i in range(5):
        writer.writerow([i, note, "z"])
        writer.writerow([i, "w", note])
    text = out.getvalue() if note != '5" wide' else "".join(f"{i},{note},z\n{i},w,x\n" for i in range(5))
    (tmp_path / "r.csv").write_text(text)
    got = sorted((r.row_no, r.fields) for r in intake.csv_records(spark, str(tmp_path / "r.csv")).collect())
    assert got == [(n, row) for n, row in enumerate(csv.reader(io.StringIO(text)), 1)]


def test_records_over_many_pieces_of_a_file(spark, tmp_path):
    rows = [[str(i), "note\nof two, lines" if i % 7 == 0 else "x" * (i % 40), "e"] for i in range(4000)]
    with open(tmp_path / "big.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = sorted((r.row_no, r.fields) for r in intake.csv_records(spark, str(tmp_path / "big.csv")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(n, row) for n, row in enumerate(rows, 1)]
