"""Streams of detections, and results written back to the survey store."""

import datetime

from pyspark.sql import functions as F

from roadloom.operators import dedup
from roadloom.plans.process import verify_in_store
from roadloom.sources.store import SurveyStore
from roadloom.streaming import tracks as live

SEEN = "survey_id bigint, track_id bigint, frame_idx bigint, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double, frame_w int, frame_h int, ts timestamp"
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def seen(track, second, y2, survey=1):
    return (survey, track, second, "D00", 0.0, 0.0, 10.0, y2, 0.5, 640, 480, T0 + datetime.timedelta(seconds=second))


def test_a_track_that_falls_silent_and_returns(spark, tmp_path):
    batches = [
        [seen(1, 0, 5.0), seen(1, 2, 9.0), seen(1, 4, 7.0), seen(2, 1, 1.0), seen(2, 2, 2.0), seen(2, 3, 2.0), seen(3, 5, 1.0)],
        [seen(1, 100, 3.0), seen(1, 101, 2.0), seen(1, 102, 1.0), seen(4, 103, 1.0), seen(4, 104, 1.0), seen(4, 105, 2.0)],
        [seen(2, 4, 99.0), seen(4, 106, 3.0)],  # the row of track 2 is too late
        [seen(9, 9999, 1.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.closest_approach_stream(spark.readStream.schema(SEEN).parquet(str(tmp_path / "in")), "20 seconds", "5 seconds")
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
        q.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.track_id, r.n_obs, r.frame_idx, r.y2) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 3, 2, 9.0), (1, 3, 100, 3.0), (2, 3, 2, 2.0), (4, 4, 106, 3.0)]


def test_a_batch_runs_again(spark, tmp_path, monkeypatch):
    """A finished batch is passed over; one that broke off is loaded as a whole."""
    store, loads, broken = SurveyStore(spark, str(tmp_path / "store")), [], [True]

    def load(store_, surveys, inputs, cfg):
        loads.append(sorted(r.survey_id for r in surveys.collect()))
        if broken.pop() if broken else False:
            raise RuntimeError("lost")

    monkeypatch.setattr(live, "load_surveys", load)
    run = live.batch_loader(lambda touched: (touched, {}), store, "day")
    batch = spark.createDataFrame([(1,), (1,), (2,)], "survey_id bigint")
    try:
        run(batch, 0)
    except RuntimeError:
        assert not store.has_load("day", 0)
    for epoch in (0, 0, 1):
        run(batch, epoch)
    assert loads == [[1, 2]] * 3 and store.has_load("day", 1) and not store.has_load("night", 1)


def test_verification_is_written_back(spark, tmp_path):
    store = SurveyStore(spark, str(tmp_path))
    near = 4 / 111_194.93  # four metres
    rows = [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0), (1, 4, 3.0), (2, 1, near), (2, 2, 5.0), (3, 1, 0.0)]
    df = spark.createDataFrame([(s, d, "D00", 13.0 + lat, 80.0) for s, d, lat in rows], "survey_id bigint, defect_id bigint, class_name string, lat double, lon double")
    store.add_defects(df.withColumns({c: F.lit(0.0) for c in ("area_px", "confidence", "x1", "y1", "x2", "y2")} | {"severity": F.lit("Low")}))
    store.update_defects(spark.createDataFrame([(1, 1, "Repaired", None, False, False), (1, 2, "Open", None, False, True)], "survey_id bigint, defect_id bigint, status string, matched_prev_id bigint, recurrence boolean, unverified boolean"))
    path = spark.createDataFrame([(2, 14.0, 80.0), (2, 13.0, 80.0), (3, 15.0, 80.0)], "survey_id bigint, lat double, lon double")
    pairs = spark.createDataFrame([(1, 2)], "old_survey bigint, new_survey bigint")
    assert verify_in_store(store, pairs, path).count() == 6
    got = {r.defect_id: (r.survey_id, r.status, r.recurrence, r.unverified, r.matched_prev_id) for r in store.read("defects").collect()}
    assert got == {
        1: (1, "Failed", True, False, None), 2: (1, "Repaired", False, False, None), 3: (1, "New", False, True, None), 4: (1, "New", False, True, None),
        5: (2, "Failed", True, False, 1), 6: (2, "New", False, False, None), 7: (3, "New", False, False, None),
    }


def test_tracks_of_a_defect(spark):
    members = spark.createDataFrame([(1, 5, 3), (1, 3, 3), (1, 9, 9), (2, 3, 3)], "survey_id int, track_id int, component int")
    defects = spark.createDataFrame([(1, 1, 3), (1, 2, 9), (2, 1, 3)], "survey_id int, defect_id int, first_track int")
    got = sorted(tuple(r) for r in dedup.defect_tracks(defects, members).select("survey_id", "defect_id", "track_id").collect())
    assert got == [(1, 1, 3), (1, 1, 5), (1, 2, 9), (2, 1, 3)]
