"""Tracks to unique located defects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.config import DEFAULTS, Settings
from roadloom.functions.text import frame_time
from roadloom.operators.components import clusters
from roadloom.operators.ranking import blocked_rank
from roadloom.operators.temporal import accuracy_filter, interpolate
from roadloom.operators.tracks import closest_approach, with_severity
from roadloom.session import cut


def locate(detections: DataFrame, gps: DataFrame, cfg: Settings = DEFAULTS, offsets: DataFrame | None = None) -> DataFrame:
    """Closest approach of every track with its position (null where the trace has none).

    ``offsets`` (survey_id, fps, offset_s) overrides the frame rate and clock of a survey.
    """
    # read twice below, and far fewer rows than detections
    reps = cut(closest_approach(detections, cfg))
    if offsets is None:
        t = frame_time(F.col("frame_idx"), F.lit(float(cfg.fps)), F.lit(0.0))
        reps = reps.withColumn("t", t)
    else:
        reps = reps.join(offsets, "survey_id", "left").withColumn(
            "t",
            frame_time(
                F.col("frame_idx"), F.coalesce("fps", F.lit(float(cfg.fps))), F.coalesce("offset_s", F.lit(0.0))
            ),
        ).drop("fps", "offset_s")
    return interpolate(reps, accuracy_filter(gps, cfg.max_accuracy_m), ["survey_id", "track_id"], cfg)


def located(positions: DataFrame) -> DataFrame:
    return positions.filter(F.col("lat").isNotNull())


def unlocated(reps: DataFrame, found: DataFrame) -> DataFrame:
    """Tracks that are not among the located ones."""
    return reps.join(found, ["survey_id", "track_id"], "left_anti")


def cluster_tracks(found: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Located tracks with their cluster (smallest track id); classes never mix."""
    return clusters(found, cfg.merge_radius_m, ["survey_id", "class_name"], "track_id")


def roll_up(members: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One defect per cluster, taken from its largest box (ties: lowest track id).

    Track ids stay in the member relation; a defect carries their count and range, since a
    cluster has no size limit.
    """
    best = F.struct(
        F.col("area"), (-F.col("track_id")).alias("neg_track"), "lat", "lon", "x1", "y1", "x2", "y2", "frame_w", "frame_h"
    )
    rolled = (
        members.groupBy("survey_id", "class_name", "component")
        .agg(
            F.max(best).alias("b"),
            F.max("max_confidence").alias("confidence"),
            F.count("*").alias("n_tracks"),
            F.min("track_id").alias("first_track"),
            F.max("track_id").alias("last_track"),
        )
        .select(
            "survey_id", "class_name", "component", "confidence", "n_tracks", "first_track", "last_track",
            *[F.col(f"b.{c}") for c in ("lat", "lon", "x1", "y1", "x2", "y2", "frame_w", "frame_h")],
        )
    )
    area = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    return with_severity(rolled.withColumn("area_px", area), cfg)


def number_defects(defects: DataFrame) -> DataFrame:
    """``defect_id`` from 1 per survey in order of the first track."""
    return blocked_rank(defects, ["survey_id"], "first_track", "defect_id")


def deduplicate(
    detections: DataFrame, gps: DataFrame, cfg: Settings = DEFAULTS, offsets: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(defects, unlocated tracks, member tracks with their component)."""
    positions = cut(locate(detections, gps, cfg, offsets))
    found = located(positions)
    members = cut(cluster_tracks(found, cfg))
    defects = number_defects(cut(roll_up(members, cfg)))
    return defects, positions.filter(F.col("lat").isNull()).drop("lat", "lon"), members


def defect_tracks(defects: DataFrame, members: DataFrame) -> DataFrame:
    """The member tracks of each defect: survey_id, defect_id and the columns of the track's closest approach."""
    names = defects.select("survey_id", F.col("first_track").alias("component"), "defect_id")
    return members.join(names, ["survey_id", "component"]).drop("component")


def reduction_pct(before, after):
    return F.when(before > 0, (before - after) / before * 100.0).otherwise(F.lit(0.0))
