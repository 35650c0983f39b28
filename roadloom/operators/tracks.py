"""Detections to tracks: assembly and closest approach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.config import DEFAULTS, Settings
from roadloom.functions import boxes

KEYS = ["survey_id", "track_id"]


def strided(detections: DataFrame, stride: int) -> DataFrame:
    return detections.filter(F.col("frame_idx") % F.lit(stride) == 0)


def tracked(detections: DataFrame) -> DataFrame:
    return detections.filter(F.col("track_id").isNotNull())


def assemble(detections: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per track that is long enough."""
    return (
        tracked(detections)
        .groupBy(*KEYS)
        .agg(
            F.count("*").alias("n_obs"),
            F.min("frame_idx").alias("first_frame"),
            F.max("frame_idx").alias("last_frame"),
            F.max("confidence").alias("max_confidence"),
        )
        .filter(F.col("n_obs") >= cfg.min_track_frames)
    )


def closest_approach(detections: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Per track the observation lowest in the frame, then largest, then most confident.

    One aggregation: the maximum of a struct keeps the winning row whole, and partial
    maxima are taken before the shuffle. Remaining ties go to the earliest frame, then to
    the box furthest right.
    """
    best = F.struct(
        F.col("y2"),
        ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"),
        F.col("confidence"),
        (-F.col("frame_idx")).alias("neg_frame"),
        F.col("x1"),
        F.col("y1"),
        F.col("x2"),
        F.col("class_name"),
        F.col("frame_w"),
        F.col("frame_h"),
    )
    return (
        tracked(detections)
        .groupBy(*KEYS)
        .agg(F.count("*").alias("n_obs"), F.max("confidence").alias("max_confidence"), F.max(best).alias("b"))
        .filter(F.col("n_obs") >= cfg.min_track_frames)
        .select(
            *KEYS,
            "n_obs",
            "max_confidence",
            (-F.col("b.neg_frame")).alias("frame_idx"),
            "b.class_name",
            "b.x1",
            "b.y1",
            "b.x2",
            "b.y2",
            "b.area",
            "b.confidence",
            "b.frame_w",
            "b.frame_h",
        )
    )


def with_severity(df: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    ratio = boxes.near_zone_ratio(
        *[F.col(c) for c in ("x1", "y1", "x2", "y2", "frame_w", "frame_h")], cfg.near_zone_top_fraction
    )
    return df.withColumn("area_ratio", ratio).withColumn("severity", boxes.severity(F.col("area_ratio"), cfg))
