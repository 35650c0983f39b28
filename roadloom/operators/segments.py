"""Fixed-length route segments and their condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.config import DEFAULTS, Settings
from roadloom.functions import boxes
from roadloom.operators.areas import union_area
from roadloom.operators.spatial import snap_to_trace
from roadloom.operators.temporal import chainage
from roadloom.session import cut


def segment_numbers(chain: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(survey, total_m, n_seg, seg) for every segment of every trace."""
    totals = chain.groupBy("survey_id").agg(F.max("cum_m").alias("total_m"))
    n = F.when(F.col("total_m") > 0, F.ceil(F.col("total_m") / cfg.segment_length_m)).otherwise(F.lit(1)).cast("bigint")
    return totals.withColumn("n_seg", n).withColumn("seg", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_seg") - 1)))


def frames_of_segments(chain: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(survey, seg, start_m, end_m, covered) for every segment of every trace."""
    length = cfg.segment_length_m
    segs = segment_numbers(chain, cfg)
    solid = chain.filter(F.col("p_lat").isNotNull() & ~F.col("is_gap"))
    first = F.floor((F.col("cum_m") - F.col("step_m")) / length)
    covered = (
        solid.select("survey_id", F.explode(F.sequence(first, F.floor(F.col("cum_m") / length))).alias("seg"))
        .distinct()
        .withColumn("covered", F.lit(True))
    )
    # a trace that ends on a boundary reaches one segment past its last, which counts as the last
    return segs.join(covered, ["survey_id", "seg"], "left").select(
        "survey_id",
        "seg",
        (F.col("seg") * length).alias("start_m"),
        F.least((F.col("seg") + 1) * length, "total_m").alias("end_m"),
        F.coalesce("covered", F.lit(False)).alias("covered"),
        "n_seg",
    )


def assign(defects: DataFrame, chain: DataFrame, ids: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """Snaps defects to their trace and adds the unclamped segment index."""
    snapped = snap_to_trace(defects, chain, ids)
    return snapped.withColumn("seg_raw", F.floor(F.col("chain_m") / cfg.segment_length_m))


def build_segments(
    gps: DataFrame, defects: DataFrame, frame_w: int, frame_h: int, cfg: Settings = DEFAULTS, chain: DataFrame | None = None
) -> DataFrame:
    """Segments of every survey with damage index and condition; uncovered ones are NoData."""
    chain = cut(chainage(gps, cfg)) if chain is None else chain
    segs = frames_of_segments(chain, cfg)
    tail = segs.groupBy("survey_id").agg(F.max("n_seg").alias("n_seg"))
    placed = (
        assign(defects, chain, ["defect_id"], cfg)
        .join(tail, "survey_id")
        .withColumn("seg", F.least(F.col("seg_raw"), F.col("n_seg") - 1))
        .withColumn("frame_w", F.lit(frame_w))
        .withColumn("frame_h", F.lit(frame_h))
    )
    damage = union_area(placed, ["survey_id", "seg"])
    total = float(frame_w * frame_h)
    index = F.when(F.col("covered"), F.coalesce("union_px", F.lit(0)) / F.lit(total)).otherwise(F.lit(0.0))
    return segs.join(damage, ["survey_id", "seg"], "left").select(
        "survey_id",
        (F.col("seg") + 1).alias("segment_id"),
        "start_m",
        "end_m",
        index.alias("damage_index"),
        F.when(F.col("covered"), boxes.condition(index, cfg)).otherwise(F.lit("NoData")).alias("condition"),
    )
