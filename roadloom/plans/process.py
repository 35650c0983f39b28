"""Full processing of surveys: detections and traces to defects, segments and a queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.config import DEFAULTS, Settings
from roadloom.operators import dedup, priority, segments, verification
from roadloom.operators.temporal import TRACE, chainage
from roadloom.session import cut
from roadloom.sources.store import SurveyStore


@dataclass(frozen=True)
class SurveyRun:
    """``defects`` carry segment, priority, cost and queue rank; ``unlocated`` are tracks without a position."""

    defects: DataFrame
    segments: DataFrame
    members: DataFrame
    unlocated: DataFrame


def process_surveys(
    detections: DataFrame,
    gps: DataFrame,
    vertices: DataFrame,
    amenities: DataFrame,
    frame_w: int,
    frame_h: int,
    cfg: Settings = DEFAULTS,
    offsets: DataFrame | None = None,
) -> SurveyRun:
    if cfg.frame_stride > 1:
        detections = detections.filter(F.col("frame_idx") % cfg.frame_stride == 0)
    found, lost, members = dedup.deduplicate(detections, gps, cfg, offsets)
    found = cut(found)
    chain = cut(chainage(gps.select(*TRACE), cfg))
    placed = segments.assign(found, chain, ["defect_id"], cfg).select("survey_id", "defect_id", "seg_raw")
    last = segments.frames_of_segments(chain, cfg).groupBy("survey_id").agg(F.max("seg").alias("last"))
    placed = placed.join(last, "survey_id").select(
        "survey_id", "defect_id", (F.least("seg_raw", "last") + 1).alias("segment_id")
    )
    rated = segments.build_segments(gps, found, frame_w, frame_h, cfg, chain)
    scored = cut(priority.score(found, vertices, amenities, ["survey_id", "defect_id"], cfg))
    ranked = priority.queue(scored).join(placed, ["survey_id", "defect_id"], "left")
    return SurveyRun(ranked, rated, members, lost)


def verify_in_store(store: SurveyStore, pairs: DataFrame, traces: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Verifies stored surveys against their re-surveys and writes the outcomes back.

    ``pairs``: old_survey, new_survey (a survey is in one pair of a call); ``traces``: survey_id,
    lat, lon. Both surveys' defects take their new status, flags and link to the earlier defect.
    Returns what was written: survey_id, defect_id, side, status, recurrence, unverified,
    matched_prev_id.
    """
    pairs = cut(pairs.select("old_survey", "new_survey", F.col("old_survey").alias("pair_id")))
    stored = store.read("defects")
    old, new = (
        cut(stored.join(pairs.select("pair_id", F.col(f"{side}_survey").alias("survey_id")), "survey_id").select("pair_id", "defect_id", "class_name", "lat", "lon", "status"))
        for side in ("old", "new")
    )
    path = traces.select("survey_id", "lat", "lon").join(pairs.select("pair_id", F.col("new_survey").alias("survey_id")), "survey_id").select("pair_id", "lat", "lon")
    out = verification.verify(old, new.drop("status"), path, cfg, ["pair_id"]).join(pairs, "pair_id")
    changes = cut(out.select(
        F.when(F.col("side") == "old", F.col("old_survey")).otherwise(F.col("new_survey")).alias("survey_id"),
        "defect_id", "side", "status", "recurrence", "unverified", "matched_prev_id",
    ))
    store.update_defects(changes)
    return changes


def load_surveys(store: SurveyStore, surveys: DataFrame, run_inputs: dict, cfg: Settings = DEFAULTS) -> SurveyRun:
    """Registers surveys, processes them and stores the results; a failure is kept as their status.

    A survey counts as loaded once its status is ``completed``. Loading surveys again, say after a
    failure, replaces whatever of theirs was stored. Ids follow the largest one stored by then; loads into one
    store are not to run side by side.
    """
    store.add_surveys(surveys, replace=True)
    try:
        run = process_surveys(cfg=cfg, **run_inputs)
        store.add_defects(run.defects)
        store.add_segments(run.segments)
    except Exception as err:
        store.set_survey_status(surveys.select("survey_id", F.lit(f"failed: {err}").alias("status")))
        raise
    store.set_survey_status(surveys.select("survey_id", F.lit("completed").alias("status")))
    return run
