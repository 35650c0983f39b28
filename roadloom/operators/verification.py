"""Repair verification against a later survey."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.config import DEFAULTS, STATUSES, Settings
from roadloom.operators.matching import greedy_match
from roadloom.operators.ranking import blocked_rank
from roadloom.operators.spatial import flag_within
from roadloom.session import cut


def transitions(
    old: DataFrame, new: DataFrame, matches: DataFrame, covered: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Status of both sides after a re-survey, one row per defect (``side`` old / new).

    ``matches``: l_id (old), r_id (new). ``covered``: defect_id, covered of old defects. ``keys``
    name the pair of surveys in all four; defect ids are then unique within a pair only.
    """
    m_old = matches.select(*keys, F.col("l_id").alias("defect_id"), F.col("r_id").alias("other"))
    repaired = F.col("status") == "Repaired"
    hit = F.col("other").isNotNull()
    o = (
        old.select(*keys, "defect_id", "class_name", "status")
        .join(m_old, [*keys, "defect_id"], "left")
        .join(covered, [*keys, "defect_id"], "left")
        .withColumn("seen", F.coalesce("covered", F.lit(False)))
    )
    old_out = o.select(
        *keys,
        F.lit("old").alias("side"),
        "defect_id",
        "class_name",
        F.when(hit & repaired, F.lit("Failed"))
        .when(hit, F.lit("Open"))
        .when(F.col("seen"), F.lit("Repaired"))
        .otherwise(F.col("status"))
        .alias("status"),
        (hit & repaired).alias("recurrence"),
        (~hit & ~F.col("seen")).alias("unverified"),
        F.lit(None).cast("bigint").alias("matched_prev_id"),
    )
    m_new = matches.select(*keys, F.col("r_id").alias("defect_id"), F.col("l_id").alias("prev")).join(
        old.select(*keys, F.col("defect_id").alias("prev"), F.col("status").alias("prev_status")), [*keys, "prev"]
    )
    n = new.select(*keys, "defect_id", "class_name").join(m_new, [*keys, "defect_id"], "left")
    again = F.coalesce(F.col("prev_status") == "Repaired", F.lit(False))
    new_out = n.select(
        *keys,
        F.lit("new").alias("side"),
        "defect_id",
        "class_name",
        F.when(again, F.lit("Failed")).when(F.col("prev").isNotNull(), F.lit("Open")).otherwise(F.lit("New")).alias("status"),
        again.alias("recurrence"),
        F.lit(False).alias("unverified"),
        F.col("prev").alias("matched_prev_id"),
    )
    return old_out.unionByName(new_out)


def covered_by(old: DataFrame, path: DataFrame, cfg: Settings = DEFAULTS, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``covered``: some point of the re-survey's trace (of the same ``keys``) is near the defect."""
    return flag_within(old, path, cfg.coverage_radius_m, "covered", keys)


def match_surveys(old: DataFrame, new: DataFrame, radius_m: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, l_id, r_id, d): greedy matching within each pair of surveys that ``keys`` name.

    Ids are unique per pair and side only, so both sides are numbered over all pairs, in the
    order of their ids, and the names are put back after the matching.
    """
    if not keys:
        return greedy_match(old, new, radius_m)
    pair = [(k, True) for k in keys]
    sides = [cut(blocked_rank(side, [], "defect_id", "_row", lead=pair)) for side in (old, new)]
    left, right = (side.withColumn("defect_id", F.col("_row")).drop("_row") for side in sides)
    found = greedy_match(left, right, radius_m, ("class_name", *keys))
    names = [
        side.select(*(keys if tag == "l" else ()), F.col("_row").alias(f"{tag}_id"), F.col("defect_id").alias(f"_{tag}"))
        for tag, side in zip("lr", sides, strict=True)
    ]
    return found.join(names[0], "l_id").join(names[1], "r_id").select(
        *keys, F.col("_l").alias("l_id"), F.col("_r").alias("r_id"), "d"
    )


def verify(
    old: DataFrame, new: DataFrame, path: DataFrame, cfg: Settings = DEFAULTS, keys: Sequence[str] = ()
) -> DataFrame:
    """Matching, coverage and transitions; ``keys`` (not null) name the pair of surveys in all three inputs."""
    matches = match_surveys(old, new, cfg.match_radius_m, keys)
    return transitions(old, new, matches, covered_by(old, path, cfg, keys).select(*keys, "defect_id", "covered"), keys)


def lookup_predictions(truth: DataFrame, predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Truth rows of known status with the predicted status found by id (and ``keys``).

    Predictions carry ``pos``; the last of a repeated id counts. A missing or unknown
    prediction is ``unverified``.
    """
    known = [F.lit(s) for s in STATUSES]
    last = predictions.groupBy(*keys, "defect_id").agg(F.max_by("status", "pos").alias("predicted"))
    p = F.col("predicted")
    return (
        truth.filter(F.col("actual").isin(*STATUSES))
        .join(last, [*keys, "defect_id"], "left")
        .withColumn("predicted", F.when(F.array_contains(F.array(*known), p), p).otherwise(F.lit("unverified")))
    )


def confusion(looked_up: DataFrame) -> DataFrame:
    """Full status x status counts, zero cells included."""
    names = F.array(*[F.lit(s) for s in STATUSES])
    cells = looked_up.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    grid = (
        looked_up.sparkSession.range(1)
        .select(F.explode(names).alias("actual"))
        .withColumn("predicted", F.explode(names))
    )
    return grid.join(cells, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def accuracy(looked_up: DataFrame) -> DataFrame:
    right = F.count_if(F.col("actual") == F.col("predicted"))
    total = F.count("*")
    return looked_up.agg(
        total.alias("total"),
        right.alias("correct"),
        F.when(total > 0, right / total).otherwise(F.lit(0.0)).alias("accuracy"),
    )
