"""Bounding-box column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadloom.config import DEFAULTS, Settings


def corners(cx, cy, w, h) -> dict[str, Column]:
    """Centre form to corner form."""
    return {"x1": cx - w / 2.0, "y1": cy - h / 2.0, "x2": cx + w / 2.0, "y2": cy + h / 2.0}


def area(x1, y1, x2, y2) -> Column:
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def pixel_box(cx, cy, w, h, img_w, img_h) -> dict[str, Column]:
    """Normalised box to whole pixels: truncate, then clamp to the image."""
    def px(v, size):
        return (v * size).cast("bigint")

    return {
        "x1": F.greatest(F.lit(0).cast("bigint"), px(cx - w / 2.0, img_w)),
        "y1": F.greatest(F.lit(0).cast("bigint"), px(cy - h / 2.0, img_h)),
        "x2": F.least(img_w.cast("bigint"), px(cx + w / 2.0, img_w)),
        "y2": F.least(img_h.cast("bigint"), px(cy + h / 2.0, img_h)),
    }


def intersection(a: dict, b: dict) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: dict, b: dict, floor: float = 1.0) -> Column:
    """Intersection over union; the union is floored so that empty boxes divide safely."""
    inter = intersection(a, b)
    size_a = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])
    size_b = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    return inter / F.greatest(F.lit(floor), size_a + size_b - inter)


def near_zone_ratio(x1, y1, x2, y2, frame_w, frame_h, top_fraction=None) -> Column:
    """Part of the bottom zone of the frame that the box covers."""
    f = DEFAULTS.near_zone_top_fraction if top_fraction is None else top_fraction
    top = frame_h * F.lit(float(f))
    zone = frame_w * (frame_h - top)
    w = F.least(frame_w.cast("double"), x2) - F.greatest(F.lit(0.0), x1)
    h = F.least(frame_h.cast("double"), y2) - F.greatest(top, y1)
    covered = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    return F.when(zone <= 0, F.lit(0.0)).otherwise(covered / zone)


def severity(ratio, cfg: Settings = DEFAULTS) -> Column:
    return (
        F.when(ratio < cfg.low_max_ratio, F.lit("Low"))
        .when(ratio < cfg.medium_max_ratio, F.lit("Medium"))
        .otherwise(F.lit("High"))
    )


def condition(index, cfg: Settings = DEFAULTS) -> Column:
    return (
        F.when(index < cfg.fair_min_index, F.lit("Good"))
        .when(index < cfg.poor_min_index, F.lit("Fair"))
        .otherwise(F.lit("Poor"))
    )


def canvas_box(x1, y1, x2, y2, frame_w, frame_h) -> dict[str, Column]:
    """Box truncated to whole pixels and clipped to the frame."""
    zero = F.lit(0).cast("bigint")
    return {
        "bx1": F.greatest(zero, x1.cast("bigint")),
        "by1": F.greatest(zero, y1.cast("bigint")),
        "bx2": F.least(frame_w.cast("bigint"), x2.cast("bigint")),
        "by2": F.least(frame_h.cast("bigint"), y2.cast("bigint")),
    }


def blur_plan(x1, y1, x2, y2, img_w, img_h) -> dict[str, Column]:
    """Clamped redaction box and its odd kernel size (at least 15)."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    cx1 = F.greatest(zero, F.least(img_w - one, x1.cast("bigint")))
    cy1 = F.greatest(zero, F.least(img_h - one, y1.cast("bigint")))
    cx2 = F.greatest(cx1 + one, F.least(img_w, x2.cast("bigint")))
    cy2 = F.greatest(cy1 + one, F.least(img_h, y2.cast("bigint")))

    def kernel(lo, hi):
        return F.floor((hi - lo) / F.lit(3)) * F.lit(2) + one

    size = F.greatest(F.lit(15).cast("bigint"), kernel(cx1, cx2), kernel(cy1, cy2))
    return {"px1": cx1, "py1": cy1, "px2": cx2, "py2": cy2, "ksize": size}
