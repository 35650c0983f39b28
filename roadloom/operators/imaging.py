"""Detector output and box sets per image: decoding, suppression, region checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.config import CLASS_CODES, DEFAULTS, Settings
from roadloom.functions import boxes
from roadloom.session import cut

BOX = ("x1", "y1", "x2", "y2")


def decode(predictions: DataFrame, names: Sequence[str] = CLASS_CODES, cfg: Settings = DEFAULTS) -> DataFrame:
    """Best class of every raw row (first on a tie), corner box, rows above the threshold.

    ``predictions`` holds image_id, pos, cx, cy, w, h and ``scores``, an array per class.
    """
    best = F.array_max("scores")
    cls = F.array_position("scores", best).cast("int")
    table = F.array(*[F.lit(n) for n in names])
    name = F.coalesce(F.try_element_at(table, cls), F.concat(F.lit("cls_"), (cls - 1).cast("string")))
    c = boxes.corners(*[F.col(x) for x in ("cx", "cy", "w", "h")])
    return predictions.filter(best > cfg.conf_thres).select(
        "image_id", "pos", name.alias("class_name"), best.alias("score"), *[c[x].alias(x) for x in BOX]
    )


#: boxes of a block beyond which it is divided along y too; overlaps of an image that one task walks
CROWDED, WALKED = 64, 1_000_000


def _side(alias: str) -> dict:
    return {c: F.col(f"{alias}.{c}") for c in BOX}


def _scale_keys(threshold: float, lo: str, hi: str) -> tuple[Column, Column]:
    """Blocking key of a box along one axis, and the keys of every box whose overlap may exceed the threshold.

    Overlap t needs sides within a factor 1/t and centres within (1 - t) / (1 + t) of the
    mean side. Boxes are keyed by the class of their side and by the position
    of their centre on that class's own grid.
    """
    t = threshold
    base = 1.0 / t
    w, c = F.col(hi) - F.col(lo), (F.col(lo) + F.col(hi)) / 2.0
    k = F.floor(F.log(w) / F.lit(math.log(base)))

    def pitch(k: Column) -> Column:
        return F.pow(F.lit(base), k + 1.0) * ((1.0 - t) / (1.0 + t))

    own = F.struct(k.alias("k"), F.floor(c / pitch(k)).alias("p"))

    def near(dk: Column) -> Column:
        kk = k + dk
        reach = (w + F.pow(F.lit(base), kk + 1.0)) * (1.000001 * (1.0 - t) / (2.0 * (1.0 + t)))
        return F.transform(
            F.sequence(F.floor((c - reach) / pitch(kk)), F.floor((c + reach) / pitch(kk))),
            lambda p: F.struct(kk.alias("k"), p.alias("p")),
        )

    around = F.flatten(F.transform(F.array(*[F.lit(d).cast("bigint") for d in (-1, 0, 1)]), near))
    return own, around


def blocked_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Pairs (structs a, b) of boxes of the same keys that may overlap by more than the threshold.

    Boxes are blocked by width and x; where a block holds many boxes, as in a column of them, by
    height and y as well.
    """
    if threshold >= 1.0:  # only equal boxes reach 1
        own = F.struct(*[F.col(c).cast("double") for c in BOX])
        around, own_y, around_y = F.array(own), F.lit(0), F.array(F.lit(0))
    elif threshold < 1e-3:  # sizes may differ without bound
        own, around, own_y, around_y = F.lit(0), F.array(F.lit(0)), F.lit(0), F.array(F.lit(0))
    else:
        own, around = _scale_keys(threshold, "x1", "x2")
        own_y, around_y = _scale_keys(threshold, "y1", "y2")
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    part = [*keys, "_x"]
    b = right.filter(solid).withColumn("_x", own)
    crowds = b.groupBy(*part).agg(F.count("*").alias("_n")).filter(F.col("_n") > CROWDED).select(*part, F.lit(True).alias("_crowd"))
    crowd = F.coalesce("_crowd", F.lit(False))
    a = left.filter(solid).withColumn("_x", F.explode(around)).join(crowds, part, "left")
    a = a.withColumn("_y", F.explode(F.when(crowd, F.transform(around_y, lambda y: F.hash(y))).otherwise(F.array(F.lit(0)))))
    b = b.join(crowds, part, "left").withColumn("_y", F.when(crowd, F.hash(own_y)).otherwise(F.lit(0)))
    return (
        a.select(*part, "_y", F.struct(*left.columns).alias("a")).join(b.select(*part, "_y", F.struct(*right.columns).alias("b")), [*part, "_y"]).select("a", "b")
    )


def overlapping(
    left: DataFrame, right: DataFrame, keys: Sequence[str], threshold: float, l_cols: Sequence[str], r_cols: Sequence[str],
    strict: bool = True, floor: float = 0.0,
) -> DataFrame:
    """Pairs of the same keys whose overlap exceeds (or reaches) the threshold.

    Columns come out as l_<name> and r_<name>. Boxes without area overlap nothing. Pairs of equal
    rows may come out repeatedly.
    """
    score = boxes.iou(_side("a"), _side("b"), floor)
    hit = score > threshold if strict else score >= threshold
    return blocked_pairs(left, right, keys, threshold).filter(hit).select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        *[F.col(f"a.{c}").alias(f"l_{c}") for c in l_cols],
        *[F.col(f"b.{c}").alias(f"r_{c}") for c in r_cols],
    )


def _losers(batches):
    """Edges (image_id, winner, loser), best winner of an image first, to the boxes that go.

    When a winner comes up, all better boxes have had their turn, so its own fate is known.
    """
    import pandas as pd

    image, gone, out = None, set(), []
    for batch in batches:
        for at, winner, loser in zip(batch["image_id"].tolist(), batch["winner"].tolist(), batch["loser"].tolist(), strict=True):
            if at != image:
                image, gone = at, set()
            if winner not in gone and loser not in gone:
                gone.add(loser)
                out.append((at, loser))
        yield pd.DataFrame(out, columns=["image_id", "pos"])
        out = []


def suppress(detections: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Greedy suppression per image, whatever the class: best score first, drop what overlaps it.

    Equal scores go to the lower ``pos``. Identical boxes fall to their best one at once.
    The overlaps of an image are then walked once in the order of the better box; in images
    with more than ``WALKED`` of them rounds do it: a box with no better live neighbour stays, its
    neighbours go. No overlap exceeds 1, so at that threshold every box stays.
    """
    if cfg.iou_threshold >= 1.0:
        return detections
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    first = F.struct((-F.col("score")).alias("s"), F.col("pos"))
    distinct = detections.filter(solid).groupBy("image_id", *BOX).agg(F.min(first).alias("f"))
    heads = cut(distinct.select("image_id", F.col("f.pos").alias("pos"), (-F.col("f.s")).alias("score"), *BOX))
    pairs = overlapping(heads, heads, ["image_id"], cfg.iou_threshold, ["pos", "score"], ["pos", "score"])
    better = (F.col("l_score") > F.col("r_score")) | ((F.col("l_score") == F.col("r_score")) & (F.col("l_pos") < F.col("r_pos")))
    edges = cut(pairs.filter(better).select("image_id", F.col("l_pos").alias("winner"), F.col("l_score").alias("score"), F.col("r_pos").alias("loser")).distinct())
    large = cut(edges.groupBy("image_id").agg(F.count("*").alias("n")).filter(F.col("n") > WALKED).select("image_id"))
    kinds = ", ".join(f"{name} {edges.schema[edge].dataType.simpleString()}" for name, edge in (("image_id", "image_id"), ("pos", "loser")))
    walked = edges.join(large, "image_id", "left_anti").repartition("image_id").sortWithinPartitions("image_id", F.col("score").desc(), "winner").mapInPandas(_losers, kinds)
    rest = edges.join(large, "image_id", "left_semi").drop("score")
    out = heads.select("image_id", "pos").join(walked, ["image_id", "pos"], "left_anti").join(large, "image_id", "left_anti")
    if not large.isEmpty():
        out = out.unionByName(_kept_by_rounds(heads.join(large, "image_id", "left_semi"), rest))
    flat = detections.filter(~solid).select("image_id", "pos")
    return detections.join(out.unionByName(flat), ["image_id", "pos"], "left_semi")


def _kept_by_rounds(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """(image_id, pos) of the boxes that stay, a few joins a round."""
    edges = cut(edges)
    kept = heads.select("image_id", "pos").join(
        edges.select("image_id", F.col("loser").alias("pos")), ["image_id", "pos"], "left_anti"
    )
    kept_parts = [kept]
    fresh = kept
    while not edges.isEmpty():
        gone = edges.join(fresh.select("image_id", F.col("pos").alias("winner")), ["image_id", "winner"]).select(
            "image_id", "loser"
        ).distinct()
        gone = cut(gone)
        survivors = edges.join(gone, ["image_id", "loser"], "left_anti")
        lost = gone.select("image_id", F.col("loser").alias("winner"))
        remaining = cut(survivors.join(lost, ["image_id", "winner"], "left_anti"))
        # boxes whose every better neighbour has been dropped stay
        fresh = cut(
            survivors.select("image_id", F.col("loser").alias("pos"))
            .distinct()
            .join(remaining.select("image_id", F.col("loser").alias("pos")), ["image_id", "pos"], "left_anti")
        )
        kept_parts.append(fresh)
        edges = remaining
    out = kept_parts[0]
    for part in kept_parts[1:]:
        out = out.unionByName(part)
    return out


def sensitive_candidates(
    regions: DataFrame, img_w: int, img_h: int, faces: bool = True, plates: bool = True
) -> DataFrame:
    """Boxes shaped like a face or a licence plate, tagged with ``kind``; a box may be both."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share = w * h / F.lit(float(img_w * img_h))
    tall, wide = h / F.greatest(F.lit(1.0), w), w / F.greatest(F.lit(1.0), h)
    face = regions.filter(F.lit(faces) & share.between(0.005, 0.40) & tall.between(0.8, 2.2)).withColumn("kind", F.lit("face"))
    plate = regions.filter(F.lit(plates) & share.between(0.002, 0.25) & wide.between(1.8, 5.5)).withColumn(
        "kind", F.lit("license_plate")
    )
    return face.unionByName(plate)


def region_recall(labels: DataFrame, regions: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Share of labelled boxes met by a region of the same image and kind.

    labels / regions: image_id, kind, pos, box. Equal regions are looked at once.
    """
    keys = ["image_id", "kind"]
    distinct = regions.select(*keys, *BOX).distinct().withColumn("pos", F.lit(0))
    hits = overlapping(labels, distinct, keys, threshold, ["pos"], ["pos"], strict=False, floor=1.0)
    met = hits.select(*keys, F.col("l_pos").alias("pos")).distinct().withColumn("hit", F.lit(1))
    return (
        labels.join(met, [*keys, "pos"], "left")
        .groupBy("kind")
        .agg(F.count("*").alias("total"), F.count("hit").alias("matched"))
        .withColumn("recall", F.col("matched") / F.col("total"))
    )
