"""Areas of sets of boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.boxes import canvas_box


CROWDED = 256


def _tops_by_strip(clipped: DataFrame, strips: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes over the strips they span: one comparison per box and strip of a key."""
    return (
        clipped.join(strips, keys)
        .filter("sx >= bx1 and sx < bx2")
        .groupBy(*keys, "sx", "sw", "by1")
        .agg(F.max("by2").alias("by2"))
    )


def _tops_by_halves(clipped: DataFrame, strips: DataFrame, keys: list[str]) -> DataFrame:
    """The same through binary intervals: a box takes at most two per level, a strip looks up
    the one that holds its left edge on every level. For keys with very many boxes."""
    low, high = "((bx1 + shiftleft(1L, k) - 1) div shiftleft(1L, k))", "(bx2 div shiftleft(1L, k))"
    pieces = f"""filter(flatten(transform(sequence(0, length(bin(bx2))), k -> array(
        CASE WHEN {low} < {high} AND {low} % 2 = 1 THEN named_struct('k', k, 'at', {low}) END,
        CASE WHEN {low} < {high} AND {high} % 2 = 1 THEN named_struct('k', k, 'at', {high} - 1) END))), x -> x IS NOT NULL)"""
    nodes = (
        clipped.select(*keys, "by1", "by2", F.explode(F.expr(pieces)).alias("node"))
        .groupBy(*keys, "node", "by1")
        .agg(F.max("by2").alias("by2"))
    )
    looks = "transform(sequence(0, length(bin(top))), k -> named_struct('k', k, 'at', sx div shiftleft(1L, k)))"
    return (
        strips.select("*", F.explode(F.expr(looks)).alias("node"))
        .join(nodes, [*keys, "node"])
        .groupBy(*keys, "sx", "sw", "by1")
        .agg(F.max("by2").alias("by2"))
    )


def union_area(df: DataFrame, keys: Sequence[str], out: str = "union_px") -> DataFrame:
    """Pixels covered by at least one box, per key.

    Boxes are truncated to pixels and clipped to the frame, so a key
    holds at most one row per (strip, top edge) whatever its number of boxes: the boxes of
    a key are cut at all vertical edges, each strip keeps the lowest bottom per top edge,
    and the running bottom turns the strip into disjoint runs.
    """
    keys = list(keys)
    px = canvas_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "frame_w", "frame_h")])
    clipped = (
        df.select(*keys, *[e.alias(n) for n, e in px.items()])
        .filter("bx1 < bx2 and by1 < by2")
        .groupBy(*keys, "bx1", "bx2", "by1")
        .agg(F.max("by2").alias("by2"))
    )
    cuts = clipped.select(*keys, F.explode(F.array("bx1", "bx2")).alias("sx")).distinct()
    # ``top``: the right-most edge of the key bounds the levels a box of it can reach
    cuts = cuts.withColumn("top", F.max("sx").over(Window.partitionBy(*keys)))
    strips = cuts.withColumn("sw", F.lead("sx").over(Window.partitionBy(*keys).orderBy("sx")) - F.col("sx")).filter(
        F.col("sw").isNotNull()
    )
    crowded = clipped.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > CROWDED).select(*keys)
    tops = _tops_by_strip(clipped.join(crowded, keys, "left_anti"), strips, keys).unionByName(
        _tops_by_halves(
            clipped.join(crowded, keys, "left_semi"), strips.join(crowded, keys, "left_semi"), keys
        )
    )
    w = Window.partitionBy(*keys, "sx").orderBy("by1").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("by2") - F.greatest("by1", F.coalesce(F.max("by2").over(w), F.lit(0))))
    return (
        tops.withColumn("fresh", fresh).groupBy(*keys).agg(F.sum(F.col("fresh") * F.col("sw")).cast("bigint").alias(out))
    )


def summed_area(df: DataFrame, keys: Sequence[str], out: str = "sum_px") -> DataFrame:
    """Plain sum of box areas; overlaps count twice."""
    w = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1"))
    h = F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    return df.groupBy(*keys).agg(F.sum(w * h).alias(out))


def damage_index(df: DataFrame, keys: Sequence[str], near_zone_top: float = 0.0) -> DataFrame:
    """Union area over the frame area, or over the near zone when a top fraction is given."""
    dims = df.groupBy(*keys).agg(F.max("frame_w").alias("_w"), F.max("frame_h").alias("_h"))
    zone = F.col("_w") * (F.col("_h") - F.col("_h") * near_zone_top)
    index = F.when(zone > 0, F.coalesce("union_px", F.lit(0)) / zone).otherwise(F.lit(0.0))
    return (
        dims.join(union_area(df, keys), list(keys), "left")
        .withColumn("damage_index", index)
        .withColumn("union_px", F.coalesce("union_px", F.lit(0).cast("bigint")))
        .drop("_w", "_h")
    )
