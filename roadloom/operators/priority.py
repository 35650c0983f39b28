"""Repair priority, cost and the queue order."""

from __future__ import annotations

from itertools import chain as flat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.config import DEFAULTS, Settings
from roadloom.operators.ranking import blocked_rank
from roadloom.operators.spatial import flag_within, nearest_label

SEVERITY_RANK = {"High": 3, "Medium": 2, "Low": 1}


def lookup(key: Column, table: dict, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in flat.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def with_road_class(defects: DataFrame, vertices: DataFrame, ids: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    return nearest_label(
        defects, vertices, cfg.road_trust_m, "highway", cfg.default_road, ids, ["way_pos", "vertex_pos"]
    )


def sensitive(amenities: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    return amenities.filter(F.col("amenity").isin(*cfg.sensitive_kinds))


def with_exposure(defects: DataFrame, amenities: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    return flag_within(defects, amenities, cfg.exposure_radius_m, "exposed")


def priority(severity: Column, highway: Column, exposed: Column, recurrent: Column, cfg: Settings = DEFAULTS) -> Column:
    return (
        lookup(severity, cfg.severity_weights, 1.0)
        * lookup(highway, cfg.road_weights, float(cfg.road_weights.get("default", 1.0)))
        * F.when(exposed, F.lit(cfg.exposed_factor)).otherwise(F.lit(cfg.standard_factor))
        * F.when(recurrent, F.lit(cfg.recurrent_factor)).otherwise(F.lit(cfg.first_factor))
    )


def cost(severity: Column, cfg: Settings = DEFAULTS) -> Column:
    return lookup(severity, cfg.nominal_area_m2, 0.5) * F.lit(cfg.unit_rate)


def score(
    defects: DataFrame,
    vertices: DataFrame,
    amenities: DataFrame,
    ids: list[str],
    cfg: Settings = DEFAULTS,
    use_recurrence: bool = False,
) -> DataFrame:
    """Adds highway, exposed, priority and estimated_cost."""
    df = with_road_class(defects, vertices, ids, cfg)
    df = with_exposure(df, sensitive(amenities, cfg), cfg)
    recurrent = F.coalesce("recurrence", F.lit(False)) if use_recurrence else F.lit(False)
    return df.withColumn(
        "priority", priority(F.col("severity"), F.col("highway"), F.col("exposed"), recurrent, cfg)
    ).withColumn("estimated_cost", cost(F.col("severity"), cfg))


def queue(scored: DataFrame, keys: list[str] | None = None, out: str = "queue_rank") -> DataFrame:
    """Rank per survey: priority down, severity down, defect id up."""
    keys = ["survey_id"] if keys is None else keys
    ready = scored.withColumn("_p", F.coalesce("priority", F.lit(0.0))).withColumn(
        "_s", lookup(F.col("severity"), SEVERITY_RANK, 0)
    )
    return blocked_rank(ready, keys, "defect_id", out, lead=[("_p", False), ("_s", False)]).drop("_p", "_s")
