"""GPS traces: accuracy filter, chainage, and positions at given times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.config import DEFAULTS, Settings
from roadloom.functions.geo import haversine_m
from roadloom.operators.ranking import BLOCK, blocked_previous, blocked_running_sum
from roadloom.session import cut

#: what the chainage of a trace is made of
TRACE = ("survey_id", "seq", "timestamp_s", "lat", "lon")

LEVELS = 6
FANOUT = 64


def accuracy_filter(gps: DataFrame, max_accuracy_m: float | None) -> DataFrame:
    """Keep points of unknown or sufficient accuracy; null or 0 switches the filter off."""
    if not max_accuracy_m:
        return gps
    return gps.filter(F.col("accuracy_m").isNull() | (F.col("accuracy_m") <= max_accuracy_m))


def edges(gps: DataFrame, block_rows: int = BLOCK, keep_block: bool = False) -> DataFrame:
    """Each trace point with its predecessor in file order and the metres between them."""
    prev = blocked_previous(gps, ["survey_id"], "seq", ["timestamp_s", "lat", "lon"], block_rows=block_rows, keep_block=keep_block)
    step = haversine_m("p_lat", "p_lon", "lat", "lon")
    return prev.withColumn("step_m", F.coalesce(step, F.lit(0.0)))


def chainage(gps: DataFrame, cfg: Settings = DEFAULTS, block_rows: int = BLOCK) -> DataFrame:
    """Edges with metres along the trace (``cum_m``) and the time-gap flag."""
    # both steps use one block, so the rows are dealt once
    e = edges(gps, block_rows, keep_block=True)
    e = blocked_running_sum(e, ["survey_id"], "seq", "step_m", "cum_m", F.col("_blk"))
    gap = F.col("timestamp_s") - F.col("p_timestamp_s") > cfg.max_time_gap_s
    return e.withColumn("is_gap", F.coalesce(gap, F.lit(False)))


def route_length_km(gps: DataFrame) -> DataFrame:
    return edges(gps).groupBy("survey_id").agg((F.sum("step_m") / 1000.0).alias("route_km"))


def _intervals(gps: DataFrame) -> DataFrame:
    """Consecutive pairs that run forward in time, clipped to the trace's first and last time."""
    e = edges(gps).filter(F.col("p_timestamp_s") <= F.col("timestamp_s"))
    ends = gps.groupBy("survey_id").agg(
        F.min_by("timestamp_s", "seq").alias("t_first"), F.max_by("timestamp_s", "seq").alias("t_last")
    )
    return e.join(ends, "survey_id").select(
        "survey_id",
        "seq",
        F.col("p_timestamp_s").alias("t1"),
        F.col("timestamp_s").alias("t2"),
        F.col("p_lat").alias("lat1"),
        F.col("p_lon").alias("lon1"),
        F.col("lat").alias("lat2"),
        F.col("lon").alias("lon2"),
        F.greatest("p_timestamp_s", "t_first").alias("lo"),
        F.least("timestamp_s", "t_last").alias("hi"),
    ).filter("lo <= hi")


def _lookup(gps: DataFrame, cfg: Settings, width: float) -> DataFrame:
    """Intervals keyed by (survey, time bucket).

    Usable intervals are no longer than a bucket, so they take at most two keys. Longer
    ones only matter where they come first in file order and so void a usable one: they
    are clipped to the buckets that hold usable intervals, found through a ladder of
    coarser buckets, and carry no position.
    """
    # read three times below, and a trace is far smaller than its detections
    iv = cut(_intervals(gps).withColumn("gap", F.col("t2") - F.col("t1")))
    cols = ["survey_id", "bucket", "seq", "lo", "hi", "t1", "gap", "lat1", "lon1", "lat2", "lon2"]
    usable = (
        iv.filter(F.col("gap") <= cfg.max_time_gap_s)
        .withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
        .select(*cols)
    )
    level = F.lit(LEVELS)
    for n in range(LEVELS - 1, 0, -1):
        level = F.when(F.col("gap") <= width * FANOUT**n, F.lit(n)).otherwise(level)
    span = F.pow(F.lit(float(FANOUT)), F.col("lvl")) * width
    voids = (
        iv.filter(F.col("gap") > cfg.max_time_gap_s)
        .withColumn("lvl", level)
        .withColumn("rung", F.explode(F.sequence(F.floor(F.col("lo") / span), F.floor(F.col("hi") / span))))
        .select("survey_id", "lvl", "rung", "seq", "lo", "hi")
    )
    live = (
        usable.select("survey_id", "bucket")
        .distinct()
        .withColumn("lvl", F.explode(F.array(*[F.lit(n) for n in range(1, LEVELS + 1)])))
        .withColumn("rung", F.floor(F.col("bucket") / F.pow(F.lit(float(FANOUT)), F.col("lvl"))))
    )
    start, end = F.col("bucket") * width, (F.col("bucket") + 1) * width
    clipped = (
        live.join(voids, ["survey_id", "lvl", "rung"])
        .filter((F.col("lo") < end) & (F.col("hi") >= start))
        .groupBy("survey_id", "bucket", F.greatest("lo", start).alias("lo"), F.least("hi", end).alias("hi"))
        .agg(F.min("seq").alias("seq"))
    )
    empty = F.lit(None).cast("double")
    return usable.unionByName(
        clipped.select(
            "survey_id", "bucket", "seq", "lo", "hi", *[empty.alias(c) for c in cols[5:]]
        )
    )


def interpolate(probes: DataFrame, gps: DataFrame, probe_key: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """Position at time ``t`` of every probe row; ``lat``/``lon`` null where there is none.

    ``probe_key`` identifies a row of ``probes`` (it includes ``survey_id``). The first
    interval in file order that contains ``t`` decides, even when it is too long.
    """
    width = max(16.0, 2.0 * cfg.max_time_gap_s)
    keyed = probes.select(*probe_key, "t").withColumn("bucket", F.floor(F.col("t") / width))
    hit = keyed.alias("p").join(
        _lookup(gps, cfg, width).alias("g"),
        (F.col("p.survey_id") == F.col("g.survey_id"))
        & (F.col("p.bucket") == F.col("g.bucket"))
        & F.col("p.t").between(F.col("g.lo"), F.col("g.hi")),
    )
    part = F.when(F.col("gap") == 0.0, F.lit(0.0)).otherwise((F.col("p.t") - F.col("t1")) / F.col("gap"))
    found = (
        hit.select(
            *[F.col(f"p.{k}") for k in probe_key],
            "seq",
            (F.col("lat1") + part * (F.col("lat2") - F.col("lat1"))).alias("lat"),
            (F.col("lon1") + part * (F.col("lon2") - F.col("lon1"))).alias("lon"),
        )
        .groupBy(*probe_key)
        .agg(F.min(F.struct("seq", "lat", "lon")).alias("g"))
        .select(*probe_key, "g.lat", "g.lon")
    )
    return probes.join(found, probe_key, "left")
