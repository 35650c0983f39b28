"""Radius operators: exists-within, nearest-within, candidate pairs, snapping to a trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.config import SNAP_METRES_PER_DEGREE
from roadloom.functions.geo import edge_distance, edge_fraction, haversine_m
from roadloom.operators import cells
from roadloom.session import cut

def flag_within(
    points: DataFrame, targets: DataFrame, radius_m: float, out: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Adds ``out``: is any target of the same ``keys`` within ``radius_m``?

    Points and targets are first summarised as the extents of small cells (radius / 8), so
    crowded places cost one row per small cell. Two extents that are surely inside or
    surely outside the radius are settled without looking at their members; only the thin
    ring between needs the coordinates, each distinct one once.
    """
    small, coarse = radius_m / 8.0, radius_m * 2.0
    pts = points.withColumn("_m", cells.key("lat", "lon", small))
    tgt = (
        targets.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .select(*keys, "lat", "lon")
        .withColumn("_m", cells.key("lat", "lon", small))
    )
    part = [*keys, "_m"]
    p_box, t_box = cells.summarise(pts, part), cells.summarise(tgt, part)
    reach = radius_m + 2.0 * small
    p_cells = p_box.withColumn(
        "_c", F.explode(cells.cover_box("lat1", "lat2", "lon1", "lon2", reach, coarse))
    )
    t_cells = t_box.withColumn("_c", cells.key("lat1", "lon1", coarse))
    cond = F.col("p._c") == F.col("q._c")
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"q.{k}"))
    near = (
        p_cells.alias("p")
        .join(t_cells.alias("q"), cond)
        .select(
            *[F.col(f"p.{k}").alias(k) for k in part], F.col("q._m").alias("_tm"), cells.verdict(radius_m).alias("_v")
        )
        .filter("_v >= 0")
    )
    near = cut(near)
    sure = near.filter("_v = 1").select(*part).distinct().withColumn("_hit", F.lit(True))
    ring = near.filter("_v = 0").join(sure, part, "left_anti").select(*part, "_tm")
    sites = pts.select(*part, "lat", "lon").distinct()
    t_sites = tgt.select(*keys, F.col("_m").alias("_tm"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    close = (
        sites.join(ring, part)
        .join(t_sites.distinct(), [*keys, "_tm"])
        .filter(haversine_m("lat", "lon", "t_lat", "t_lon") <= radius_m)
        .select(*part, "lat", "lon")
        .distinct()
        .withColumn("_close", F.lit(True))
    )
    return (
        pts.join(sure, part, "left")
        .join(close, [*part, "lat", "lon"], "left")
        .withColumn(out, F.coalesce("_hit", "_close", F.lit(False)))
        .select(*points.columns, out)
    )


def nearest_label(
    points: DataFrame,
    vertices: DataFrame,
    radius_m: float,
    label: str,
    default: str,
    ids: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """``label`` of the nearest vertex within the radius (ties: lowest ``order``), else the default."""
    size = 2.0 * radius_m
    sites = vertices.groupBy("lat", "lon").agg(F.min(F.struct(*order, label)).alias("v"))
    v = sites.select(
        F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"), "v", cells.key("lat", "lon", size).alias("_c")
    )
    # points of one place ask once
    probes = points.select("lat", "lon").distinct().withColumn(
        "_c", F.explode(cells.cover("lat", "lon", radius_m, size))
    )
    dist = haversine_m("lat", "lon", "v_lat", "v_lon")
    best = (
        probes.join(v, "_c")
        .withColumn("d", dist)
        .filter(F.col("d") <= radius_m)
        .groupBy("lat", "lon")
        .agg(F.min(F.struct("d", "v")).alias("b"))
        .select("lat", "lon", F.col(f"b.v.{label}").alias("_label"))
    )
    return (
        points.join(best, ["lat", "lon"], "left")
        .withColumn(label, F.coalesce("_label", F.lit(default)))
        .drop("_label")
    )


def site_pairs(left: DataFrame, right: DataFrame, radius_m: float, keys: Sequence[str]) -> DataFrame:
    """Pairs (l_site, r_site, d) of the same keys within the radius.

    Both inputs hold one row per distinct place: keys, site, lat, lon. Distances are kept
    to a micrometre, so equal geometry gives equal distances on every machine.
    """
    size = 2.0 * radius_m
    lc = left.select(
        *keys,
        F.col("site").alias("l_site"),
        F.col("lat").alias("l_lat"),
        F.col("lon").alias("l_lon"),
        F.explode(cells.cover("lat", "lon", radius_m, size)).alias("_c"),
    )
    rc = right.select(
        *keys,
        F.col("site").alias("r_site"),
        F.col("lat").alias("r_lat"),
        F.col("lon").alias("r_lon"),
        cells.key("lat", "lon", size).alias("_c"),
    )
    return (
        lc.join(rc, [*keys, "_c"])
        .withColumn("d", F.round(haversine_m("l_lat", "l_lon", "r_lat", "r_lon"), 6))
        .filter(F.col("d") <= radius_m)
        .select(*keys, "l_site", "r_site", "d")
    )


#: edges that a bundle may hold without being divided further; divisions, each an eighth of the last
BUNDLE, DIVISIONS = 64, 4
#: bundles are cells of a sixth of the ring, of this one for narrower rings
BUNDLE_RING_M = 25.0

_EDGE = ("seq", "p_lat", "p_lon", "n_lat", "n_lon", "from_m", "step_m")


def _plane() -> tuple:
    """Point and edge in metres, scaled at the edge's start."""
    lat_m = F.lit(SNAP_METRES_PER_DEGREE)
    lon_m = lat_m * F.cos(F.radians(F.col("p_lat")))
    return F.col("lon") * lon_m, F.col("lat") * lat_m, F.col("p_lon") * lon_m, F.col("p_lat") * lat_m, F.col("n_lon") * lon_m, F.col("n_lat") * lat_m


def _bundles(edges: DataFrame, division: int) -> DataFrame:
    """Edges whose starts share a cell, and whose ends do, as one row: the first edge, ``n`` and ``rho``.

    No edge of a bundle is further than ``rho`` from the first, as neither of its ends is.
    """
    up = [f"g{division - 1}"] if division else []
    extent = [f(c).alias(f"{c}_{tag}") for c in ("p_lat", "p_lon", "n_lat", "n_lon") for tag, f in (("lo", F.min), ("hi", F.max))]
    rows = edges.groupBy("survey_id", *up, f"g{division}").agg(F.count("*").alias("n"), F.min(F.struct(*_EDGE)).alias("e"), *extent)

    def wide(end: str):
        lat = (F.col(f"{end}_lat_hi") - F.col(f"{end}_lat_lo")) * F.lit(SNAP_METRES_PER_DEGREE)
        lon = (F.col(f"{end}_lon_hi") - F.col(f"{end}_lon_lo")) * F.lit(SNAP_METRES_PER_DEGREE)
        return F.sqrt(lat * lat + lon * lon)

    return rows.select("survey_id", *up, F.col(f"g{division}").alias("g"), "n", F.greatest(wide("p"), wide("n")).alias("rho"), "e.*")


def _bundle_cells(edges: DataFrame, ring_m: float) -> DataFrame:
    """Adds ``g0`` and on, the cells of an edge's two ends at each division."""
    width = max(ring_m, BUNDLE_RING_M) / 6.0
    for k in range(DIVISIONS):
        size = width / 8**k
        edges = edges.withColumn(f"g{k}", F.xxhash64("survey_id", cells.key("p_lat", "p_lon", size), cells.key("n_lat", "n_lon", size)))
    return edges


def _all_alone(edges: DataFrame, ring_m: float) -> bool:
    """Is every edge alone in its bundle? Equal edges share theirs."""
    return _bundle_cells(edges, ring_m).groupBy("survey_id", "g0").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _nearest_edges(sites: DataFrame, edges: DataFrame, ring_m: float, anywhere: bool, alone: bool | None = None) -> DataFrame:
    """(survey_id, lat, lon, b: d, seq, chain_m) of the nearest edge of each site that has one within the ring.

    Sites meet bundles of edges. Edges alone in their bundle are settled by one aggregation, which
    also bounds the rest from above. The first edge of a larger bundle less the bundle's width bounds
    it from below; bundles that can't hold the nearest edge are dropped, and large ones among the rest
    divided, down to single edges or few.
    """
    width = max(ring_m, BUNDLE_RING_M) / 6.0
    alone = _all_alone(edges, ring_m) if alone is None else alone
    edges = _bundle_cells(edges, ring_m)
    if alone:
        first = edges.select("survey_id", F.lit(0).cast("bigint").alias("g"), F.lit(1).cast("bigint").alias("n"), F.lit(0.0).alias("rho"), *_EDGE)
    else:
        first = cut(_bundles(edges, 0).select("survey_id", "g", "n", "rho", *_EDGE))
    if anywhere:
        keyed, probes = first.withColumn("_c", F.lit(0)), sites.withColumn("_c", F.lit(0))
    else:
        sizes = [ring_m * 8.0 * 8**n for n in range(8)]
        level = F.lit(7)
        for n in range(6, -1, -1):
            level = F.when(F.col("step_m") <= sizes[n], F.lit(n)).otherwise(level)
        size = f"{ring_m * 8.0!r}D * pow(8D, _lvl)"
        # the edges of a bundle lie within its cells' diagonal of the first
        pad = ring_m * 1.001 + (0.0 if alone else width * 1.5)
        span = cells.cover_box("least(p_lat, n_lat)", "greatest(p_lat, n_lat)", "least(p_lon, n_lon)", "greatest(p_lon, n_lon)", pad, size)
        keyed = first.withColumn("_lvl", level)
        present = sorted(r["_lvl"] for r in keyed.select("_lvl").distinct().collect())
        # hashes of cells are shorter to shuffle; a collision only adds an edge to measure
        keyed = keyed.withColumn("_c", F.explode(span)).withColumn("_c", F.xxhash64("_lvl", "_c"))
        probes = sites.withColumn("_lvl", F.explode(F.array(*[F.lit(n) for n in present]))).withColumn("_c", F.xxhash64("_lvl", cells.key("lat", "lon", size)))
    site = ["survey_id", "lat", "lon"]
    cell = ["survey_id", "_c"]
    at = F.struct(edge_distance(*_plane()).alias("d"), "seq", (F.col("from_m") + edge_fraction(*_plane()) * F.col("step_m")).alias("chain_m"))
    met = probes.join(keyed, cell).withColumn("at", at)
    if alone:
        return met.groupBy(*site).agg(F.min("at").alias("b"))
    bound = cut(met.groupBy(*site).agg(F.min("at.d").alias("best"), F.min(F.when(F.col("n") == 1, F.col("at"))).alias("b")))
    columns = [*site, "g", "n", "rho", *_EDGE, "best"]
    met = probes.join(keyed.filter("n > 1"), cell).join(bound.select(*site, "best"), site).select(*columns)
    division = 0
    while True:
        met = met.withColumn("d", edge_distance(*_plane())).withColumn("best", F.least("best", F.min("d").over(Window.partitionBy(*site))))
        met = cut(met.filter(F.col("d") - F.col("rho") <= F.col("best") * 1.00001 + 1e-6))
        division += 1
        if division == DIVISIONS or met.filter(F.col("n") > BUNDLE).isEmpty():
            break
        parts = _bundles(edges, division).withColumnRenamed(f"g{division - 1}", "up")
        divided = met.filter("n > 1").select(*site, "best", F.col("g").alias("up")).join(parts, ["survey_id", "up"]).select(*columns)
        met = met.filter("n = 1").select(*columns).unionByName(divided)
    single = met.filter("n = 1").select(*site, *_EDGE)
    few = met.filter("n > 1").select(*site, F.col("g").alias(f"g{division - 1}")).join(edges, ["survey_id", f"g{division - 1}"]).select(*site, *_EDGE)
    rest = single.unionByName(few).select(*site, at.alias("b"))
    return bound.filter("b is not null").select(*site, "b").unionByName(rest).groupBy(*site).agg(F.min("b").alias("b"))


def snap_to_trace(points: DataFrame, chain: DataFrame, ids: Sequence[str], ring_m: float = 5.0) -> DataFrame:
    """Adds ``chain_m`` and ``snap_m``: metres along the survey's trace at its nearest edge, and the offset.

    Points of one place are one site, and equal edges their first. Edges are entered in the
    cells within ``ring_m`` of them; long edges use coarser grids so that no edge takes more
    than a few cells. A nearest edge closer than the ring is final. Sites that found none
    search again with a ring eight times as wide. A survey without edges gives chainage 0.
    """
    shape = ["survey_id", "p_lat", "p_lon", "n_lat", "n_lon"]
    edges = chain.filter(F.col("p_lat").isNotNull()).select(
        "survey_id", "seq", "p_lat", "p_lon", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"),
        (F.col("cum_m") - F.col("step_m")).alias("from_m"), "step_m",
    )
    alone = _all_alone(edges, ring_m)
    if not alone:
        edges = cut(edges.groupBy(*shape).agg(F.min(F.struct("seq", "from_m", "step_m")).alias("e")).select(*shape, "e.*"))
    site = ["survey_id", "lat", "lon"]
    pending = points.select(*site).distinct().join(edges.select("survey_id").distinct(), "survey_id", "left_semi")
    found: DataFrame | None = None
    while True:
        last = ring_m > 2.5e7
        near = _nearest_edges(pending, edges, ring_m, last, alone or None).select(*site, F.col("b.d").alias("snap_m"), F.col("b.chain_m").alias("chain_m"))
        near = cut(near if last else near.filter(F.col("snap_m") <= ring_m * 0.999))
        found = near if found is None else found.unionByName(near)
        pending = pending.join(near, site, "left_anti")
        if last or pending.isEmpty():
            break
        pending, alone = cut(pending), False
        ring_m *= 8.0
    return points.join(found, site, "left").withColumn("chain_m", F.coalesce("chain_m", F.lit(0.0)))
