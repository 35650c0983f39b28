"""Connected components of an edge DataFrame, and single-linkage clusters of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import METRES_PER_DEGREE, haversine_m
from roadloom.operators import cells
from roadloom.session import cut


def connected_components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest node of the component of every node that has an edge.

    ``edges`` holds ``keys``, ``a``, ``b``; the result ``keys``, ``node``, ``component``.
    Alternates two contractions: every node hands its larger neighbours to its smallest
    neighbour, then its smaller ones. Each round is two partial aggregations and two joins,
    checkpointed; the number of rounds grows with the logarithm of the component size.
    """
    part = [*keys, "u"]
    tidy = edges.select(
        *keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).filter("u <> v").distinct()
    current = cut(tidy)
    while True:
        both = current.unionByName(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*part).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, part).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        small_low = large.groupBy(*part).agg(F.min("v").alias("m"))
        linked = large.join(small_low, part)
        following = cut(
            linked.filter("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(linked.select(*keys, "u", F.col("m").alias("v")))
            .distinct()
        )
        current = following
        # done when every edge leads from a node of its own straight to a root
        ends = current.select(*keys, F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            current.select(*keys, F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        busy = ends.groupBy(*keys, "x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if busy.filter("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
    return current.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def linked_cells(points: DataFrame, radius_m: float, keys: Sequence[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """Cells of mutually near points, and the links between cells.

    A cell's diagonal is below the radius, so all its points are one cluster and no pair
    inside it is looked at. Two cells are linked when some pair across them is within the
    radius: extents of cells settle almost all of them, extents of sub-cells most of the
    others, exact coordinates the rest. Cells meet in a coarse grid of 8 radii.
    Returns (cells: keys, _cell, node; links: keys, a, b). ``node`` is the smallest id.
    """
    size, coarse = radius_m * 0.7, radius_m * 8.0
    tagged = points.select(*keys, id_col, "lat", "lon").withColumn("_cell", cells.key("lat", "lon", size))
    nodes = cut(cells.extents(tagged, [*keys, "_cell"], F.min(id_col).alias("node")))
    extent = ("lat1", "lat2", "lon1", "lon2")

    def end(df: DataFrame, at: str, to) -> DataFrame:
        # hashes of cells sort faster; a collision only adds a candidate, and links are made distinct
        return df.withColumn("_to", to).select(
            *keys, F.xxhash64(*keys, "_to").alias("_to"), F.col("node").alias(f"{at}_node"),
            *[F.col(c).alias(f"{at}_{c}") for c in extent]
        )

    # a cell's corner is less than a radius away from all its points; no two points are nearer than their latitudes
    apart = f"greatest(q_lat1 - p_lat2, p_lat1 - q_lat2) <= {radius_m * cells.SLACK / METRES_PER_DEGREE!r}D"
    p = end(nodes, "p", F.explode(cells.cover_box(*extent, radius_m * 2.0, coarse)))
    q = end(nodes, "q", cells.key("lat1", "lon1", coarse))
    pairs = (
        p.join(q, ["_to", *keys])
        .filter("p_node < q_node")
        .filter(apart)
        .withColumns({"p": cells.angles("p_"), "q": cells.angles("q_")})
        .withColumn("_v", cells.verdict(radius_m))
        .filter("_v >= 0")
        # the least latitude and longitude of a cell lie in it, so cells needn't be shuffled
        .select(
            *keys, *[cells.key(f"{at}_lat1", f"{at}_lon1", size).alias(f"_{at}c") for at in "pq"], F.col("p_node").alias("a"), F.col("q_node").alias("b"), "q", "_v"
        )
    )
    pairs = cut(pairs)
    ends = [*keys, "_pc", "_qc"]
    open_pairs = pairs.filter("_v = 0").select(*ends, "q")
    asked = open_pairs.select(*keys, F.col("_pc").alias("_cell")).union(open_pairs.select(*keys, F.col("_qc").alias("_cell"))).distinct()
    inside = tagged.join(asked, [*keys, "_cell"], "left_semi").withColumn("_sub", cells.key("lat", "lon", size / 8.0))
    subs = cut(cells.extents(inside, [*keys, "_cell", "_sub"])).select(*keys, "_cell", "_sub", cells.angles("").alias("box"))

    def sides(df: DataFrame, at: str, *columns) -> DataFrame:
        return df.select(*keys, F.col("_cell").alias(f"_{at}c"), F.col("_sub").alias(f"_{at}s"), *columns)

    near = cut(
        open_pairs.join(sides(subs, "p", F.col("box").alias("p")), [*keys, "_pc"])
        .filter(cells.verdict(radius_m) >= 0)
        .drop("q")
        .join(sides(subs, "q", F.col("box").alias("q")), [*keys, "_qc"])
        .select(*ends, "_ps", "_qs", cells.verdict(radius_m).alias("_v"))
        .filter("_v >= 0")
    )
    sure = near.filter("_v = 1").select(*ends).distinct()
    unsure = near.filter("_v = 0").join(sure, ends, "left_anti")
    sites = inside.select(*keys, "_cell", "_sub", "lat", "lon").distinct()
    exact = (
        unsure.join(sides(sites, "p", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), [*keys, "_pc", "_ps"])
        .join(sides(sites, "q", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")), [*keys, "_qc", "_qs"])
        .filter(haversine_m("p_lat", "p_lon", "q_lat", "q_lon") <= radius_m)
        .select(*ends)
        .distinct()
    )
    settled = pairs.filter("_v = 0").join(sure.unionByName(exact), ends, "left_semi")
    links = pairs.filter("_v = 1").unionByName(settled).select(*keys, "a", "b")
    return nodes.select(*keys, "_cell", "node"), links


def linked_flags(points: DataFrame, radius_m: float, keys: Sequence[str], id_col: str) -> DataFrame:
    """Adds ``linked``: does another point of the same keys lie within the radius?

    Points that share a cell have a partner by construction. A point alone in its cell is
    compared with the neighbouring cells only, so no crowded cell meets another.
    """
    size = radius_m * 0.7
    tagged = points.withColumn("_cell", cells.key("lat", "lon", size))
    count = tagged.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    tagged = tagged.join(count, [*keys, "_cell"])
    alone = tagged.filter("_n = 1").withColumn(
        "_to", F.explode(F.filter(cells.cover("lat", "lon", radius_m, size), lambda c: c != F.col("_cell")))
    )
    sites = tagged.select(*keys, F.col("_cell").alias("_to"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")).distinct()
    partner = (
        alone.join(sites, [*keys, "_to"])
        .filter(haversine_m("lat", "lon", "q_lat", "q_lon") <= radius_m)
        .select(*keys, id_col)
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    return (
        tagged.join(partner, [*keys, id_col], "left")
        .withColumn("linked", (F.col("_n") > 1) | F.coalesce("_hit", F.lit(False)))
        .select(*points.columns, "linked")
    )


def clusters(points: DataFrame, radius_m: float, keys: Sequence[str], id_col: str) -> DataFrame:
    """Single-linkage clusters: adds ``component``, the smallest id of the point's cluster."""
    size = radius_m * 0.7
    nodes, links = linked_cells(points, radius_m, keys, id_col)
    comp = connected_components(links, keys)
    labelled = (
        nodes.join(comp, [*keys, "node"], "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select(*keys, "_cell", "component")
    )
    return (
        points.withColumn("_cell", cells.key("lat", "lon", size))
        .join(labelled, [*keys, "_cell"])
        .drop("_cell")
    )
