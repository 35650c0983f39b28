"""Greedy one-to-one nearest matching of two defect sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators import cells
from roadloom.operators.ranking import BLOCK, blocked_rank
from roadloom.operators.spatial import site_pairs
from roadloom.session import cut

CROWDED = 64
FINEST_M = 0.01
#: plain rounds before chains are looked for; most inputs are settled by then
CHAINS_AFTER = 3


def _sites(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, "lat", "lon").agg(F.min("defect_id").alias("site"), F.count("*").alias("n"))


def _members(df: DataFrame, sites: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids of each place, numbered from 1."""
    at = df.select(*keys, "lat", "lon", "defect_id").join(sites.select(*keys, "lat", "lon", "site"), [*keys, "lat", "lon"])
    return blocked_rank(at.select("site", F.col("defect_id").alias("id")), ["site"], "id", "pos")


def _crowding(left: DataFrame, right: DataFrame, radius_m: float, keys: Sequence[str]) -> tuple[int, int]:
    """(pairs a radius join would compare, places) from counts per cell."""
    size = radius_m * 2.0
    a = left.withColumn("_c", cells.key("lat", "lon", size)).groupBy(*keys, "_c").agg(F.count("*").alias("a"))
    b = right.withColumn("_c", cells.key("lat", "lon", size)).groupBy(*keys, "_c").agg(F.count("*").alias("b"))
    row = (
        a.join(b, [*keys, "_c"], "full")
        .agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("pairs"), F.sum(F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))
        .first()
    )
    return int(row["pairs"] or 0), int(row["n"] or 0)


def greedy_match(left: DataFrame, right: DataFrame, radius_m: float, keys: Sequence[str] = ("class_name",)) -> DataFrame:
    """(l_id, r_id, d): repeatedly the closest free pair of the same keys within the radius.

    Pairs are ordered by (distance, left id, right id). ``defect_id`` is unique per side.

    Copies at one place share all their distances, so they are handled as one place with a
    count: its ids are used up in ascending order. In a round, a place whose nearest free
    partners all have it as their own only nearest is matched with them in bulk, by rank;
    for the rest, pairs that come first for both of their places are taken one by one.
    Every third round settles chains: where each pair waits for one closer pair alone, the first
    decides all of them, found by doubling steps, so a line of growing gaps takes a logarithm
    of its length. Where places are crowded the radius is widened in steps, which gives the same result
    because closer pairs come first anyway, and most places are used up before the wide
    steps.
    """
    keys = list(keys)
    l_sites, r_sites = cut(_sites(left, keys)), cut(_sites(right, keys))
    l_ids, r_ids = cut(_members(left, l_sites, keys)), cut(_members(right, r_sites, keys))
    ladder = [radius_m]
    while ladder[0] > FINEST_M:
        compared, places = _crowding(l_sites, r_sites, ladder[0], keys)
        if compared <= CROWDED * places:
            break
        ladder.insert(0, ladder[0] / 4.0)
    l_used = r_used = None
    matched: list[DataFrame] = []

    def free(sites: DataFrame, used: DataFrame | None) -> DataFrame:
        if used is None:
            return sites.withColumn("used", F.lit(0).cast("bigint"))
        return sites.join(used, "site", "left").withColumn("used", F.coalesce("used", F.lit(0))).filter("used < n")

    def tally(new: list[DataFrame], side: str) -> DataFrame:
        rows = _union([m.select(F.col(f"{side}_site").alias("site")) for m in new])
        return rows.groupBy("site").agg(F.count("*").alias("used"))

    for reach in ladder:
        l_free, r_free = free(l_sites, l_used), free(r_sites, r_used)
        pairs = site_pairs(l_free, r_free, reach, keys).select("l_site", "r_site", "d")
        for side, state in (("l", l_free), ("r", r_free)):
            pairs = pairs.join(
                state.select(F.col("site").alias(f"{side}_site"), F.col("used").alias(f"{side}_used"), (F.col("n") - F.col("used")).alias(f"{side}_left")),
                f"{side}_site",
            )
        pairs = cut(pairs)
        rounds = 0
        while not pairs.isEmpty():
            rounds += 1
            new = cut(_round(pairs, l_ids, r_ids) if rounds % CHAINS_AFTER else _chains(pairs, l_ids, r_ids))
            matched.append(new)
            for side in ("l", "r"):
                taken = tally([new], side).select(F.col("site").alias(f"{side}_site"), F.col("used").alias("k"))
                pairs = (
                    pairs.join(taken, f"{side}_site", "left")
                    .withColumn("k", F.coalesce("k", F.lit(0)))
                    .withColumn(f"{side}_used", F.col(f"{side}_used") + F.col("k"))
                    .withColumn(f"{side}_left", F.col(f"{side}_left") - F.col("k"))
                    .drop("k")
                )
            pairs = cut(pairs.filter("l_left > 0 and r_left > 0"))
        if matched and reach < radius_m:
            l_used, r_used = cut(tally(matched, "l")), cut(tally(matched, "r"))
    if not matched:
        return left.sparkSession.createDataFrame([], "l_id bigint, r_id bigint, d double")
    return _union(matched).select("l_id", "r_id", "d")


def _named(pairs: DataFrame, l_ids: DataFrame, r_ids: DataFrame) -> DataFrame:
    """Pairs with the next free id of either place."""
    for side, ids in (("l", l_ids), ("r", r_ids)):
        nxt = ids.select(F.col("site").alias(f"{side}_site"), F.col("id").alias(f"{side}_id"), (F.col("pos") - 1).alias(f"{side}_used"))
        pairs = pairs.join(nxt, [f"{side}_site", f"{side}_used"])
    return pairs


def _chains(pairs: DataFrame, l_ids: DataFrame, r_ids: DataFrame) -> DataFrame:
    """Matches (l_site, r_site, l_id, r_id, d) that follow from chains of pairs.

    A pair of places with one free id each, closer than all others of its places, is matched. If
    just one pair of its places is closer, it is matched exactly if that one is not. Each pair
    points to the one it waits for; pointers are doubled until they reach a settled pair, or
    one that waits for several and is left to the next round.
    """
    named = _named(pairs, l_ids, r_ids)
    at_l = Window.partitionBy("l_site").orderBy("d", "r_id")
    at_r = Window.partitionBy("r_site").orderBy("d", "l_id")
    ranked = named.withColumns({
        "before": F.row_number().over(at_l) + F.row_number().over(at_r) - 2, "by_l": F.lag("r_site").over(at_l), "by_r": F.lag("l_site").over(at_r),
    })
    single = (F.col("l_left") == 1) & (F.col("r_left") == 1)
    waits = single & (F.col("before") == 1)
    state = cut(ranked.select(
        "l_site", "r_site", "l_id", "r_id", "d", F.when(single & (F.col("before") == 0), True).alias("taken"),
        F.when(waits, F.when(F.col("by_l").isNotNull(), F.col("l_site")).otherwise(F.col("by_r"))).alias("to_l"),
        F.when(waits, F.when(F.col("by_l").isNotNull(), F.col("by_l")).otherwise(F.col("r_site"))).alias("to_r"), F.lit(True).alias("flip"),
    ))
    while not state.filter("taken is null and to_l is not null").isEmpty():
        ahead = state.select(
            F.col("l_site").alias("to_l"), F.col("r_site").alias("to_r"), F.col("taken").alias("a_taken"),
            F.col("to_l").alias("a_l"), F.col("to_r").alias("a_r"), F.col("flip").alias("a_flip"),
        )
        found = F.when(F.col("a_taken").isNotNull(), F.col("a_taken") != F.col("flip"))
        onward = F.col("a_taken").isNull() & F.col("a_l").isNotNull()
        state = cut(state.join(ahead, ["to_l", "to_r"], "left").select(
            "l_site", "r_site", "l_id", "r_id", "d", F.coalesce("taken", found).alias("taken"),
            F.when(onward, F.col("a_l")).alias("to_l"), F.when(onward, F.col("a_r")).alias("to_r"), (F.col("flip") != F.coalesce("a_flip", F.lit(False))).alias("flip"),
        ))
    return state.filter("taken").select("l_site", "r_site", "l_id", "r_id", "d")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _round(pairs: DataFrame, l_ids: DataFrame, r_ids: DataFrame) -> DataFrame:
    """Matches of one round: (l_site, r_site, l_id, r_id, d).

    pairs: l_site, r_site, d and per side the ids used and left of the place.
    """
    # nearest distance of a place and how many partners it has there, in one aggregation each
    def nearest(side: str) -> DataFrame:
        return pairs.groupBy(f"{side}_site", "d").agg(F.count("*").alias("ties")).groupBy(f"{side}_site").agg(
            F.min(F.struct("d", "ties")).alias("b")
        ).select(f"{side}_site", F.col("b.d").alias(f"{side}_d"), F.col("b.ties").alias(f"{side}_ties"))

    near = pairs.join(nearest("l"), "l_site").join(nearest("r"), "r_site")
    tight = near.filter("d = l_d and d = r_d")
    # per hub also how many ids its leaves can offer it
    pool_size = F.sum(F.least("l_left", "r_left"))
    l_star = tight.filter("r_ties = 1").groupBy("l_site").agg(F.count("*").alias("l_leaves"), pool_size.alias("l_pool"))
    r_star = tight.filter("l_ties = 1").groupBy("r_site").agg(F.count("*").alias("r_leaves"), pool_size.alias("r_pool"))
    kind = (
        F.when((F.col("r_ties") == 1) & (F.col("l_leaves") == F.col("l_ties")), F.lit("l"))
        .when((F.col("l_ties") == 1) & (F.col("r_leaves") == F.col("r_ties")), F.lit("r"))
        .otherwise(F.lit("x"))
    )
    tight = cut(
        tight.join(l_star, "l_site", "left").join(r_star, "r_site", "left").withColumn("kind", kind)
        .select("l_site", "r_site", "d", "kind", "l_used", "l_left", "r_used", "r_left", "l_pool", "r_pool")
    )
    facts = tight.agg(
        F.count_if(F.col("kind") == "x").alias("knots"),
        F.max(F.when(F.col("kind") == "l", F.col("l_pool")).when(F.col("kind") == "r", F.col("r_pool"))).alias("pool"),
    ).first()
    small = (facts["pool"] or 0) <= BLOCK

    def bulk(hub: str, leaf: str, hub_ids: DataFrame, leaf_ids: DataFrame) -> DataFrame:
        stars = tight.filter(F.col("kind") == hub)
        pool = (
            stars.join(leaf_ids.select(F.col("site").alias(f"{leaf}_site"), F.col("id").alias(f"{leaf}_id"), "pos"), f"{leaf}_site")
            .filter(F.col("pos").between(F.col(f"{leaf}_used") + 1, F.col(f"{leaf}_used") + F.col(f"{hub}_left")))
            .drop("pos")
        )
        # a pool that fits a block is sorted at once, larger ones in blocks
        if small:
            order = Window.partitionBy(f"{hub}_site").orderBy(f"{leaf}_id")
            ranked = pool.withColumn("j", F.row_number().over(order))
        else:
            ranked = blocked_rank(pool, [f"{hub}_site"], f"{leaf}_id", "j")
        ranked = ranked.filter(F.col("j") <= F.col(f"{hub}_left"))
        ranked = ranked.withColumn("pos", F.col(f"{hub}_used") + F.col("j"))
        hubs = hub_ids.select(F.col("site").alias(f"{hub}_site"), F.col("id").alias(f"{hub}_id"), "pos")
        return ranked.join(hubs, [f"{hub}_site", "pos"]).select("l_site", "r_site", "l_id", "r_id", "d")

    bulk_matched = bulk("l", "r", l_ids, r_ids).unionByName(bulk("r", "l", r_ids, l_ids))
    if not facts["knots"]:
        return bulk_matched
    # places in a knot of equal distances: the pair that comes first for both ends, by next free id
    named = _named(near.filter("d = l_d or d = r_d"), l_ids, r_ids)
    l_first = named.filter("d = l_d").groupBy("l_site").agg(F.min("r_id").alias("l_pick"))
    r_first = named.filter("d = r_d").groupBy("r_site").agg(F.min("l_id").alias("r_pick"))
    singles = (
        named.filter("d = l_d and d = r_d")
        .join(tight.filter("kind = 'x'").select("l_site", "r_site"), ["l_site", "r_site"])
        .join(l_first, "l_site")
        .join(r_first, "r_site")
        .filter("r_id = l_pick and l_id = r_pick")
        .select("l_site", "r_site", "l_id", "r_id", "d")
    )
    return bulk_matched.unionByName(singles)
