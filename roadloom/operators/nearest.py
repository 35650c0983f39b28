"""Nearest pair of images of one group in different splits: by name over a trie, by hash over bit budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators.hashing import band_keys, bit_agreement, hamming, plan_bands
from roadloom.session import cut


def _mixed(images: DataFrame) -> DataFrame:
    """Images of groups with more than one split."""
    groups = images.groupBy("grp").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo <> hi").select("grp")
    return images.join(groups, "grp")


def name_trie(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of a trie of the names of each group, one close pair per node: a, b).

    Edges: grp, up, node (both prefixes), label (the text between), is_end and end_split where a
    name ends, leaf where none goes on, lo and hi (first and last split below), last (the last name below). Prefixes
    with a single continuation and no end are passed over.
    """
    names = images.select("grp", "image", "split")
    spots = F.sequence(F.lit(0), F.length("image"))
    prefixes = names.select("grp", "image", "split", F.explode(F.transform(spots, lambda n: F.struct(F.substring(F.col("image"), F.lit(1), n).alias("node"), n.alias("n")))).alias("p")).select("grp", "image", "split", "p.*")
    ends = F.col("n") == F.length("image")
    # a substring past the end is empty, so an ending counts as a continuation of its own
    follow = F.substring(F.col("image"), F.col("n") + 1, F.lit(1))
    nodes = prefixes.groupBy("grp", "node").agg(
        F.min(F.struct("split", "image")).alias("first"), F.max(F.struct("split", "image")).alias("final"), F.max("image").alias("last"),
        F.min(follow).alias("f1"), F.max(follow).alias("f2"), F.max(F.when(ends, F.col("split"))).alias("end_split"), F.bool_or(ends).alias("is_end"),
    )
    nodes = cut(nodes.filter("is_end or f1 <> f2 or node = ''"))
    # the node above is the longest kept prefix: each node asks for all of its own, in one join
    asks = nodes.select("grp", "node", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.length("node") - 1, F.lit(0))), lambda n: F.substring(F.col("node"), F.lit(1), n))).alias("up")).filter("node <> ''")
    above = asks.join(nodes.select("grp", F.col("node").alias("up")), ["grp", "up"]).groupBy("grp", "node").agg(F.max("up").alias("up"))
    edges = nodes.join(above, ["grp", "node"]).select(
        "grp", "up", "node", F.substring(F.col("node"), F.length("up") + 1, F.length("node")).alias("label"), "is_end", (F.col("f2") == "").alias("leaf"), "end_split",
        F.col("first.split").alias("lo"), F.col("final.split").alias("hi"), "last",
    )
    close = nodes.filter("first.split <> final.split").select(F.least("first.image", "final.image").alias("a"), F.greatest("first.image", "final.image").alias("b"))
    return cut(edges), close


def _within(bound: int) -> str:
    """May a name that starts with ``node`` be within the bound of ``x``? Asks the entries of the row of edit
    distances between x's prefixes and the node that can be so low, by the built-in distance with a limit."""
    low = f"greatest(0, length(node) - {bound})"
    return f"exists(sequence({low}, greatest({low}, least(length(x), length(node) + {bound}))), i -> levenshtein(substring(x, 1, i), node, {bound}) >= 0)"


def nearest_names(images: DataFrame) -> DataFrame:
    """The pair of images of one group, in different splits, with the closest names.

    ``images``: grp, image (distinct), split. One row (a, b, edit_distance), a < b, or none; ties
    go to the pair first in name order. Every name walks down the trie of its group at once; a
    walk ends where no name below a node can be as close as the best pair known, by the row of
    edit distances to the node's prefix. The first bound is the closest of one cross-split pair
    per trie node, and it shrinks with each level that reaches a closer pair.
    """
    spark = images.sparkSession
    images = cut(_mixed(images.select("grp", "image", "split")))
    edges, close = name_trie(images)
    pair = F.struct(F.levenshtein("a", "b").alias("d"), F.col("a"), F.col("b"))
    best = close.agg(F.min(pair).alias("p")).first()["p"]
    schema = "a string, b string, edit_distance bigint"
    if best is None:
        return spark.createDataFrame([], schema)
    at = images.select("grp", F.col("image").alias("x"), "split", F.lit("").alias("up"))
    while True:
        reached = cut(
            at.join(edges, ["grp", "up"])
            .filter("(lo <> split or hi <> split) and last > x")
            .filter("not leaf or (end_split <> split and x < node)")
            .withColumn("d", F.when(F.col("is_end") & (F.col("end_split") != F.col("split")) & (F.col("x") < F.col("node")), F.levenshtein("x", "node", best["d"])))
            .filter(F.when(F.col("leaf"), F.col("d") >= 0).otherwise(F.expr(_within(best["d"]))))
            .select("grp", "x", "split", "node", "leaf", "d")
        )
        found = reached.filter("d >= 0").agg(F.min(F.struct("d", F.col("x").alias("a"), F.col("node").alias("b"))).alias("p")).first()["p"]
        if found is not None:
            best = min(best, found)
        at = reached.filter("not leaf").select("grp", "x", "split", F.col("node").alias("up"))
        if at.isEmpty():
            break
    return spark.createDataFrame([(best["a"], best["b"], best["d"])], schema)


def nearest_hashes(images: DataFrame) -> DataFrame:
    """The pair of images of one group, in different splits, with the fewest differing hash bits.

    ``images``: grp, image, split, hash (64 bits, null where there is none). One row (a, b,
    distance), a < b, or none; ties go to the pair first in name order. Copies of a hash in
    one split are its first image. The budget of bits doubles until some pair keeps it; for
    each budget two hashes meet only where they share a band of bits within the group.
    """
    spark = images.sparkSession
    rows = _mixed(images.filter("hash is not null").select("grp", "image", "split", "hash"))
    rows = cut(rows.groupBy("grp", "split", "hash").agg(F.min("image").alias("image")))
    n, same = bit_agreement(rows)
    schema = "a string, b string, distance bigint"
    budget = 0
    while n:
        bands, wide, narrow = plan_bands(n, same, budget)
        p = rows.select("*", band_keys(bands, wide).alias("k")).alias("p")
        q = rows.select("*", band_keys(bands, narrow).alias("k")).alias("q")
        met = p.join(q, (F.col("p.grp") == F.col("q.grp")) & (F.col("p.k") == F.col("q.k")) & (F.col("p.split") != F.col("q.split")))
        pairs = met.select(hamming(F.col("p.hash"), F.col("q.hash")).alias("distance"), F.least("p.image", "q.image").alias("a"), F.greatest("p.image", "q.image").alias("b"))
        best = pairs.filter(F.col("distance") <= budget).agg(F.min(F.struct("distance", "a", "b")).alias("p")).first()["p"]
        if best is not None:
            return spark.createDataFrame([(best["a"], best["b"], best["distance"])], schema)
        if budget >= 64:
            break
        budget = min(2 * budget + 1, 64)
    return spark.createDataFrame([], schema)
