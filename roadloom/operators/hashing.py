"""Similarity of 64-bit image hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2, prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.text import stem
from roadloom.operators.components import connected_components
from roadloom.session import cut

#: comparisons that cost as much as one key written, shuffled and joined
KEY_COST = 4
#: comparisons of packed hashes that cost as much as one of joined rows
PACKED_COST = 64
#: hashes of a block that is compared as a whole, and rows of it at a time
PACK, TILE = 1 << 14, 64


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("bigint")


def _ball(bits: int, radius: int) -> int:
    return sum(comb(bits, r) for r in range(radius + 1))


def deal_bits(same: list[float], n_bands: int) -> list[list[int]]:
    """Bit positions of each band; ``same``: chance that two hashes agree in a bit.

    The most telling bits are dealt first, each to the band that tells least so far. Bits that
    never vary tell nothing and stay out.
    """
    bands: list[list[int]] = [[] for _ in range(n_bands)]
    told = [0.0] * n_bands
    for p in sorted(range(len(same)), key=lambda p: (same[p], p)):
        if same[p] < 1:
            to = min(range(n_bands), key=lambda b: (told[b], b))
            bands[to].append(p)
            told[to] -= log2(same[p])
    return bands


def plan_bands(n: int, same: list[float], threshold: int) -> tuple[list[list[int]], int, int]:
    """The bands, and the flips on either side, that promise the least work for ``n`` hashes.

    Of m bands of two hashes within the threshold, one differs in at most threshold // m bits; the
    two meet if one flips up to half of them and the other the rest. Few wide bands are
    selective but need many keys, so m follows from the threshold, the count and the bits.
    """
    return _cheapest(n, same, threshold)[1:]


def _cheapest(n: int, same: list[float], threshold: int) -> tuple[float, list[list[int]], int, int]:
    """``plan_bands`` and its cost in comparisons."""
    best = None
    for m in range(1, threshold + 2):
        bands = deal_bits(same, m)
        flips = threshold // m
        a, b = flips - flips // 2, flips // 2
        width = max(map(len, bands))
        keys = m * (_ball(width, a) + (_ball(width, b) if a != b else 0))
        meet = sum(min(1.0, _ball(len(band), flips) * prod(same[p] for p in band)) for band in bands)
        cost = KEY_COST * n * keys + n * n / 2 * meet
        if keys <= 1 << 12 and (best is None or cost < best[0]):
            best = (cost, bands, a, b)
    return best


def band_keys(bands: list[list[int]], flips: int) -> Column:
    """(band, value) keys of a hash: the value of each band, and all that are up to ``flips`` bits away."""
    keys = []
    for band, bits in enumerate(bands):
        value = " | ".join(f"shiftleft(shiftrightunsigned(hash, {p}) & 1L, {i})" for i, p in enumerate(bits)) or "0L"
        masks = [sum(1 << i for i in chosen) for r in range(flips + 1) for chosen in combinations(range(len(bits)), r)]
        keys.append(f"transform(array({', '.join(f'{m}L' for m in masks)}), m -> named_struct('band', {band}, 'value', ({value}) ^ m))")
    return F.explode(F.expr(f"concat({', '.join(keys)})"))


def bit_agreement(values: DataFrame) -> tuple[int, list[float]]:
    """Number of rows, and for each bit of ``hash`` the chance that two rows agree in it."""
    row = values.selectExpr("count(*) AS n", *[f"sum(shiftrightunsigned(hash, {p}) & 1) AS b{p}" for p in range(64)]).first()
    ones = [(row[f"b{p}"] or 0) / max(row["n"], 1) for p in range(64)]
    return row["n"], [q * q + (1 - q) * (1 - q) for q in ones]


def keyed(hashes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(hash, k) of the distinct hashes from either side: two within the threshold share a key."""
    values = cut(hashes.select("hash").filter("hash is not null").distinct())
    bands, a, b = plan_bands(*bit_agreement(values), threshold)
    side_a = values.select("hash", band_keys(bands, a).alias("k"))
    return side_a, side_a if a == b else values.select("hash", band_keys(bands, b).alias("k"))


def candidates(side_a: DataFrame, side_b: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a key, once for each key."""
    a, b = side_a.alias("a"), side_b.alias("b")
    order = F.col("a.hash") < F.col("b.hash") if side_a is side_b else F.col("a.hash") != F.col("b.hash")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & order).select(F.least("a.hash", "b.hash").alias("a"), F.greatest("a.hash", "b.hash").alias("b"))


def similar_pairs(hashes: DataFrame, threshold: int = 10) -> DataFrame:
    """Distinct hash values (a, b), a < b, at most ``threshold`` bits apart.

    Copies of a hash are one value, null is none. Hashes that share a key are compared on all bits.
    """
    return candidates(*keyed(hashes, threshold)).filter(hamming(F.col("a"), F.col("b")) <= threshold).distinct()


def _apart(p: str, q: str) -> Column:
    """Bits in which every hash of one group differs from every hash of the other."""
    return F.expr(f"bit_count(({p}.every & ~{q}.any) | (~{p}.any & {q}.every))")


def hash_links(hashes: DataFrame, threshold: int = 10) -> tuple[DataFrame, DataFrame]:
    """(component of each hash linked so far: node, component; pairs left open: c1, c2, a, b).

    The hashes of a key are first compared with its smallest and largest alone, which merges
    groups of near copies in linear work. What a key then holds of one component is one node
    with the bits all its hashes have and those any has; two nodes are opened only where these
    leave it possible that two of their hashes are within the threshold.
    """
    both = cut(keyed(hashes, threshold)[0])  # it has the keys of the other side too
    ends = both.groupBy("k").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).filter("lo <> hi")
    near = both.join(ends, "k").select("hash", F.explode(F.array("lo", "hi")).alias("end")).filter("hash <> end")
    near = near.filter(hamming(F.col("hash"), F.col("end")) <= threshold).select(F.col("hash").alias("a"), F.col("end").alias("b"))
    comp = cut(connected_components(near))
    placed = cut(both.join(comp.withColumnRenamed("node", "hash"), "hash", "left").withColumn("c", F.coalesce("component", "hash")).select("k", "c", "hash"))
    nodes = placed.groupBy("k", "c").agg(F.bit_and("hash").alias("every"), F.bit_or("hash").alias("any"), F.count("*").alias("n"))
    mixed = placed.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("k")
    nodes = cut(nodes.join(mixed, "k"))
    pairs = nodes.alias("p").join(nodes.alias("q"), (F.col("p.k") == F.col("q.k")) & (F.col("p.c") < F.col("q.c"))).filter(_apart("p", "q") <= threshold)
    pairs = pairs.select(F.col("p.k").alias("k"), F.col("p.c").alias("c1"), F.col("q.c").alias("c2"))
    first = placed.select("k", F.col("c").alias("c1"), F.col("hash").alias("a"))
    second = placed.select("k", F.col("c").alias("c2"), F.col("hash").alias("b"))
    return comp, pairs.join(first, ["k", "c1"]).join(second, ["k", "c2"])


def merging_links(h1: np.ndarray, c1: np.ndarray, h2: np.ndarray, c2: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between components of two blocks of hashes that merge all that any pair of theirs links.

    Every hash of one is compared with every one of the other, unless they are one component by then. Each
    link returned merges two, so there are fewer than hashes.
    """
    names, own = np.unique(np.r_[c1, c2], return_inverse=True)
    h1, h2, l1, l2 = h1.view("uint64"), h2.view("uint64"), own[: len(c1)], own[len(c1) :]
    root, links = np.arange(len(names)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for s in range(0, len(h1), TILE):
        most = np.argmax(np.bincount(np.r_[l1, l2]))  # of two hashes of it, none is looked at
        rows = np.arange(s, min(s + TILE, len(h1)))
        others = l2 != most
        for row, col in ((rows[l1[rows] != most], np.arange(len(h2))), (rows[l1[rows] == most], np.flatnonzero(others))):
            if not len(row) or not len(col):
                continue
            a, b = np.nonzero(np.bitwise_count(h1[row][:, None] ^ h2[col][None, :]) <= threshold)
            x, y = l1[row[a]], l2[col[b]]
            new = np.unique(x[x != y] * len(names) + y[x != y])
            for x, y in zip((new // len(names)).tolist(), (new % len(names)).tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    links.append((int(names[x]), int(names[y])))
            if len(new):
                while (root[root] != root).any():
                    root = root[root]
                l1, l2 = root[l1], root[l2]
    return links


def _block_links(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """Merging links (a, b) of the blocks that share ``j``. Blocks: j (and i on the left), h and c as arrays."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h1, c1, h2, c2 in zip(batch["h1"], batch["c1"], batch["h2"], batch["c2"], strict=True):
                yield pd.DataFrame(merging_links(h1, c1, h2, c2, threshold), columns=["a", "b"], dtype="int64")

    met = left.select("i", "j", F.col("h").alias("h1"), F.col("c").alias("c1")).join(right.select("j", F.col("h").alias("h2"), F.col("c").alias("c2")), "j")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(n, "i", "j").drop("i", "j").mapInPandas(compare, "a long, b long")


def _packed(rows: DataFrame, slot: Column) -> DataFrame:
    """Blocks (slot, h, c) of the hashes and components in ``rows`` (hash, c)."""
    each = rows.groupBy(slot.alias("slot")).agg(F.collect_list(F.struct("hash", "c")).alias("m"))
    return cut(each.select("slot", F.col("m.hash").alias("h"), F.col("m.c").alias("c")))


def packed_components(values: DataFrame, n: int, threshold: int) -> DataFrame:
    """Components (hash, c) of the ``n`` distinct hashes ``values`` by links within the threshold.

    Blocks of PACK hashes are compared as a whole with themselves and with the first block, which is linear and
    merges most where links are many. What is not in the largest component by then is compared with
    everything, so no link is missed; the shuffle has the hashes once for each such block.
    """
    blocks = ceil(n / PACK) or 1
    dealt = F.pmod(F.xxhash64("hash"), F.lit(blocks))
    packs = _packed(values.select("hash", F.col("hash").alias("c")), dealt)
    first = F.when(F.col("slot") == 0, F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(F.col("slot").cast("int")))
    links = _block_links(packs.select(F.col("slot").alias("i"), F.explode(first).alias("j"), "h", "c"), packs.withColumnRenamed("slot", "j"), threshold)
    comp = cut(_relabelled(values.select("hash", F.col("hash").alias("c")), links))
    if blocks == 1:
        return comp
    top = comp.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").first()
    if top["n"] == n:
        return comp
    loose, rest = ceil((n - top["n"]) / PACK), ceil(top["n"] / PACK)
    slot = F.when(F.col("c") != top["c"], F.pmod(F.xxhash64("hash"), F.lit(loose))).otherwise(loose + F.pmod(F.xxhash64("hash"), F.lit(rest)))
    packs = _packed(comp, slot)
    left = packs.filter(F.col("slot") < loose).select(F.col("slot").alias("i"), F.explode(F.sequence(F.col("slot").cast("int"), F.lit(loose + rest - 1))).alias("j"), "h", "c")
    return _relabelled(comp, _block_links(left, packs.withColumnRenamed("slot", "j"), threshold))


def _relabelled(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (hash, c) after ``links`` between them."""
    upper = connected_components(links).select(F.col("node").alias("c"), "component")
    return comp.join(upper, "c", "left").select("hash", F.coalesce("component", "c").alias("c"))


def hash_groups(images: DataFrame, threshold: int = 10) -> DataFrame:
    """Adds ``grp``: the smallest image name of the cluster; an image without hash is its own stem.

    Clusters are single linkage over hashes within the threshold; no list of pairs is made. Where keys would be too many
    or say too little, as for a wide threshold, the hashes are compared in blocks.
    """
    values = cut(images.select("hash").filter("hash is not null").distinct())
    n, same = bit_agreement(values)
    if n * n / 2 / PACKED_COST < _cheapest(n, same, threshold)[0]:
        comp = packed_components(values, n, threshold)
    else:
        near, opened = hash_links(images, threshold)
        links = opened.filter(hamming(F.col("a"), F.col("b")) <= threshold).select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct()
        own = values.join(near.withColumnRenamed("node", "hash"), "hash", "left").select("hash", F.coalesce("component", "hash").alias("c"))
        comp = _relabelled(own, links)
    named = images.join(comp, "hash", "left")
    names = named.filter("hash is not null").groupBy("c").agg(F.min("image").alias("_first"))
    return named.join(names, "c", "left").withColumn("grp", F.coalesce("_first", stem(F.col("image")))).select(*images.columns, "grp")
