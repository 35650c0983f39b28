"""SimHash near-duplicates: 64-bit fingerprints, joined over binary tries."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from roadloom.llm.common import landed, release
from roadloom.operators.components import connected_components

#: bits per stride of the trie; a node pair is extended by one stride at a time
STRIDES = (13, 13, 13, 13, 12)


@F.pandas_udf(LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """Fingerprint of whole texts as a signed long: A-Z lower-cased, words by ASCII white space,
    3-word shingles with repeats, XXH64 with seed 42; a bit is set if over half of them set it."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype="uint64")
    for row, text in enumerate(texts):
        words = text.encode("utf-8").lower().split() if text else []
        if not words:
            continue
        n = max(len(words) - 2, 1)
        # shingles are slices of the joined words: no join for each
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype="int64", count=len(words)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        stops = (ends[2:] - 1).tolist() if len(words) > 2 else [len(joined)]
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), dtype="uint64", count=n)
        bits = np.zeros(64, dtype="int64")
        for at in range(0, n, 4096):
            part = hashes[at : at + 4096].astype("<u8").view("uint8").reshape(-1, 8)
            bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="int64")
        out[row] = np.packbits(2 * bits > n, bitorder="little").view("<u8")[0]
    release()
    return pd.Series(out.view("int64"))


def _orders() -> list[list[int]]:
    """Every order of the strides that differs in which two come first."""
    return [[*pair, *(k for k in range(5) if k not in pair)] for pair in combinations(range(5), 2)]


def _arranged(fp: Column, order: list[int]) -> Column:
    """The bits of ``fp`` with its strides in the given order, the first at the top."""
    out, top = F.lit(0).cast("long"), 64
    starts = [sum(STRIDES[:k]) for k in range(5)]
    for k in order:
        top -= STRIDES[k]
        bits = F.shiftrightunsigned(fp, starts[k]).bitwiseAND(F.lit((1 << STRIDES[k]) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bits, top))
    return out


def _depths(order: list[int]) -> list[int]:
    """Bits below each level: after the exact first two strides, then stride by stride."""
    done = STRIDES[order[0]] + STRIDES[order[1]]
    found = [64 - done]
    for k in order[2:]:
        done += STRIDES[k]
        found.append(64 - done)
    return found


def _neighbour_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) at one differing bit: with that bit cleared both are equal, so a key has two at most."""
    return (
        fps.select("fp", F.explode(F.expr("transform(sequence(0, 63), i -> struct(i as bit, fp & ~shiftleft(1L, i) as rest))")).alias("_k"))
        .groupBy("_k").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("a <> b").select("a", "b")
    )


def near_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join the same components as all
    pairs at ``budget`` (3 at most) or fewer differing bits.

    Two such fingerprints agree in two of the five strides. So ten tries are joined with
    themselves, one for each choice of the first two strides: there only nodes of equal prefix
    are paired. Pairs of nodes then go down together, stride by stride; differing bits add up
    and a pair over the budget is dropped. First, links at one bit (found by clearing each
    bit) are merged to components; a pair of nodes whose leaves all lie in one component is
    dropped too, so a dense group of copies isn't expanded into all its pairs.
    """
    if not 0 <= budget <= 3:
        raise ValueError("the strides find links at up to 3 bits")
    orders = [(_arranged(F.col("fp"), o), _depths(o)) for o in _orders()]
    tries = F.array(*[F.struct(F.lit(t).alias("trie"), bits.alias("leaf"), F.lit(d[0]).alias("d0"), F.lit(d[1]).alias("d1"), F.lit(d[2]).alias("d2")) for t, (bits, d) in enumerate(orders)])
    leaves = fps.select("fp", F.explode(tries).alias("t")).select(
        "fp", "t.*", F.expr("shiftrightunsigned(t.leaf, t.d0)").alias("p0")
    )
    # only nodes with company are looked at further
    crowded = leaves.groupBy("trie", "p0").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    leaves = landed(leaves.join(crowded, ["trie", "p0"]), "simhash-leaves")
    near = landed(_neighbour_links(leaves.select("fp").distinct()) if budget else _none(fps), "simhash-near")
    comp = landed(connected_components(near), "simhash-near-components")
    leaves = leaves.join(comp, leaves.fp == comp.node, "left").select(
        "fp", "trie", "leaf", "p0",
        F.expr("shiftrightunsigned(leaf, d1)").alias("p1"), F.expr("shiftrightunsigned(leaf, d2)").alias("p2"),
        F.coalesce("component", "fp").alias("c"),
    )
    mixed = leaves.groupBy("trie", "p0").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
    leaves = landed(leaves.join(mixed.select("trie", "p0"), ["trie", "p0"]), "simhash-mixed")

    def nodes(parent: str, own: str) -> DataFrame:
        return leaves.groupBy("trie", parent, own).agg(F.min("c").alias("lo"), F.max("c").alias("hi"))

    def side(level: DataFrame, parent: str, own: str, tag: str) -> DataFrame:
        return level.select("trie", F.col(parent).alias(f"{tag}_up"), F.col(own).alias(tag), F.col("lo").alias(f"{tag}_lo"), F.col("hi").alias(f"{tag}_hi"))

    one_component = "a_lo = a_hi and b_lo = b_hi and a_lo = b_lo"
    # the prefixes of a pair differ in exactly the bits counted on the way down
    differing = F.bit_count(F.expr("a ^ b"))
    alive = f"err <= {budget} and not ({one_component})"
    pairs = None
    for parent, own in (("p0", "p1"), ("p1", "p2"), ("p2", "leaf")):
        level = nodes(parent, own)
        a, b = side(level, parent, own, "a"), side(level, parent, own, "b")
        if pairs is None:
            both = a.join(b.withColumnRenamed("b_up", "a_up"), ["trie", "a_up"]).filter("a <= b")
        else:
            up = pairs.select("trie", F.col("a").alias("a_up"), F.col("b").alias("b_up"))
            both = up.join(a, ["trie", "a_up"]).join(b, ["trie", "b_up"]).filter("a_up <> b_up or a <= b")
        pairs = both.withColumn("err", differing).filter(alive).select("trie", "a", "b")
    ids = leaves.select("trie", "leaf", "fp").distinct()
    far = (
        pairs.filter("a <> b")
        .join(ids.select("trie", F.col("leaf").alias("a"), F.col("fp").alias("fa")), ["trie", "a"])
        .join(ids.select("trie", F.col("leaf").alias("b"), F.col("fp").alias("fb")), ["trie", "b"])
        .select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    )
    return near.unionByName(far).distinct()


def _none(fps: DataFrame) -> DataFrame:
    return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("false")


def near_duplicates(docs: DataFrame, budget: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """Fingerprint and near-duplicate class of every document.

    ``docs``: doc_id, text. Returns doc_id, fingerprint (16 hex digits), component_id (the
    smallest doc_id reachable over fingerprints at ``budget`` or fewer differing bits, itself
    included). Null, empty and wordless texts have fingerprint zero and link like any other.
    Copies are one fingerprint before anything is joined. Repeated rows get a row each; a
    null doc_id takes part but never names a class unless all ids of the class are null.
    Other columns are not read, except those in ``carry``, which come along with ``class_fp``: a
    fingerprint that names the class whatever its ids are.
    """
    marked = landed(docs.select(*carry, F.col("doc_id"), simhash(F.coalesce("text", F.lit(""))).alias("fp")), "simhash")
    classes = landed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    comp = landed(connected_components(near_links(classes.select("fp"), budget)), "simhash-components")
    named = classes.join(comp, classes.fp == comp.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("c")
    )
    smallest = named.groupBy("c").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "c").select("fp", "component_id", F.col("c").alias("class_fp"))
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *carry, *(["class_fp"] if carry else [])
    )
