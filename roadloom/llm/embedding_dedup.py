"""Embedding near-duplicates by NN-descent within labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import landed
from roadloom.operators.components import connected_components

#: vectors per side of an exact block
BLOCK = 1024


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length one, in double precision."""
    out = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _usable():
    """A label, and a finite vector that isn't zero."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.col("label").isNotNull() & F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.coalesce(some & ~odd, F.lit(False))


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, grp, vec, copies; members: vec_id, node).

    Vectors that are null, empty, zero or hold null or non-finite components have no node, nor
    have rows without a label. Equal vectors of a label are one node, named by a 64-bit hash.
    """
    usable = (
        vectors.select("vec_id", "label", "embedding").filter(_usable())
        .withColumn("grp", F.xxhash64(F.col("label").cast("string"), F.size("embedding")))
        .withColumn("node", F.xxhash64("grp", "embedding"))
    )
    usable = landed(usable, "vectors")
    nodes = usable.groupBy("node").agg(F.first("grp").alias("grp"), F.first("embedding").alias("vec"), F.count("*").alias("copies"))
    return landed(nodes, "vector-nodes"), usable.select("vec_id", "node")


def first_graph(nodes: DataFrame, lists: int, trees: int, reach: int, leaf: int = 50) -> DataFrame:
    """Start lists (u, v, s) from random projections.

    In each of ``trees`` orders the vectors of a group are sorted by the signs of their
    projections on random directions and then by one more projection; each is compared with the ``reach``
    next ones on both sides, whatever the size of a cell. Dealt by range, so no group is one task.
    """
    largest = nodes.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    depth = int(np.clip(np.ceil(np.log2(max(largest / leaf, 1))), 0, 48))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["vec"].map(len)):
                unit = _unit(part["vec"])
                for tree in range(trees):
                    planes = np.random.default_rng([tree, size]).standard_normal((size, depth + 1))
                    shadow = unit @ planes
                    code = (shadow[:, :depth] > 0) @ (1 << np.arange(depth, dtype="int64")) if depth else np.zeros(len(part), dtype="int64")
                    yield pd.DataFrame({
                        "grp": part["grp"], "tree": tree, "code": code, "last": shadow[:, depth],
                        "node": part["node"], "vec": part["vec"],
                    })

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            batch = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            fresh = 0 if kept is None else len(kept)
            kept = batch.iloc[-reach:]
            for _, part in batch.groupby(["grp", "tree"], sort=False):
                unit, node = _unit(part["vec"]), part["node"].to_numpy()
                new = part.index.to_numpy() >= fresh
                found = []
                for step in range(1, min(reach, len(part) - 1) + 1):
                    use = new[step:]  # pairs within the rows carried over were compared before
                    s = np.einsum("ij,ij->i", unit[:-step][use], unit[step:][use])
                    found += [(node[:-step][use], node[step:][use], s), (node[step:][use], node[:-step][use], s)]
                if not found:
                    continue
                u, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((v, -s, u))
                u, v, s = u[order], v[order], s[order]
                starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.r_[starts, len(u)]))
                yield pd.DataFrame({"u": u, "v": v, "s": s})[rank < lists]

    spread = nodes.select("node", "grp", "vec").mapInPandas(project, "grp long, tree int, code long, last double, node long, vec array<float>")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = spread.repartitionByRange(n, "grp", "tree", "code", "last").sortWithinPartitions("grp", "tree", "code", "last", "node")
    return _best(ordered.mapInPandas(neighbours, f"u long, v long, s double"), lists)


def _best(pairs: DataFrame, lists: int) -> DataFrame:
    """The best ``lists`` partners of each u; ties by v."""
    # a pair may come with sums of another order: one value per pair
    one = pairs.groupBy("u", "v").agg(F.max("s").alias("s"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), "v"))), 1, lists)
    return one.groupBy("u").agg(top.alias("_t")).select("u", F.explode("_t").alias("_t")).select(
        "u", F.col("_t.v").alias("v"), (-F.col("_t.d")).alias("s")
    )


def descend(nodes: DataFrame, graph: DataFrame, lists: int) -> DataFrame:
    """One round: all pairs among the neighbours of a node, in either direction, are compared,
    and each keeps those that better its list. A node's reverse neighbours are sampled down to
    ``lists`` by hash, as usual; the audit and the exact blocks stand in for what that may miss.
    """
    worst = graph.groupBy("u").agg(F.min("s").alias("w"), F.count("*").alias("n"))
    worst = worst.select("u", F.when(F.col("n") >= lists, F.col("w")).otherwise(-2.0).alias("w"))
    forward = graph.select(F.col("u").alias("x"), F.col("v").alias("m"))
    backward = (
        graph.groupBy(F.col("v").alias("x"))
        .agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("u", "v").alias("h"), F.col("u").alias("m")))), 1, lists).alias("_b"))
        .select("x", F.explode("_b.m").alias("m"))
    )
    around = (
        forward.unionByName(backward).distinct()
        .join(worst.withColumnRenamed("u", "m"), "m", "left").withColumn("w", F.coalesce("w", F.lit(-2.0)))
        .join(nodes.select(F.col("node").alias("m"), "vec"), "m")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            batch = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            whole = batch["x"] != batch["x"].iloc[-1] if len(batch) else []
            kept = batch[~whole].reset_index(drop=True) if len(batch) else None
            yield _compared(batch[whole])
        if kept is not None:
            yield _compared(kept)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = around.repartition(n, "x").sortWithinPartitions("x").mapInPandas(compare, f"u long, v long, s double")
    return _best(graph.unionByName(found), lists)


def _compared(part: pd.DataFrame) -> pd.DataFrame:
    """Pairs of members of the same x that better the list of the first."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(part):
        unit, m, w, x = _unit(part["vec"]), part["m"].to_numpy(), part["w"].to_numpy(), part["x"].to_numpy()
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(x)], strict=True):
            s = unit[a:b] @ unit[a:b].T
            np.fill_diagonal(s, -3.0)
            i, j = np.nonzero(s > w[a:b, None])
            out.append((m[a:b][i], m[a:b][j], s[i, j]))
    u, v, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.array([], dtype="int64"),) * 3
    found = pd.DataFrame({"u": u, "v": v, "s": s.astype("float64")})
    return found.sort_values("s").drop_duplicates(["u", "v"], keep="last")


def audit(nodes: DataFrame, component: DataFrame, threshold: float, queries: int = 1024) -> tuple[int, int]:
    """(links found, links there are) of at most ``queries`` nodes against all nodes, brute force.

    The sample (smallest hashes) is bounded and broadcast. A link counts as found if both
    ends are in one component.
    """
    sample = nodes.select("node", "grp", "vec").orderBy(F.xxhash64(F.lit("audit"), "node")).limit(queries).toPandas()
    shared = nodes.sparkSession.sparkContext.broadcast(sample)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = shared.value
        for batch in batches:
            for grp, part in batch.groupby("grp"):
                own = ask[ask["grp"] == grp]
                if len(own):
                    i, j = np.nonzero(_unit(own["vec"]) @ _unit(part["vec"]).T >= threshold)
                    yield pd.DataFrame({"a": own["node"].to_numpy()[i], "b": part["node"].to_numpy()[j]})

    there = nodes.select("node", "grp", "vec").mapInPandas(compare, "a long, b long").filter("a <> b")
    side = component.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    other = component.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    row = there.join(side, "a", "left").join(other, "b", "left").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.expr("case when ca = cb then 1 else 0 end")), F.lit(0)).alias("f")
    ).first()
    return row["f"], row["n"]


def _block_links(nodes: DataFrame, crowd: DataFrame, threshold: float) -> DataFrame:
    """Exact links per node (node, n) among the nodes of each crowded component.

    A component is dealt into chunks of about BLOCK nodes, and each pair of chunks is one
    matrix product; only sums per node leave it.
    """
    sizes = crowd.groupBy("component").agg(F.count("*").alias("_n"))
    dealt = (
        crowd.join(sizes, "component").join(nodes, "node")
        .withColumn("chunks", F.expr(f"cast((_n + {BLOCK} - 1) div {BLOCK} as int)"))
        .withColumn("chunk", F.expr("cast(pmod(xxhash64('chunk', node), chunks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("component", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "vec", "copies")
    )

    def count(part: pd.DataFrame) -> pd.DataFrame:
        low, high = part["low"].iloc[0], part["high"].iloc[0]
        a, b = part[part["chunk"] == low], part[part["chunk"] == high]
        if not len(a) or not len(b):
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        near = _unit(a["vec"]) @ _unit(b["vec"]).T >= threshold
        if low == high:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"node": a["node"], "n": near @ b["copies"].to_numpy()})
        return pd.DataFrame({
            "node": np.r_[a["node"], b["node"]],
            "n": np.r_[near @ b["copies"].to_numpy(), near.T @ a["copies"].to_numpy()],
        })

    return dealt.groupBy("component", "low", "high").applyInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, lists: int = 10, trees: int = 6, reach: int = 10,
    recall: float = 0.98, rounds: int = 5,
) -> DataFrame:
    """Links at cosine ``threshold`` or more between vectors of equal label.

    ``vectors``: vec_id, label, embedding (other columns are not read). NN-descent starts from
    projection orders and goes on, at least one round, until a brute-force audit of a bounded sample finds
    ``recall`` of the links, or for ``rounds`` rounds. Pairs come with their cosine in double
    precision; those below the threshold are dropped. Where a node's list is full of links
    (saturated), the lists of its whole component are enlarged to the component, in exact blocks.
    Returns vec_id, n_links, component_id, kept. Equal vectors are one node that counts its copies. Vectors
    without a node (null, zero, non-finite, no label) have no links and are kept. Repeated
    rows count as copies of each other. Vectors of other length are never linked.
    """
    nodes, members = distinct_vectors(vectors)
    graph = landed(first_graph(nodes, lists, trees, reach), "graph")
    for _ in range(rounds):
        graph = landed(descend(nodes, graph, lists), "graph")
        links = landed(
            graph.filter(F.col("s") >= threshold).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "links"
        )
        linked = landed(connected_components(links), "vector-components")
        component = nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        found, there = audit(nodes, component, threshold)
        if found >= recall * there:
            break
    full = graph.filter(F.col("s") >= threshold).groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= lists)
    crowded = linked.join(full.select(F.col("u").alias("node")), "node").select("component").distinct()
    crowd = landed(linked.join(crowded, "component"), "crowd")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = (
        both.join(nodes.select(F.col("node").alias("b"), "copies"), "b")
        .groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("n"))
        .join(crowd.select("node"), "node", "left_anti")
    )
    counts = listed.unionByName(_block_links(nodes, crowd, threshold))
    per_node = landed(
        nodes.select("node", "copies").join(counts, "node", "left").join(linked, "node", "left")
        .select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "vector-links",
    )
    marked = members.join(per_node, "node")
    smallest = marked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    with_node = marked.join(smallest, "component").select("vec_id", "n_links", "component_id")
    without = vectors.select("vec_id", "label", "embedding").filter(~_usable()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return with_node.unionByName(without).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
