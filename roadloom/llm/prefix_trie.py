"""Prefix trie of conversations: a count-min screen keeps single tails local, shared prefixes are grouped."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from roadloom.llm.common import landed
from roadloom.operators.ranking import blocked_rank, blocked_running_sum

BLANK = r"[\x20\x09-\x0D]+"
#: turns of a conversation whose digests are run up in one task
BLOCK = 4096
#: cells of a row of the sketch: 8 for each prefix, 2^28 at most, so its bitmaps have 64 MB at most
CELLS_PER_PREFIX, MAX_CELLS = 8, 1 << 28
#: characters of joined ids that travel as one row
PIECE = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text: turns in order, null turns first, ties by role and text.

    Null role and text are empty. Rows without conv_id belong to no conversation and are left
    out. Repeated rows are turns of their own.
    """
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().cast("int").alias("_set"), F.coalesce("turn", F.lit(0)).alias("_turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return blocked_rank(rows, ["conv_id"], "_turn", "pos", lead=[("_set", True)], tail=["role", "text"]).select("conv_id", "pos", "role", "text")


def share_openings(numbered: DataFrame, every: int = 20, choices: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilds each conversation c with the opening of conversation c - c % ``every``.

    The first h = crc32(c) % ``choices`` turns come from there (as many as it has), the rest are
    c's own turns after its first h. Returns (turns: conv_id, depth, role, text; conversations:
    conv_id, total), the latter with those left without turns.
    """
    numbered = landed(numbered, "trie-numbered")
    sizes = landed(numbered.groupBy("conv_id").agg(F.count("*").alias("own")), "trie-sizes")
    convs = sizes.select(
        "conv_id", "own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % choices).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    ).join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
    convs = landed(convs.withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0)))), "trie-conversations")
    opening = numbered.filter(F.col("pos") < choices).withColumnRenamed("conv_id", "base")
    first = convs.filter("taken > 0").select("conv_id", "base", "taken").join(opening, "base").filter("pos <= taken")
    rest = numbered.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    turns = first.select("conv_id", F.col("pos").alias("depth"), "role", "text").unionByName(
        rest.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "role", "text")
    )
    return turns, convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total"))


def _digests(turns: DataFrame) -> DataFrame:
    """conv_id, depth, words, digest (a, b) of the prefix up to the turn, (pa, pb) of that before.

    A turn's 128 hash bits cover its depth; a prefix is the exclusive or of its turns', so it is
    run up in blocks of a conversation, and one of any length is no single task's work.
    """
    rows = turns.select(
        "conv_id", "depth", F.size(F.filter(F.split("text", BLANK), lambda w: w != "")).cast("long").alias("words"),
        F.xxhash64("depth", "role", "text").alias("ta"), F.xxhash64(F.lit("second half"), "text", "role", "depth").alias("tb"),
        F.floor(F.col("depth") / BLOCK).alias("_blk"),
    )
    rows = landed(rows, "trie-turns")
    earlier = Window.partitionBy("conv_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "_blk").agg(F.bit_xor("ta").alias("ta"), F.bit_xor("tb").alias("tb"))
    blocks = blocks.select("conv_id", "_blk", *[F.coalesce(F.bit_xor(f"t{x}").over(earlier), F.lit(0)).alias(f"_{x}") for x in "ab"])
    upto = Window.partitionBy("conv_id", "_blk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks, ["conv_id", "_blk"]).withColumns({x: F.col(f"_{x}").bitwiseXOR(F.bit_xor(f"t{x}").over(upto)) for x in "ab"})
    return rows.select("conv_id", "depth", "words", "a", "b", F.col("a").bitwiseXOR(F.col("ta")).alias("pa"), F.col("b").bitwiseXOR(F.col("tb")).alias("pb"))


def _sketch(rows: DataFrame, cells: int) -> dict[str, np.ndarray]:
    """Count-min sketch of the digests, its counters cut down to the bit "more than one".

    Two rows of ``cells`` counters, addressed by the halves of a digest. The counters are
    grouped with partial sums; bitmaps of them reach the driver (``cells`` / 4 bytes).
    """
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(x).alias("row"), F.pmod(x, F.lit(cells)).alias("cell")) for x in "ab"])).alias("c")).select("c.*")
    many = each.groupBy("row", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    maps = many.groupBy("row", F.expr("cell div 32768").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") % 32768 + 1)).alias("bits"))
    found = {x: np.zeros(max(cells // 8, 4096), np.uint8) for x in "ab"}
    for r in maps.collect():
        found[r.row][r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return found


def screened(rows: DataFrame, cells: int | None = None) -> DataFrame:
    """Adds ``single`` and ``after_single``: the sketch proves the prefix, or the one before, a singleton.

    An estimate is never below the count, so 1 proves it; the empty prefix is never single.
    """
    if cells is None:
        cells = 1 << 15
        while cells < min(MAX_CELLS, CELLS_PER_PREFIX * rows.count()):
            cells *= 2
    bits = rows.sparkSession.sparkContext.broadcast(_sketch(rows, cells))

    @F.pandas_udf(BooleanType())
    def single(a: pd.Series, b: pd.Series) -> pd.Series:
        sure = np.zeros(len(a), bool)
        for half, digests in (("a", a), ("b", b)):
            cell = digests.to_numpy() % cells
            sure |= bits.value[half][cell >> 3] >> (cell & 7) & 1 == 0
        return pd.Series(sure)

    out = landed(rows.withColumns({"single": single("a", "b"), "after_single": single("pa", "pb") & (F.col("depth") > 1)}), "trie-screened")
    bits.destroy()
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (a, b, conv_id) to rows (a, b, first, ids) of joined ids."""
    node, held, size = None, [], 0

    def piece():
        return pd.DataFrame({"a": [node[0]], "b": [node[1]], "first": [held[0]], "ids": [",".join(map(str, held))]})

    for batch in batches:
        for a, b, conv in zip(batch["a"].tolist(), batch["b"].tolist(), batch["conv_id"].tolist(), strict=True):
            if held and ((a, b) != node or size >= PIECE):
                yield piece()
                held, size = [], 0
            node = (a, b)
            held.append(conv)
            size += len(str(conv)) + 1
    if held:
        yield piece()


def _sha256(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces to one hash a node, fed piece by piece."""
    node, state = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(batch["a"].tolist(), batch["b"].tolist(), batch["ids"], strict=True):
            if (a, b) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (a, b), hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["a", "b", "sha"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["a", "b", "sha"])


def _ends(ends: DataFrame) -> DataFrame:
    """a, b, sha: hash of each node's ids in ascending order. A node's ids are dealt by range, so a
    hot node is sorted and joined by many tasks; one task then hashes its pieces as they come."""
    pieces = landed(
        ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInPandas(_pieces, "a long, b long, first long, ids string"), "trie-ends"
    )
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInPandas(_sha256, "a long, b long, sha string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, cells: int | None = None) -> DataFrame:
    """One row per distinct prefix of the conversations, from the empty one on.

    ``turns``: conv_id, depth (1, 2, ... without gaps), role, text; ``conversations``: conv_id and
    total, its number of turns (0 allowed). A node is a sequence of depth turns; its members are
    the conversations that start with it. Returns conv_id (the smallest member), depth,
    parent_conv_id (the parent's conv_id; null for the root), n_convs, n_children, n_leaves
    (childless nodes of the subtree, itself included), saved_tokens (over the subtree, n_convs - 1
    times the words of the last text), ends_sha256 (over the ids of the members that end here).

    Where the sketch proves a prefix a singleton, its row is made where it is, as everything about
    it is known; other prefixes are grouped by digest. Sums over a subtree need no walk: each
    node is counted for its smallest member, which is a member of all its ancestors too.
    No conversations give no rows, not even a root. Further columns are not read.
    """
    conversations = landed(conversations.select("conv_id", "total"), "trie-totals")
    rows = screened(landed(_digests(turns).join(conversations, "conv_id"), "trie-digests"), cells)
    maybe = rows.filter("not single")
    groups = landed(
        maybe.groupBy("a", "b").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.count_if(F.col("depth") == F.col("total")).alias("n_ends")), "trie-groups"
    )
    rep = F.col("conv_id") == F.col("node")
    shared = maybe.drop("single").join(groups, ["a", "b"]).withColumn("value", F.when(rep, (F.col("n") - 1) * F.col("words")).otherwise(F.lit(0)).cast("long"))
    shared = landed(shared, "trie-shared")

    # a leaf counts for its smallest member
    tops = rows.filter("single and depth = total").select("conv_id").unionByName(shared.filter(rep & F.expr("depth = total and n_ends = n")).select("conv_id"))
    tops = landed(tops.withColumn("leaf", F.lit(1)), "trie-leaves")
    totals = shared.groupBy("conv_id").agg(F.sum("value").alias("all"))
    below = blocked_running_sum(shared.select("conv_id", "depth", "a", "b", "value"), ["conv_id"], "depth", "value", "upto")
    sums = below.join(totals, "conv_id").join(tops, "conv_id", "left").groupBy("a", "b").agg(
        F.sum(F.expr("all - upto + value")).alias("saved"), F.sum(F.coalesce("leaf", F.lit(0))).alias("leaves")
    )
    born = rows.filter("single and not after_single").select("conv_id", "depth", "total", "pa", "pb")
    children = shared.filter(rep).select("pa", "pb").unionByName(born.select("pa", "pb")).groupBy("pa", "pb").agg(F.count("*").alias("children"))
    children = landed(children, "trie-children")
    ends = shared.filter("depth = total").select("a", "b", "conv_id").unionByName(
        conversations.filter("total = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id")
    )
    shas = landed(_ends(ends), "trie-hashes")

    whole = landed(conversations.groupBy().agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).filter("n > 0"), "trie-root")
    zero = [F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")]
    parents = groups.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("node").alias("above")).unionByName(
        whole.select(F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"), F.col("node").alias("above"))
    )
    own_end = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    # the nodes that were grouped
    inner = (
        shared.filter(rep).select("conv_id", "depth", "a", "b", "pa", "pb", "n").join(sums, ["a", "b"])
        .join(children.withColumnsRenamed({"pa": "a", "pb": "b"}), ["a", "b"], "left").join(shas, ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
        .select(
            "conv_id", "depth", F.coalesce("above", "conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.coalesce("children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )

    def tail(df: DataFrame, parent) -> DataFrame:
        last = F.col("depth") == F.col("total")
        return df.select(
            "conv_id", "depth", parent.alias("parent_conv_id"), F.lit(1).alias("n_convs"), F.when(last, 0).otherwise(1).alias("n_children"),
            F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.when(last, own_end).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
        )

    tails = tail(rows.filter("single and after_single"), F.col("conv_id"))
    starts = tail(born.join(parents, ["pa", "pb"], "left"), F.coalesce("above", "conv_id"))
    saved = shared.agg(F.coalesce(F.sum("value"), F.lit(0))).scalar()
    leaves = tops.agg(F.count("*")).scalar()
    root = (
        whole.select("*", *zero).join(children.withColumnsRenamed({"pa": "a", "pb": "b"}), ["a", "b"], "left").join(shas, ["a", "b"], "left")
        .select(
            F.col("node").alias("conv_id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.coalesce("children", F.lit(0)).alias("n_children"), F.greatest(leaves, F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"),
            F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
    typed = [F.col(c) if c == "ends_sha256" else F.col(c).cast("long").alias(c) for c in NODE]
    return root.select(*typed).unionByName(inner.select(*typed)).unionByName(starts.select(*typed)).unionByName(tails.select(*typed))
