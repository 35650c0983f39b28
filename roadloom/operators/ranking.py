"""Ranks and running sums that never sort one whole key in one task.

A key (a survey, or everything) may hold a large share of all rows, so each helper cuts
the key into blocks of consecutive order values, works inside a block, and adds the
totals of the earlier blocks, which are one small row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.session import cut

BLOCK = 65_536
#: block offsets up to this many rows are broadcast, so that the rows they belong to stay where they are
FEW_BLOCKS = 100_000


def _offsets(blocks: DataFrame, keys: Sequence[str], lead: Sequence[Column], block: str, sums: dict) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*lead, block).rowsBetween(Window.unboundedPreceding, -1)
    for src, out in sums.items():
        blocks = blocks.withColumn(out, F.coalesce(F.sum(src).over(w), F.lit(0)))
    return blocks.drop(*[s for s in sums if s not in keys])


def ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Adds ``_blk``: the range of ``order`` a row lies in, numbered in that order, and ``_at``: its place there, from 0.

    Ranges come from a sample, so the rows are cut once: a range lost later is read again, not dealt anew.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the lower 33 bits count the rows of a partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return cut(dealt.withColumn("_blk", F.spark_partition_id()).withColumn("_at", place))


def _with_offsets(rows: DataFrame, blocks: DataFrame, part: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of their block; rows are shuffled only for very many blocks."""
    if list(part) == ["_blk"]:
        return rows.join(F.broadcast(blocks), "_blk")  # one row per range
    blocks = cut(blocks)
    return rows.join(F.broadcast(blocks) if blocks.count() <= FEW_BLOCKS else blocks, list(part))


def blocked_rank(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    out: str,
    lead: Sequence[tuple[str, bool]] = (),
    block: Column | None = None,
    tail: Sequence[str] = (),
) -> DataFrame:
    """``row_number`` per ``keys`` ordered by ``lead`` (name, ascending), ``id_col``, ``tail``.

    Without ``block`` the blocks are ranges of equal size found in the data, so ids may be
    sparse, negative or text, and there is one offset per key and range it touches; rows come out
    in ranges of ``keys``, ``lead`` and ``id_col`` where the offsets are few. A given ``block`` must not decrease with ``id_col``; ``lead`` columns then take few distinct values.
    Keys and lead columns are not null.
    """
    lead_names = [n for n, _ in lead]
    lead_order = [F.col(n).asc() if asc else F.col(n).desc() for n, asc in lead]
    if block is None:
        rows = ranged(df, [*keys, *lead_order, id_col, *tail])
        part = [*keys, "_blk"]
        counts = rows.groupBy(*part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
        blocks = _offsets(counts, keys, [], "_blk", {"_n": "_off"})
        rank = F.col("_off") + F.col("_at") - F.col("_first") + 1
        return _with_offsets(rows, blocks, part).withColumn(out, rank.cast("bigint")).drop("_blk", "_off", "_at", "_first")
    rows = df.withColumn("_blk", block)
    part = [*keys, *lead_names, "_blk"]
    blocks = _offsets(rows.groupBy(*part).agg(F.count("*").alias("_n")), keys, lead_order, "_blk", {"_n": "_off"})
    w = Window.partitionBy(*part).orderBy(id_col, *tail)
    return (
        rows.join(blocks, part)
        .withColumn(out, (F.col("_off") + F.row_number().over(w)).cast("bigint"))
        .drop("_blk", "_off")
    )


def blocked_running_sum(
    df: DataFrame, keys: Sequence[str], order_col: str, value: str, out: str, block: Column | None = None
) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in ``order_col`` order."""
    block = F.floor(F.col(order_col) / F.lit(BLOCK)) if block is None else block
    part = [*keys, "_blk"]
    rows = df.withColumn("_blk", block)
    blocks = _offsets(rows.groupBy(*part).agg(F.sum(value).alias("_t")), keys, [], "_blk", {"_t": "_off"})
    w = Window.partitionBy(*part).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(blocks, part).withColumn(out, F.col("_off") + F.sum(value).over(w)).drop("_blk", "_off")


def blocked_previous(
    df: DataFrame, keys: Sequence[str], order_col: str, fields: Sequence[str], prefix: str = "p_", block_rows: int = BLOCK, keep_block: bool = False
) -> DataFrame:
    """Adds the fields of the preceding row of the key (null on the first row).

    ``keep_block`` leaves ``_blk`` in, by which the rows are dealt then.
    """
    part = [*keys, "_blk"]
    rows = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block_rows)))
    last = rows.groupBy(*part).agg(F.max_by(F.struct(*fields), order_col).alias("_last"))
    w_blocks = Window.partitionBy(*keys).orderBy("_blk")
    carried = last.select(*part, F.lag("_last").over(w_blocks).alias("_carry"))
    w = Window.partitionBy(*part).orderBy(order_col)
    out = rows.join(carried, part).withColumn("_prev", F.coalesce(F.lag(F.struct(*fields)).over(w), F.col("_carry")))
    for f in fields:
        out = out.withColumn(prefix + f, F.col(f"_prev.{f}"))
    return out.drop("_prev", "_carry") if keep_block else out.drop("_prev", "_carry", "_blk")


def seeded_key(value: Column, seed: int) -> Column:
    """Text whose order is a fixed shuffle for the seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), value))


def seeded_rank(df: DataFrame, value: Column, seed: int, out: str, tail: Sequence[str] = ()) -> DataFrame:
    """Rank over all rows in the seed's order, in a million blocks of the key."""
    keyed = df.withColumn("_mix", seeded_key(value, seed))
    block = F.conv(F.substring("_mix", 1, 5), 16, 10).cast("bigint")
    return blocked_rank(keyed, [], "_mix", out, block=block, tail=tail).drop("_mix")
