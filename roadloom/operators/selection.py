"""Budget selection over a ranked queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.ranking import BLOCK
from roadloom.session import cut

WHO = ["survey_id", "budget_id"]


def _scale(c: Column | str) -> Column:
    """Position of the highest bit of a positive whole number."""
    return F.length(F.bin(c)) - 1


def _phase(open_: DataFrame, items: DataFrame, blocks: DataFrame, block_rows: int) -> DataFrame:
    """One phase of every open walk: adds ``stop`` (null: the walk has ended), ``big`` and ``spent``.

    With K the scale of what is left, items below 2^(K-1) fit as long as at least that much is
    left. So all of them are taken, up to the first item after which less is left; or up to the
    first larger item that fits what is left there, which is taken too. Larger ones before it
    are refused together.
    """
    begin = open_.withColumn("k", _scale("left")).withColumn("start_blk", F.floor(F.col("after") / F.lit(block_rows)))
    small, big = F.col("e") <= F.col("k") - 2, F.col("e").between(F.col("k") - 1, F.col("k"))

    def per_block(rows: DataFrame, total: str, least: str) -> DataFrame:
        return rows.filter("e <= k").groupBy(*WHO, "left", "after", "k", "blk").agg(
            F.coalesce(F.sum(F.when(small, F.col(total))), F.lit(0)).alias("small"), F.min(F.when(big, F.col(least))).alias("big")
        )

    head = per_block(begin.join(items.withColumn("start_blk", F.col("blk")), ["survey_id", "start_blk"]).filter("rk > after"), "c", "c")
    later = per_block(begin.join(blocks, "survey_id").filter("blk > start_blk"), "total", "least")
    upto = Window.partitionBy(*WHO).orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
    short = F.expr("2 * (left - run) < shiftleft(1L, k)")
    sums = head.unionByName(later).withColumn("run", F.sum("small").over(upto)).withColumn("before", F.col("run") - F.col("small"))
    sums = cut(sums.withColumn("short", short))
    # blocks up to the first that uses the phase up, and in which something may end it
    first_short = sums.filter("short").groupBy(*WHO).agg(F.min("blk").alias("last_blk"))
    looked = sums.join(first_short, WHO, "left").filter("(last_blk is null or blk <= last_blk) and (short or big <= left - before)")
    inside = Window.partitionBy(*WHO, "blk").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    rows = looked.select(*WHO, "left", "after", "k", "blk", "before").join(items, ["survey_id", "blk"]).filter("rk > after and e <= k")
    rows = rows.withColumn("run", F.col("before") + F.coalesce(F.sum(F.when(small, F.col("c"))).over(inside), F.lit(0)))
    ends = rows.filter((small & short) | (big & F.expr("c <= left - run")))
    first = ends.groupBy(*WHO).agg(F.min(F.struct("rk", big.alias("big"), (F.col("run") + F.when(big, F.col("c")).otherwise(0)).alias("spent"))).alias("f"))
    total = sums.groupBy(*WHO).agg(F.max("run").alias("all"))
    return cut(
        open_.withColumn("k", _scale("left")).join(first, WHO, "left").join(total, WHO, "left")
        .select(*WHO, "left", "after", "k", F.col("f.rk").alias("stop"), F.coalesce("f.big", F.lit(False)).alias("big"), F.coalesce("f.spent", "all", F.lit(0)).alias("spent"))
    )


def select_within_budget(
    ranked: DataFrame, budgets: DataFrame, rank_col: str = "queue_rank", block_rows: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Walks each survey's queue: take an item if it still fits, else skip it and go on.

    ``ranked``: survey_id, rank, estimated_cost. ``budgets``: survey_id, budget_id, budget.
    Returns (items with budget_id and selected; remaining per survey and budget).

    A walk goes in phases. Each finds its end by sums and least costs per (survey, block of
    ranks, scale of cost), then inside the blocks that may hold it. Of one scale of what is left
    at most four phases start, so there are at most four for each binary digit of the largest
    budget, however many items are refused. Money is counted in whole hundredths; costs are not
    negative. Items without cost are taken unless the budget is negative.
    """
    cents = F.round(F.coalesce("estimated_cost", F.lit(0.0)) * 100.0).cast("bigint")
    cents = F.when(cents < 0, F.raise_error(F.lit("costs must not be negative"))).otherwise(cents)
    items = ranked.select("survey_id", F.col(rank_col).alias("rk"), cents.alias("c")).withColumn("blk", F.floor(F.col("rk") / F.lit(block_rows)))
    items = cut(items.withColumn("e", F.when(F.col("c") > 0, _scale("c"))))
    paid = items.filter("c > 0")
    blocks = cut(paid.groupBy("survey_id", "blk", "e").agg(F.sum("c").alias("total"), F.min("c").alias("least")))
    purses = cut(budgets.select(*WHO, F.round(F.col("budget") * 100.0).cast("bigint").alias("left")))
    open_ = purses.filter("left > 0").withColumn("after", F.lit(-1).cast("bigint"))
    spans = None
    while not open_.isEmpty():
        step = _phase(open_, paid, blocks, block_rows)
        spans = step if spans is None else spans.unionByName(step)
        open_ = step.filter("stop is not null and left > spent").select(*WHO, (F.col("left") - F.col("spent")).alias("left"), F.col("stop").alias("after"))
    free = items.filter("c = 0").join(purses.filter("left >= 0").select(*WHO), "survey_id").select(*WHO, "rk")
    if spans is None:
        picked, final = free, purses.withColumn("remaining", F.col("left") / 100.0).drop("left")
    else:
        # a span meets the items of the blocks it covers; spans of a walk don't overlap
        last = items.groupBy("survey_id").agg(F.max("blk").alias("last_blk"))
        covers = F.sequence(F.floor(F.greatest("after", F.lit(0)) / F.lit(block_rows)), F.coalesce(F.floor(F.col("stop") / F.lit(block_rows)), "last_blk"))
        open_ended = F.col("stop").isNull() & (F.floor(F.greatest("after", F.lit(0)) / F.lit(block_rows)) > F.col("last_blk"))
        covered = cut(spans).join(last, "survey_id").filter(~open_ended).withColumn("blk", F.explode(covers))
        taken = covered.join(paid, ["survey_id", "blk"]).filter("rk > after and ((e <= k - 2 and rk <= coalesce(stop, rk)) or (big and rk = stop))")
        picked = taken.select(*WHO, "rk").unionByName(free)
        spent = spans.groupBy(*WHO).agg(F.min(F.col("left") - F.col("spent")).alias("over"))
        final = purses.join(spent, WHO, "left").select(*WHO, (F.coalesce("over", "left") / 100.0).alias("remaining"))
    picked = picked.withColumnRenamed("rk", rank_col).withColumn("selected", F.lit(True))
    marked = (
        ranked.join(budgets.select(*WHO), "survey_id")
        .join(picked, [*WHO, rank_col], "left")
        .withColumn("selected", F.coalesce("selected", F.lit(False)))
    )
    return marked, final
