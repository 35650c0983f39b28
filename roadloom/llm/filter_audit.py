"""Interaction of document filters: coalition removals, exact Shapley values, effects of every order."""

from __future__ import annotations

import json
from collections.abc import Mapping
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import landed, wide_hash

BLANK = r"[\x20\x09-\x0D]+"


def failures(docs: DataFrame, part: str = "source", min_words: int = 200, min_distinct: int = 50, max_capitals: int = 2, signs: str = "#$%&*|") -> DataFrame:
    """doc_id, part and the boolean columns A to E: which filters each document fails.

    A: fewer than ``min_words`` words; B: distinct words below ``min_distinct`` percent; C: A-Z
    above ``max_capitals`` percent of the code points; D: one of ``signs``; E: some smaller
    doc_id has the same text. Null text is empty, a null part the empty string. A null doc_id
    is no smaller than any other and none is smaller than it. Repeated rows count each; they
    don't fail E for one another. Texts are compared by 128 bits of hash.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("_w"), wide_hash(text).alias("_h")
    ).select(
        "doc_id", "part", "_h",
        (F.size("_w") < min_words).alias("A"),
        (100 * F.size(F.array_distinct("_w")) < min_distinct * F.size("_w")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > max_capitals * F.length("text")).alias("C"),
        F.expr(f"translate(text, '{signs}', '') <> text").alias("D"),
    )
    rows = landed(rows, "audit-failures")
    # one row per text that some ids share: the copies of a text are aggregated before they travel
    first = rows.groupBy("_h").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last").drop("_last")
    return rows.join(first, "_h", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))).drop("_h", "_first")


def tabulate(failing: DataFrame, filters: str, counts: Mapping[str, Column]) -> DataFrame:
    """One row per part with, for every set of filters, what the set removes.

    Columns: part, n (documents), per filter f ``fail_f`` and ``only_f``, and for each name of
    ``counts`` (documents by default 1) an array of 2^len(filters) sums ``name``: element S holds
    the sum over the documents that fail a filter of S (bit i for filter i).
    """
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    sums = [F.sum(c).cast("long").alias(name) for name, c in counts.items()]
    by_mask = failing.groupBy("part", mask.cast("int").alias("_mask")).agg(F.count("*").alias("_n"), *sums)
    coalitions = range(1 << len(filters))

    def removed(value: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("_mask").bitwiseAND(s) != 0, F.col(value))), F.lit(0)).cast("long") for s in coalitions])

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0)).cast("long")

    return by_mask.groupBy("part").agg(
        F.sum("_n").cast("long").alias("n"),
        *[count(F.col("_mask").bitwiseAND(1 << i) != 0).alias(f"fail_{f}") for i, f in enumerate(filters)],
        *[count(F.col("_mask") == (1 << i)).alias(f"only_{f}") for i, f in enumerate(filters)],
        removed("_n").alias("docs"), *[removed(name).alias(name) for name in counts],
    )


def shapley_weights(n: int) -> list[list[Fraction]]:
    """W with phi_i = sum over coalitions S of W[i][S] * v(S), v(empty) = 0, in rationals.

    The Shapley value is the least-squares fit of an additive game to v under the kernel weights
    (n-1) / (C(n,s) s (n-s)), held to phi_1 + ... + phi_n = v(all). The normal equations with
    that constraint's multiplier are solved by elimination over fractions, for all v at once:
    the right-hand side keeps one column per coalition.
    """
    every = (1 << n) - 1
    inner = range(1, every)
    weight = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in inner}
    rows = []
    for i in range(n):
        left = [sum((weight[s] for s in inner if s >> i & s >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)]
        right = [weight[s] if s in weight and s >> i & 1 else Fraction(0) for s in range(every + 1)]
        rows.append(left + right)
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(int(s == every)) for s in range(every + 1)])
    size = n + 1
    for at in range(size):
        pivot = next(r for r in range(at, size) if rows[r][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for r in range(size):
            if r != at and rows[r][at]:
                rows[r] = [x - rows[r][at] * y for x, y in zip(rows[r], rows[at], strict=True)]
    return [row[size:] for row in rows[:n]]


def audit_orders(table: DataFrame, filters: str, counts: Mapping[str, str]) -> DataFrame:
    """One row per part, order of the filters and step, from ``tabulate``'s rows.

    ``counts`` names the arrays and the columns of what a step loses of each. ``shapley`` is the
    filter's share of the removals, times the number of orders: the sum over all orders.
    Everything is a difference of two coalitions, so no document is looked at again.
    """
    n = len(filters)
    if n < 2:
        raise ValueError("orders need two filters at least")
    total = factorial(n)
    weights = shapley_weights(n)

    def share(i: int) -> Column:
        # times the number of orders every weight is whole: so many orders put the filter there
        whole = [w * total for w in weights[i]]
        assert all(w.denominator == 1 for w in whole)
        return sum((F.col("docs")[s] * int(w) for s, w in enumerate(whole) if w), F.lit(0).cast("long"))

    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(filters[k] for k in order), "step": step, "i": i, "b": before, "a": before | 1 << i})
            before |= 1 << i
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,i:int,b:int,a:int>>")
    own = F.array(*[F.struct(F.col(f"fail_{f}").alias("fail"), F.col(f"only_{f}").alias("only"), share(i).alias("share")) for i, f in enumerate(filters)])
    rows = table.select("part", "n", "docs", *counts, own.alias("_own"), F.inline(steps))
    removed = F.col("docs")[F.col("a")] - F.col("docs")[F.col("b")]
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - F.col("docs")[F.col("a")]).alias("kept"), removed.alias("removed"),
        (F.col("_own")[F.col("i")]["fail"] - removed).alias("redundant"), F.col("_own")[F.col("i")]["only"].alias("unique_fails"),
        *[(F.col(c)[F.col("a")] - F.col(c)[F.col("b")]).alias(name) for c, name in counts.items()],
        F.col("_own")[F.col("i")]["share"].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What each of the five filters of ``failures`` removes at each step of each order, per part.

    ``docs``: doc_id, text and ``part``; ``labels``: doc_id, quality, toxic. Returns per part, of
    the 120 orders and 5 steps: part, filter_order, step, kept, removed, redundant (failing, but
    removed before), unique_fails (failing this filter only), good_lost (removed here with
    quality 1), toxic_lost (removed here with toxic 1) and shapley (removed, summed over all
    orders). A document has quality or toxic 1 if any label row of its doc_id says so; a null
    doc_id has no labels. Tables without documents give no rows; further columns are not read.
    """
    failing = failures(docs, part)
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    failing = failing.join(marks.filter("_good = 1 or _toxic = 1"), "doc_id", "left")
    counts = {"good": F.coalesce("_good", F.lit(0)), "toxic": F.coalesce("_toxic", F.lit(0))}
    return audit_orders(landed(tabulate(failing, "ABCDE", counts), "audit-coalitions"), "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})
