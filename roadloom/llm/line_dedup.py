"""Line deduplication: lines that a large share of a site's pages carry are boilerplate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import landed


def _line_key(x):
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second half"), x).alias("b"))


def boilerplate_lines(docs: DataFrame, ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """Lines (as 128-bit keys) on more than ``ratio`` of the distinct pages of a host.

    ``docs``: host, text. A line counts once per page and copies of a page count as one page,
    so a group of copies can't make its own text boilerplate. Lines are compared without
    surrounding blanks; empty lines are never counted. Partial distinct aggregation comes
    before each shuffle; the hot host's rows are dealt by host, line and page.
    """
    pages = docs.filter("text is not null").withColumn("_page", F.xxhash64("text"))
    totals = pages.groupBy("host").agg(F.count_distinct("_page").alias("_pages"))
    lines = F.filter(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x))), lambda x: x != "")
    # page by page first: the copies of a page meet here, as keys of fixed width
    rows = pages.select("host", "_page", F.explode(F.transform(lines, _line_key)).alias("_l"))
    held = rows.select("host", "_page", F.col("_l.a").alias("_a"), F.col("_l.b").alias("_b")).distinct()
    counts = held.groupBy("host", "_a", "_b").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_pages)
    return counts.join(totals, "host").filter(F.col("_n") > ratio * F.col("_pages")).select("host", "_a", "_b")


def drop_boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = 5, keep: Sequence[str] = ()
) -> DataFrame:
    """Removes the boilerplate lines of every document; no document goes.

    Returns doc_id, text (what is left, other lines unchanged and in order), n_lines and
    n_dropped, plus the column ``host`` names. A null host is one site of its own; a null text stays null with
    no lines; an empty text is one empty line and stays. Repeated rows are treated alike.
    Columns other than doc_id, text, the host and those in ``keep`` are not read. A site has at most (mean lines
    per page) / ratio such lines, which bounds the list joined to its pages.
    """
    kept_as = {c: f"_keep_{i}" for i, c in enumerate(keep)}
    tidy = docs.select("doc_id", "text", F.col(host).alias("_site"), *[F.col(c).alias(a) for c, a in kept_as.items()])
    # null and every string stay apart
    tidy = tidy.withColumn("host", F.coalesce(F.concat(F.lit("="), "_site"), F.lit("-")))
    drop = landed(
        boilerplate_lines(tidy, ratio, min_pages)
        .groupBy("host").agg(F.collect_list(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"))).alias("_drop")),
        "boilerplate",
    )
    kept = F.filter("_lines", lambda x: ~F.coalesce(F.array_contains(F.col("_drop"), _line_key(F.trim(x))), F.lit(False)))
    return (
        tidy.join(drop, "host", "left")
        .withColumn("_lines", F.split("text", "\n"))
        .withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(kept))
        .select(
            "doc_id",
            F.when(F.size("_kept") == F.size("_lines"), F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text"),
            F.col("_site").alias(host),
            F.coalesce(F.when(F.col("text").isNotNull(), F.size("_lines")), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.when(F.col("text").isNotNull(), F.size("_lines") - F.size("_kept")), F.lit(0)).cast("long").alias("n_dropped"),
            *[F.col(a).alias(c) for c, a in kept_as.items()],
        )
    )
