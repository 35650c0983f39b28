"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import ascii_lower, landed, small_side

#: everything that is neither a digit, an ASCII letter nor beyond ASCII (fixed value)
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words(text: Column | str) -> Column:
    """Words with A-Z lower-cased; null has none."""
    return F.coalesce(_split(ascii_lower(text)), F.array().cast("array<string>"))


def _split(text: Column | str) -> Column:
    return F.filter(F.split(text, NO_WORD), lambda w: w != "")


def _fold(text: Column | str) -> Column:
    """The same words. In pure ASCII ``lower`` does just that and is faster; beyond it, it folds
    letters by their neighbours (a last sigma), so there only A-Z are replaced."""
    plain = F.octet_length(text) == F.length(text)
    return F.coalesce(_split(F.when(plain, F.lower(text)).otherwise(ascii_lower(text))), F.array().cast("array<string>"))


def _block(array: str, start: str, size: int) -> str:
    return "xxhash64(" + ", ".join(f"{array}[{start} + {i}]" for i in range(size)) + ")"


def _window_items(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (item_id, win, len): the windows of every item as space-joined words."""
    return (
        benchmark.select("item_id", words("text").alias("_w"))
        .withColumn("len", F.least(F.size("_w"), F.lit(window)))
        .filter("len > 0")
        .withColumn("_s", F.explode(F.expr("sequence(1, size(_w) - len + 1)")))
        .select("item_id", F.concat_ws(" ", F.expr("slice(_w, _s, len)")).alias("win"), "len")
        .distinct()
    )


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Occurrences of benchmark windows: doc_id, _tx (hash of the text), start (0-based word),
    len, window. One row per place, whichever number of items share the window.

    A run of ``len`` words holds an aligned block of (len + 1) // 2 words of the document, so
    only a document's aligned blocks are hashed (a fifth of its places at ten words) and
    looked up among the hashes of all benchmark blocks, which are broadcast after counting.
    Documents without a hit end there. For the others the windows around the blocks found
    are compared word for word.
    """
    spark = docs.sparkSession
    windows = landed(_window_items(benchmark, window).select("win", "len").distinct(), "windows")
    # blocks of every window: all places, as the document's grid may lie anywhere
    blocks = (
        windows.withColumn("_w", F.split("win", " "))
        .withColumn("size", F.expr("cast((len + 1) div 2 as int)"))
        .withColumn("_s", F.explode(F.expr("sequence(0, len - size)")))
        .withColumn("_h", F.coalesce(*[
            F.when(F.col("size") == b, F.expr(_block("_w", "_s", b))) for b in range(1, (window + 1) // 2 + 1)
        ]))
        .select("size", "_h", "len").distinct()
    )
    blocks = landed(blocks, "benchmark-blocks")
    # at most (window + 1) / 2 values
    sizes = sorted(r["size"] for r in blocks.select("size").distinct().collect())
    keyed = docs.filter("text is not null").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_doc"), "text")
    found = None
    for b in sizes:
        grid = keyed.select("_doc", _fold("text").alias("_w")).filter(F.size("_w") >= b).select(
            "_doc",
            F.posexplode(F.expr(f"transform(sequence(0, cast(size(_w) div {b} as int) - 1), k -> {_block('_w', f'k * {b}', b)})")).alias("_k", "_h"),
        )
        part = grid.join(small_side(blocks.filter(F.col("size") == b).drop("size")), "_h").select(
            "_doc", (F.col("_k") * b).alias("_p"), F.lit(b).alias("_b"), "len"
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "_doc bigint, _tx bigint, start int, len int, win string")
    places = landed(found.distinct(), "benchmark-candidates").groupBy("_doc").agg(
        F.collect_list(F.struct("_p", "_b", "len")).alias("_places")  # at most a document's length
    )
    starts = F.expr(
        "array_distinct(flatten(transform(_places, x -> transform("
        "filter(sequence(x._p - (x.len - x._b), x._p), s -> s >= 0 and s + x.len <= size(_w)),"
        " s -> struct(s as start, x.len as len)))))"
    )
    return (
        keyed.join(places, "_doc")
        .select("_doc", F.xxhash64("text").alias("_tx"), words("text").alias("_w"), "_places")
        .withColumn("_s", F.explode(starts))
        .select("_doc", "_tx", F.col("_s.start").alias("start"), F.col("_s.len").alias("len"),
                F.concat_ws(" ", F.expr("slice(_w, _s.start + 1, _s.len)")).alias("win"))
        .join(small_side(windows), ["win", "len"])
        .select("_doc", "_tx", "start", "len", "win")
        .distinct()  # equal rows repeated in the table say the same
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document the words hit by benchmark windows, and the items they come from.

    ``docs``: doc_id, text; ``benchmark``: item_id, text. A window is ``window`` consecutive
    words of an item, or all words of a shorter item with any; a document word inside an
    occurrence is hit. Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated
    and ``spans`` (start, end of merged hits, words from 0). Null and wordless texts have no words, hits or
    items (the hash is then that of the empty string). Repeated rows each get their row; rows that share a doc_id are
    told apart by text. Null item ids are left out. Other columns are not read.
    """
    benchmark = benchmark.select("item_id", "text").filter("item_id is not null")
    hits = landed(benchmark_hits(docs.select("doc_id", "text"), benchmark, window), "benchmark-hits")
    row = ["_doc", "_tx"]
    merged = F.expr(
        "aggregate(array_sort(collect_list(struct(start, start + len as stop))),"
        " cast(array() as array<struct<start: int, stop: int>>),"
        " (acc, x) -> case when size(acc) > 0 and x.start <= element_at(acc, -1).stop"
        " then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start,"
        " greatest(element_at(acc, -1).stop, x.stop) as stop)))"
        " else concat(acc, array(x)) end)"
    )
    spans = hits.groupBy(*row).agg(merged.alias("spans"))
    items = (
        hits.select(*row, "win").distinct()
        .join(_window_items(benchmark, window).select("win", "item_id"), "win")
        .select(*row, F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy(*row).agg(F.array_sort(F.collect_list("item")).alias("_items"))
    )
    found = landed(spans.join(items, row), "contaminated")
    base = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("_doc"), F.xxhash64("text").alias("_tx"),
        F.size(_fold("text")).cast("long").alias("n_words"),
    )
    n_hit = F.coalesce(F.expr("aggregate(spans, 0L, (n, x) -> n + x.stop - x.start)"), F.lit(0)).cast("long")
    return (
        base.join(found, row, "left")
        .select(
            "doc_id", "n_words", n_hit.alias("n_hit"),
            F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"), "spans",
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW) -> DataFrame:
    """Removes documents with any hit (``documents``), or only the words hit (``spans``).

    Keeps all columns of ``docs`` in mode ``documents``. In mode ``spans`` a text with hits
    becomes its remaining words in lower case, joined by spaces; other texts stay as they are.
    """
    found = landed(
        benchmark_hits(docs.select("doc_id", "text"), benchmark.filter("item_id is not null"), window), "benchmark-hits"
    )
    keyed = docs.withColumn("__doc", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("__tx", F.xxhash64("text"))
    hit = found.select(F.col("_doc").alias("__doc"), F.col("_tx").alias("__tx"), "start", "len")
    if mode == "documents":
        return keyed.join(hit.select("__doc", "__tx").distinct(), ["__doc", "__tx"], "left_anti").select(*docs.columns)
    places = hit.groupBy("__doc", "__tx").agg(
        F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(start, start + len - 1)")))).alias("__hit")
    )
    left = F.filter(words("text"), lambda w, i: ~F.array_contains(F.col("__hit"), i))
    return keyed.join(places, ["__doc", "__tx"], "left").select(*[
        F.when(F.col("__hit").isNotNull(), F.array_join(left, " ")).otherwise(F.col(c)).alias(c) if c == "text" else F.col(c)
        for c in docs.columns
    ])
