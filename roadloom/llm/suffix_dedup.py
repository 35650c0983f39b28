"""Exact substring deduplication: suffixes in buckets, refined by the buckets of later offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import discard, landed, small_side, wide_hash

#: bytes of the first buckets' key
QGRAM = 32
#: suffixes that share a row in the rounds after the first; the last round looks at each alone
BLOCKS = (16, 4, 1)
#: bytes of a text that are hashed at once
CHUNK = 1 << 19

RUNS = "doc long, tie long, p int, n int, bucket long, content long"
PLACED = "doc long, tie long, s int, n int, o int, x binary"
_ODD = np.uint64(0xD6E8FEB86659FD93)


def qgram_ids(data: np.ndarray, q: int) -> np.ndarray:
    """64-bit identifier of the ``q`` bytes at every position of each row, built up from halves."""
    power = 0x9E3779B97F4A7C15
    part, size = (data.astype(np.uint64) + np.uint64(1)) * _ODD, 1
    ids, done = None, 0
    while True:
        if q & size:
            if ids is None:
                ids, done = part, size
            else:
                n = data.shape[-1] - done - size + 1
                ids, done = ids[..., :n] * np.uint64(power) + part[..., done : done + n], done + size
        if size * 2 > q:
            break
        n = data.shape[-1] - 2 * size + 1
        part, size = part[..., :n] * np.uint64(power) + part[..., size : size + n], size * 2
        power = power * power % 2**64
    ids = (ids ^ (ids >> np.uint64(32))) * _ODD
    return ids ^ (ids >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from every position on."""
    found, size = values, 1
    while size * 2 <= width:
        found, size = np.minimum(found[: len(found) - size], found[size:]), size * 2
    n = len(values) - width + 1
    return np.minimum(found[:n], found[width - size : width - size + n])


def suffix_runs(raw: bytes, length: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, number, bucket) of the runs of suffixes that point to one later q-gram.

    A suffix points to the least q-gram (the first of equal ones) inside its ``length`` bytes;
    equal suffixes do so at the same offset. A run never crosses a chunk's end.
    """
    width = length - q + 1
    for at in range(0, len(raw) - length + 1, CHUNK):
        data = np.frombuffer(raw[at : at + CHUNK + length - 1], np.uint8)
        ids = qgram_ids(data, q)
        least = _least(ids, width)
        moved = np.ones(len(least), bool)
        moved[1:] = (least[1:] != least[:-1]) | (ids[: len(least) - 1] == least[:-1])
        start = np.flatnonzero(moved)
        yield start + at, np.diff(np.append(start, len(least))), least[start].view(np.int64)


def _runs(length: int, q: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest, beyond = xxhash.xxh3_64_intdigest, length - 1
        for batch in batches:
            found, held = [], 0
            for doc, tie, text in zip(batch["doc"], batch["tie"], batch["text"], strict=True):
                raw = text.encode("utf-8")
                for start, n, bucket in suffix_runs(raw, length, q):
                    stop = start + n + beyond
                    content = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(start))
                    found.append((np.full(len(start), doc), np.full(len(start), tie), start, n, bucket, content.view(np.int64)))
                    held += len(start)
                    if held >= 200_000:
                        yield _table(found)
                        found, held = [], 0
            if found:
                yield _table(found)

    return run


def _table(found: list) -> pd.DataFrame:
    doc, tie, p, n, bucket, content = map(np.concatenate, zip(*found, strict=True))
    return pd.DataFrame({"doc": doc, "tie": tie, "p": p.astype(np.int32), "n": n.astype(np.int32), "bucket": bucket, "content": content})


def _placed(length: int, q: int):
    """Rows (doc, tie, s, n, o, x): bytes ``x`` of a run and the offset ``o`` of its later q-gram."""

    def table(rows: list) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=["doc", "tie", "s", "n", "x"])
        starts = np.frombuffer(b"".join(x[:length] for x in found["x"]), np.uint8).reshape(-1, length)
        return found.assign(o=qgram_ids(starts, q).argmin(axis=1).astype(np.int32))[["doc", "tie", "s", "n", "o", "x"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for doc, tie, text, heads in zip(batch["doc"].tolist(), batch["tie"].tolist(), batch["text"], batch["heads"], strict=True):
                raw = text.encode("utf-8")
                for head in heads.tolist():
                    s, n = head >> 32, head & 0xFFFFFFFF
                    rows.append((doc, tie, s, n, raw[s : s + n + length - 1]))
                    if len(rows) == 5000:
                        yield table(rows)
                        rows = []
        if rows:
            yield table(rows)

    return run


def _spans(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the packed spans (start, stop); overlapping and touching ones join."""
    spans = np.sort(spans)
    start, stop = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    first = np.ones(len(spans), bool)
    first[1:] = start[1:] > stop[:-1]
    return start[first], stop[np.append(first[1:], True)]


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept, removed = [], []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            raw = text.encode("utf-8")
            if spans is None:
                kept.append(raw)
                removed.append([])
                continue
            start, stop = _spans(spans)
            edges = [0, *np.stack([start, stop], 1).ravel().tolist(), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "m": batch["m"], "n_bytes": batch["n_bytes"], "kept": kept, "removed": removed})


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, ``doc`` and ``tie`` (their order is the documents' order), ``m`` equal rows.

    A doc_id of several rows is told apart by a hash of the text; all other ties are 0.
    """
    last = F.lit(2**63 - 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("doc", F.coalesce("doc_id", last))
    plain = rows.withColumns({"tie": F.lit(0).cast("long"), "m": F.lit(1).cast("long")})
    shared = landed(rows.groupBy("doc").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc"), "suffix-shared-ids")
    if shared.isEmpty():
        return plain
    shared = small_side(shared)
    several = (
        rows.join(shared, "doc").withColumn("tie", F.xxhash64("text"))
        .groupBy("doc", "tie", "doc_id").agg(F.first("text").alias("text"), F.count("*").alias("m"))
    )
    return landed(plain.join(shared, "doc", "left_anti").unionByName(several), "suffix-documents")


def _blocks(heads: DataFrame, placed: DataFrame, size: int, length: int) -> DataFrame:
    """Rows of one round: the suffixes of ``heads`` (doc, tie, s, p, n) in blocks of offsets.

    Suffixes p of a run lie at offsets before their later q-gram; a block holds those of
    offsets size*k to size*k + size - 1. All of them cover the ``length - size + 1`` bytes from
    offset size*k on: the bucket. The content is all that they cover together.
    """
    far = F.col("o") - F.col("p") + F.col("s")  # offset of the first suffix, the largest
    k = F.explode(F.sequence(F.floor((far - F.col("n") + 1) / size), F.floor(far / size)))
    rows = heads.join(placed.drop("n"), ["doc", "tie", "s"]).select("*", far.alias("far"), k.alias("k"))
    rows = rows.select(
        "doc", "tie", "s", "o", "x", "k",
        F.greatest("p", F.expr(f"cast(s + o - {size} * k - {size - 1} as int)")).alias("p"),
        F.least(F.expr("p + n - 1"), F.expr(f"cast(s + o - {size} * k as int)")).alias("last"),
    )
    core = F.expr(f"substring(x, cast(o - {size} * k + 1 as int), {length - size + 1})")
    whole = F.expr(f"substring(x, p - s + 1, last - p + {length})")
    return rows.select(
        "doc", "tie", "s", "p", F.expr("last - p + 1").alias("n"),
        wide_hash(F.lit(size), "k", core).alias("bucket"), wide_hash(whole).alias("content"),
    )


def _round(rows: DataFrame, length: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(repeats: doc, tie, span; heads: doc, tie, s, p, n) of one round's rows.

    Equal contents of a bucket are repeats but for the first. What remains of a bucket is one
    row per content; where there are several, they go on to the next round.
    """
    place = F.struct("doc", "tie", "p", "s")
    groups = landed(rows.groupBy("bucket", "content", "n").agg(F.min(place).alias("first"), F.count("*").alias("m")), f"suffix-{name}")
    open_buckets = groups.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select("bucket")
    heads = landed(groups.join(open_buckets, "bucket").select("first.*", "n"), f"suffix-{name}-heads")
    repeats = rows.join(groups.filter("m > 1").select("bucket", "content", "n", "first"), ["bucket", "content", "n"]).filter(place != F.col("first"))
    return landed(repeats.select("doc", "tie", _packed(F.col("p"), F.expr(f"p + n + {length - 1}")).alias("span")), f"suffix-{name}-repeats"), heads


def _packed(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def remove_repeats(docs: DataFrame, length: int = 100, q: int = QGRAM) -> DataFrame:
    """Removes every byte that a string of ``length`` bytes covers which also starts earlier.

    ``docs``: doc_id, text. Returns per row doc_id, n_bytes (UTF-8), ``kept`` (binary, the
    remaining bytes) and ``removed`` (array of start, stop: maximal runs). Earlier is a smaller
    doc_id, or a smaller offset of the same row; strings are those of the input, overlaps count,
    and none crosses rows.

    The suffix order is refined only as deep as ``length``. Round one: a suffix enters the
    bucket of the least q-gram at its later offsets, and neighbours that point to the same one
    are a row together, so a text has some 3 rows per 100 bytes. Suffixes alone in their bucket
    are done. Each following round splits rows into blocks of fewer offsets, whose bucket is
    longer; rows of equal content are settled at once (the first stays, the others repeat), and
    only what still differs within a bucket is refined, until each suffix is compared at its
    full length. Bucket identifiers are hashes: content has 128 bits, like those of each later
    round.

    Null text is empty. A null doc_id comes after all others. Rows of one doc_id are ordered by a
    hash of their texts; of rows equal in both the first keeps its bytes, and the others lose all
    if they have ``length``. Texts below ``length`` bytes are kept whole. An empty table gives an
    empty one. Other columns are not read.
    """
    if not 8 <= q <= length - max(BLOCKS):
        raise ValueError("q must be 8 at least and leave room for blocks")
    rows = _identified(docs)
    runs = landed(rows.filter(F.octet_length("text") >= length).select("doc", "tie", "text").mapInPandas(_runs(length, q), RUNS), "suffix-runs")
    # the first buckets are counted before their rows travel: most hold a single row
    crowded = landed(runs.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select("bucket"), "suffix-crowded")
    shared = landed(runs.join(crowded, "bucket").withColumn("s", F.col("p")), "suffix-shared")
    discard(runs, crowded)
    repeats, heads = _round(shared, length, "qgrams")
    discard(shared)
    spans = [repeats]
    lists = heads.groupBy("doc", "tie").agg(F.collect_list(_packed(F.col("s"), F.col("n"))).alias("heads"))
    placed = landed(rows.select("doc", "tie", "text").join(lists, ["doc", "tie"]).mapInPandas(_placed(length, q), PLACED), "suffix-placed")
    for size in BLOCKS:
        repeats, heads = _round(_blocks(heads, placed, size, length), length, f"block{size}")
        spans.append(repeats)
    discard(placed)
    merged = spans[0]
    for part in spans[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy("doc", "tie").agg(F.collect_list("span").alias("spans"))
    done = (
        rows.join(merged, ["doc", "tie"], "left").select("doc_id", "m", "text", F.octet_length("text").cast("long").alias("n_bytes"), "spans")
        .mapInPandas(_kept, "doc_id long, m long, n_bytes long, kept binary, removed array<struct<start:long,stop:long>>")
    )
    out = ["doc_id", "n_bytes", "kept", "removed"]
    if rows.filter("m > 1").isEmpty():
        return done.select(*out)
    done = landed(done, "suffix-kept")
    whole = F.expr(f"n_bytes >= {length}")
    copies = done.filter("m > 1").select(
        "doc_id", "n_bytes", F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, F.expr("array(struct(0L as start, n_bytes as stop))")).otherwise(F.col("removed")).alias("removed"),
        F.explode(F.expr("sequence(2L, m)")),
    )
    return done.select(*out).unionByName(copies.select(*out))
