"""Best-fit packing of token sequences: large items are matched, small ones fill the gaps."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import landed
from roadloom.llm.tokens import broadcast_whole_tokens, is_byte_level, merger

#: parts a size is dealt into while its items are ranked
PARTS = 1024


def token_pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids).

    A document's ids are followed by ``end_id``. Longer ones are cut into pieces of ``size``;
    the first piece takes what is left over, so that all others are full.
    """
    if not is_byte_level(path):
        raise ValueError("packing needs a byte-level tokenizer")
    whole = broadcast_whole_tokens(docs.sparkSession, path)
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = merger(path, whole, True).encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                first = n % size or size
                for k, at in enumerate([0, *range(first, n, size)]):
                    part = ids[4 * at : 4 * (first if k == 0 else at + size)]
                    row = (doc, k, at, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype("int32")) if with_ids else row)
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, schema)


@dataclass
class _Bins:
    """``n`` bins filled alike. slots: (item size, offset, rank of the first bin's item)."""

    n: int
    gap: int
    slots: list[tuple[int, int, int]]

    def take(self, n: int) -> _Bins:
        """Splits off the first ``n`` bins."""
        part = _Bins(n, self.gap, list(self.slots))
        self.slots = [(s, o, r + n) for s, o, r in self.slots]
        self.n -= n
        return part


def plan_bins(counts: Mapping[int, int], size: int = 1024) -> list[_Bins]:
    """Packs items given as numbers per size; the result has a bounded number of entries.

    Items over a third of ``size`` go at most twice into a bin: from the largest on, each is
    matched with the largest other one that fits. Smaller items then fill, largest first, the
    smallest gap they fit in, and open bins of their own when none is left. Bins filled alike
    are one entry, so the work depends on ``size`` and not on the number of items.
    """
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    ready: list[_Bins] = []

    def draw(s: int, n: int) -> int:
        rank, used[s], left[s] = used[s], used[s] + n, left[s] - n
        return rank

    third = size // 3
    for s in range(size, third, -1):
        while left.get(s):
            t = min(size - s, s)
            while t > third and left.get(t, 0) < 1 + (t == s):
                t -= 1
            if t <= third:
                n = left[s]
                ready.append(_Bins(n, size - s, [(s, 0, draw(s, n))]))
            else:
                n = left[s] // 2 if t == s else min(left[s], left[t])
                ready.append(_Bins(n, size - s - t, [(s, 0, draw(s, n)), (t, s, draw(t, n))]))
    gaps: dict[int, list[_Bins]] = {}
    for b in ready:
        gaps.setdefault(b.gap, []).append(b)
    for s in range(third, 0, -1):
        heap = [g for g in gaps if g >= s]
        heapq.heapify(heap)
        while left.get(s):
            while heap and not gaps.get(heap[0]):
                heapq.heappop(heap)
            if heap:
                bins = gaps[heap[0]].pop()
            else:
                fit = size // s
                bins = _Bins(left[s] // fit or 1, size, [])
            fit = min(bins.gap // s, left[s])  # a bin stays the tightest while more of them fit
            n = min(bins.n, left[s] // fit)
            part = bins if n == bins.n else bins.take(n)
            if part is not bins:
                gaps.setdefault(bins.gap, []).append(bins)
            for _ in range(fit):
                part.slots.append((s, size - part.gap, draw(s, n)))
                part.gap -= s
            gaps.setdefault(part.gap, []).append(part)
            if part.gap >= s:
                heapq.heappush(heap, part.gap)
    return [b for group in gaps.values() for b in group]


def pack_pieces(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (any columns, ``length`` from 1 to ``size``).

    Only the histogram of the lengths (at most ``size`` rows) is planned on the driver. Items
    are ranked within their length in parts dealt by hash, so a length that a third of all rows share
    is ranked in many tasks; the rank then finds its slot in the plan by binary search.
    ``pieces`` must be stable under recomputation (a landed table).
    """
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).alias("_part")
    sizes = landed(pieces.select("length", part).groupBy("length", "_part").agg(F.count("*").alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    keys, rows, base = [], [], 0
    for b in plan_bins(counts, size):
        for s, offset, rank in b.slots:
            keys.append((s << 44) + rank)
            rows.append((rank, base, offset))
        base += b.n
    order = np.argsort(np.array(keys, dtype="int64"))
    starts, slots = np.array(keys, dtype="int64")[order], np.array(rows, dtype="int64").reshape(-1, 3)[order]
    plan = pieces.sparkSession.sparkContext.broadcast((starts, slots))

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(within) - 1)
        .join(offsets, ["length", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, slots = plan.value
        at = np.searchsorted(starts, (length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        first, base, offset = slots[at].T
        return pd.DataFrame({"sequence_id": base + rank.to_numpy() - first, "offset": offset})

    return ranked.withColumn("_at", place("length", "_rank")).select(
        *pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset")
    )


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Packs whole documents into sequences of at most ``size`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts are the end id alone. Repeated rows are packed each; ties of length
    go by doc_id and piece. Pieces are landed once, so the ranks survive a lost executor. An
    empty table gives no rows. Other columns are not read.
    """
    return pack_pieces(landed(token_pieces(docs, path, size, end_id), "token-pieces"), size)
