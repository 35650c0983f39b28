"""Token counts and ids: whole vocabulary strings are looked up, only the rest is merged."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: merged pre-tokens a worker remembers before it starts afresh; bounds its memory, not the result
REMEMBERED = 1_000_000

_L = "A-Za-zÀ-ÖØ-öø-ɏ"
#: pre-tokens of texts in PLAIN (fixed values); first the ones that take a leading space
PRE_TOKEN = re.compile(
    rf" (?:[{_L}]+|[0-9]+|[^\s0-9{_L}]+)|[{_L}]+|'(?:[sdmt]|ll|ve|re)|[0-9]+|[^\s0-9{_L}]+|\s+(?!\S)|\s+"
)
#: texts whose letters are Latin and whose numbers are ASCII; the library encodes all others whole
PLAIN = re.compile(r"[\t\n\r -~¡-©«¬®-±´¶-¸»¿-ɏ]*\Z")


def byte_alphabet() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (chr(256 + i) for i in range(256))
    return {b: chr(b) if b in printable else next(spare) for b in range(256)}


def is_byte_level(path: str) -> bool:
    """Does the shortcut hold: byte-level pre-tokens by pattern, nothing normalised or added?"""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (
        pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
    )


def prove_whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that the library itself encodes alone as one token.

    Strings that aren't whole UTF-8, or come out as several tokens, stay out. Done once, on
    the driver, over the vocabulary; the result is no larger than that.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    back = {c: b for b, c in byte_alphabet().items()}
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    strings = []
    for written in tok.get_vocab():
        if written not in special and all(c in back for c in written):
            try:
                strings.append(bytes(back[c] for c in written).decode("utf-8"))
            except UnicodeDecodeError:
                continue
    found = tok.encode_batch(strings, add_special_tokens=False)
    return {s: e.ids[0] for s, e in zip(strings, found, strict=True) if len(e.ids) == 1}


class Merger:
    """Encodes texts in one worker. ``ids``: results are little-endian id bytes, else counts.

    A text is cut into pre-tokens; those proven to be one token are looked up, the rest is
    merged by the library's own model, once for each that the worker remembers. Texts with
    special strings, or characters beyond PLAIN, go to the library whole.
    """

    def __init__(self, path: str, whole: dict[str, int], ids: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.table = byte_alphabet()
        self.space = self.table[32]
        self.ids = ids
        self.whole = {s: self._result([i]) for s, i in whole.items()}
        self.known = dict(self.whole)

    def _result(self, ids: list[int]):
        if not self.ids:
            return len(ids)
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _merge(self, pre: str):
        if pre.isascii() and pre.isprintable():
            written = pre.replace(" ", self.space)
        else:
            written = pre.encode("utf-8").decode("latin-1").translate(self.table)
        parts = self.model.tokenize(written)
        return self._result([t.id for t in parts]) if self.ids else len(parts)

    def encode(self, text: str):
        if not PLAIN.match(text) or any(s in text for s in self.special):
            return self._result(self.tok.encode(text, add_special_tokens=False).ids)
        pre = PRE_TOKEN.findall(text)
        found = list(map(self.known.get, pre))
        if None in found:
            known, merge = self.known, self._merge
            if len(known) > REMEMBERED:
                known.clear()
                known.update(self.whole)
            for i, x in enumerate(found):
                if x is None:
                    found[i] = known[pre[i]] = merge(pre[i])
        return b"".join(found) if self.ids else sum(found)


_workers: dict[tuple, Merger] = {}


def merger(path: str, whole, ids: bool) -> Merger:
    """The worker's own, kept between tasks. ``whole``: the broadcast table."""
    if (path, ids) not in _workers:
        _workers[path, ids] = Merger(path, whole.value, ids)
    return _workers[path, ids]


def broadcast_whole_tokens(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(prove_whole_tokens(path))


def _library_counts(path: str, texts: list[str]) -> list[int]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _libraries:
        if path.endswith(".model"):
            import sentencepiece

            _libraries[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _libraries[path] = Tokenizer.from_file(path)
    library = _libraries[path]
    if path.endswith(".model"):
        return [len(x) for x in library.encode(texts, num_threads=1)]
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


_libraries: dict[str, object] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text.

    ``docs``: doc_id, text; ``path``: the tokenizer's file, present on every executor.
    Returns doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), one row per
    input row, without a shuffle. Null and empty texts have no tokens. Byte-level tokenizers
    use the shortcut; for others the library encodes each text. Other columns are not read.
    """
    if is_byte_level(path):
        whole = broadcast_whole_tokens(docs.sparkSession, path)

        @F.pandas_udf("long")
        def n_tokens(texts: pd.Series) -> pd.Series:
            encode = merger(path, whole, False).encode
            return pd.Series([encode(t) if t else 0 for t in texts], dtype="int64")
    else:

        @F.pandas_udf("long")
        def n_tokens(texts: pd.Series) -> pd.Series:
            return pd.Series(_library_counts(path, [t or "" for t in texts]), dtype="int64")

    text = F.coalesce("text", F.lit(""))
    return (
        docs.select("doc_id", "text")
        .select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
