"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import landed, release

LETTERS = re.compile(r"[^\W\d_]+")
ORDER = 4
#: bits of an n-gram's hash. A model has at most 2^HASH_BITS n-grams of each order, whatever
#: the size of the corpus, which bounds what is broadcast
HASH_BITS = 20
#: at most so many languages are learned; more is an error, not a cut
MAX_LANGUAGES = 64
#: distinct words a task counts before it emits them
WORDS_HELD = 100_000

#: characters scored together; bounds a task's memory
CHARS_HELD = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGE = "\x01"


def _words(text: str) -> Counter:
    """Lower-cased runs of letters of the whole text, with their counts."""
    found = Counter(LETTERS.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:  # the pattern takes some numerals for letters
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def _grams(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashed n-grams that end at each letter of the words and at their ends.

    A word is framed by edges and contexts don't cross them. Returns, for n = 1..ORDER, the
    hashes of the n-grams and those of the n - 1 letters before each position; and the word's
    number at each position.
    """
    pad = _EDGE * (ORDER - 1)
    text = "".join(pad + w + _EDGE for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype("uint64") + np.uint64(1)
    lengths = np.fromiter(map(len, words), dtype="int64", count=len(words)) + 1
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(owner)) + (owner + 1) * len(pad)
    grams, contexts = [], [np.zeros(len(at), dtype="uint64")]
    h = np.zeros(len(codes), dtype="uint64")
    for back in range(ORDER):
        h[back:] = (h[back:] + codes[: len(codes) - back]) * _MIX
        h ^= h >> np.uint64(29)
        full = (h * _MIX) >> np.uint64(64 - HASH_BITS)
        grams.append(full[at])
        contexts.append(full[at - 1])
    return grams, contexts[:ORDER], owner


def count_grams(labelled: DataFrame) -> DataFrame:
    """Counts of all n-grams of the whole texts: lang, n, context, gram, shorter, count.

    ``shorter`` is the n-gram without its first letter. A task counts words first, so an
    n-gram of a repeated word is hashed once; what leaves the task is already summed.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def emit():
            for lang, words in held.items():
                keys = list(words)
                if not keys:
                    continue
                grams, contexts, owner = _grams(keys)
                weight = np.fromiter(words.values(), dtype="int64", count=len(keys))[owner]
                for n in range(1, ORDER + 1):
                    key = (contexts[n - 1] << np.uint64(HASH_BITS)) | grams[n - 1]
                    found, where, which = np.unique(key, return_index=True, return_inverse=True)
                    yield pd.DataFrame({
                        "lang": lang, "n": n,
                        "context": (found >> np.uint64(HASH_BITS)).astype("int64"),
                        "gram": (found & np.uint64((1 << HASH_BITS) - 1)).astype("int64"),
                        "shorter": (grams[n - 2][where] if n > 1 else np.zeros(len(found))).astype("int64"),
                        "count": np.bincount(which, weights=weight).astype("int64"),
                    })
            held.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                held.setdefault(lang, Counter()).update(_words(text))
                if sum(map(len, held.values())) > WORDS_HELD:
                    yield from emit()
            release()
        yield from emit()

    schema = "lang string, n int, context long, gram long, shorter long, count long"
    return (
        labelled.select("text", "lang").filter("text is not null and lang is not null")
        .mapInPandas(count, schema)
        .groupBy("lang", "n", "gram").agg(F.min("context").alias("context"), F.min("shorter").alias("shorter"), F.sum("count").alias("count"))
    )


@dataclass
class Models:
    """Models of all languages over common sorted hash arrays.

    ``grams[n]``, ``contexts[n]``: sorted hashes; ``logp[n]``: log probability of a gram per
    language (NaN where the language lacks it); ``back[n]``: log weight of the shorter context
    (0 where unseen).
    """

    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]
    floor: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Sum of -log p over each word's letters and its end, per language."""
        grams, contexts, owner = _grams(words)
        total = np.zeros((len(owner), len(self.langs)))
        open_ = np.ones((len(owner), len(self.langs)), dtype=bool)
        rows = np.arange(len(owner))
        for n in range(ORDER, 0, -1):
            rows = rows[open_[rows].any(axis=1)]
            if not len(rows):
                break
            p = _look_up(self.grams[n - 1], self.logp[n - 1], grams[n - 1][rows], np.nan)
            seen = ~np.isnan(p)
            if n > 1:
                lost = _look_up(self.contexts[n - 1], self.back[n - 1], contexts[n - 1][rows], 0.0)
            else:
                lost = np.full(p.shape, self.floor)  # a letter that no text had
            was = open_[rows]
            total[rows] += np.where(was, np.where(seen, p, lost), 0.0)
            open_[rows] = was & ~seen
        out = np.zeros((len(words), len(self.langs)))
        np.add.at(out, owner, -total)
        return out


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[at].astype("float64")
    out[keys[at] != wanted] = missing
    return out


def fit(labelled: DataFrame) -> Models:
    """Interpolated Kneser-Ney models of every language in ``labelled`` (text, lang).

    The longest n-grams use their counts, shorter ones the number of letters seen before
    them. The discount is n1 / (n1 + 2 n2) per language and order. Counting, continuation
    counts and the probabilities of each level are Spark aggregations; the arrays that
    reach the driver are bounded by HASH_BITS and MAX_LANGUAGES.
    """
    raw = landed(count_grams(labelled), "grams")
    langs = sorted(r["lang"] for r in raw.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # how many different letters precede a shorter n-gram
    before = raw.filter("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("shorter").alias("gram")).agg(F.count("*").alias("kinds"))
    used = raw.join(before, ["lang", "n", "gram"], "left").select(
        "lang", "n", "context", "gram", "shorter",
        F.when(F.col("n") == ORDER, F.col("count")).otherwise(F.coalesce("kinds", F.lit(1))).alias("c"),
    )
    discount = used.groupBy("lang", "n").agg(
        F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("c") == 2, 1).otherwise(0)).alias("n2")
    ).select("lang", "n", F.expr("case when n1 = 0 then 0.5D else greatest(0.1D, double(n1) / (n1 + 2 * n2)) end").alias("d"))
    context = used.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    context = context.join(discount, ["lang", "n"]).withColumn("back", F.expr("d * kinds / total"))
    used = landed(used.join(context.drop("kinds"), ["lang", "n", "context"]).withColumn("own", F.expr("greatest(c - d, 0D) / total")), "gram-weights")
    letters = used.filter("n = 1").groupBy("lang").agg(F.count("*").alias("kinds"))
    # level by level: p = own + back * p of the shorter
    p = used.filter("n = 1").join(letters, "lang").select("lang", "n", "gram", F.expr("own + back / (kinds + 1)").alias("p"))
    levels = [p]
    for n in range(2, ORDER + 1):
        shorter = levels[-1].select("lang", F.col("gram").alias("shorter"), F.col("p").alias("q"))
        levels.append(
            used.filter(F.col("n") == n).join(shorter, ["lang", "shorter"], "left")
            .select("lang", "n", "gram", F.expr("own + back * coalesce(q, 0D)").alias("p"))
        )
    table = levels[0]
    for more in levels[1:]:
        table = table.unionByName(more)
    column = {lang: k for k, lang in enumerate(langs)}
    grams, logp = _arrays(table.select("lang", "n", F.col("gram").alias("key"), F.log("p").cast("float").alias("value")), column, np.nan)
    contexts, back = _arrays(context.select("lang", "n", F.col("context").alias("key"), F.log("back").cast("float").alias("value")), column, 0.0)
    return Models(langs, grams, logp, contexts, back, floor=-12.0)


def _arrays(table: DataFrame, column: dict[str, int], missing: float):
    found = table.toPandas()
    keys, values = [], []
    for n in range(1, ORDER + 1):
        part = found[found["n"] == n]
        key = np.unique(part["key"].to_numpy().astype("uint64"))
        value = np.full((len(key), len(column)), missing, dtype="float32")
        value[np.searchsorted(key, part["key"].to_numpy().astype("uint64")), part["lang"].map(column).to_numpy().astype("int64")] = part["value"]
        keys.append(key)
        values.append(value)
    return keys, values


def _score(texts: list[str], model: Models) -> pd.DataFrame:
    """Letters and entropies of some texts; each distinct word is scored once."""
    counts = [_words(t) for t in texts]
    names = list(dict.fromkeys(w for words in counts for w in words))
    number = {w: k for k, w in enumerate(names)}
    table = np.zeros((len(names), len(model.langs)))
    for at in range(0, len(names), 10_000):
        table[at : at + 10_000] = model.word_scores(names[at : at + 10_000])
    letters, entropy = [], []
    for words in counts:
        weight = np.fromiter(words.values(), dtype="float64", count=len(words))
        rows = np.fromiter(map(number.__getitem__, words), dtype="int64", count=len(words))
        n = sum(len(w) * k for w, k in words.items())
        letters.append(n)
        entropy.append(weight @ table[rows] / (n + weight.sum()) if n and model.langs else None)
    return pd.DataFrame({"letters": np.array(letters, dtype="int64"), "entropy": pd.Series(entropy, dtype="object")})


def cross_entropies(docs: DataFrame, models: Models) -> tuple[DataFrame, Broadcast]:
    """Adds letters (long) and entropy (array of nats per letter and word end, by language;
    null for a text without letters) to ``docs``, which has ``text``; and the broadcast models, to be destroyed after use."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("letters long, entropy array<double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        parts, held, chars = [], [], 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars > CHARS_HELD:
                parts.append(_score(held, shared.value))
                held, chars = [], 0
        parts.append(_score(held, shared.value))
        release()
        return pd.concat(parts, ignore_index=True)

    scores = docs.withColumn("_s", score("text")).select(
        *docs.columns, F.col("_s.letters").alias("letters"), F.col("_s.entropy").alias("entropy")
    )
    return scores, shared


def identify(docs: DataFrame, learn) -> DataFrame:
    """Language of every whole text, by the lowest cross-entropy per letter.

    ``docs``: doc_id, text, lang. ``learn``: condition for rows whose label may be learned;
    only their text and lang are used. Returns doc_id, lang_pred, score, rejected.
    ``score`` (0 to 1) is the share of the best language by likelihood, tempered by the
    spread that learned rows show. ``rejected``: no letters, or the entropy lies beyond what
    learned rows of that language show: over 0.6 of the way to the entropy of other
    languages' rows, plus four deviations for the text's length. Null and letterless texts
    are ``und`` with score 0 and rejected; so is all text if nothing can be learned. Ties go to the first
    language by name. Repeated rows are treated alike; other columns are not read.
    """
    return _identified(docs, learn).drop("_tx")


def keep_identified(docs: DataFrame, learn) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is recognised (not ``rejected``)."""
    gone = _identified(docs, learn).filter("rejected").select(
        F.col("doc_id").alias("__doc"), F.col("_tx").alias("__tx")
    ).distinct()
    gone = landed(gone, "rejected")
    same = docs["doc_id"].eqNullSafe(gone["__doc"]) & (F.xxhash64(docs["text"]) == gone["__tx"])
    return docs.join(gone, same, "left_anti")


def _identified(docs: DataFrame, learn) -> DataFrame:
    tidy = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("_tx"), F.coalesce(learn, F.lit(False)).alias("_learn"))
    models = fit(tidy.filter("_learn and lang is not null and text is not null"))
    scores, shared = cross_entropies(tidy, models)
    scored = landed(scores.drop("text"), "entropies")
    shared.destroy()
    models, scores = Models(models.langs, [], [], [], [], models.floor), None  # the arrays have done their work
    langs = F.array(*[F.lit(x) for x in models.langs]) if models.langs else F.array().cast("array<string>")
    # calibration: rows of the language and of the others, one aggregate row per language
    fits = (
        scored.filter("_learn and lang is not null and entropy is not null")
        .select("lang", "letters", F.posexplode("entropy").alias("_k", "_e"))
        .withColumn("_own", F.col("lang") == F.element_at(langs, F.col("_k") + 1))
        .groupBy("_k").agg(
            F.avg(F.when(F.col("_own"), F.col("_e"))).alias("own"),
            F.avg(F.when(~F.col("_own"), F.col("_e"))).alias("other"),
            F.stddev_pop(F.when(F.col("_own"), F.col("_e"))).alias("spread"),
            F.avg(F.when(F.col("_own"), F.sqrt("letters"))).alias("size"),
        ).collect()  # a row per language
    ) if models.langs else []
    by = {r["_k"]: r for r in fits}
    uniform = 4.0
    limit, noise = [], []
    for k in range(len(models.langs)):
        r = by.get(k)
        own = r["own"] if r and r["own"] is not None else uniform
        other = r["other"] if r and r["other"] is not None else max(uniform, own + 1)
        limit.append(float(own + 0.6 * max(other - own, 0.5)))
        noise.append(float(max((r["spread"] or 0.0) * (r["size"] or 1.0), 0.5) if r else 0.5))
    lits = lambda xs: F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>")
    best = F.array_min("entropy")
    at = F.array_position("entropy", best).cast("int")
    slack = F.element_at("_noise", F.col("_at")) / F.sqrt("letters")
    known = scored.withColumn("_best", best).withColumn("_at", at).withColumn("_limit", lits(limit)).withColumn("_noise", lits(noise))
    weight = F.expr("aggregate(entropy, 0D, (s, e) -> s + exp(-(e - _best) * least(sqrt(letters), 100D) / element_at(_noise, _at)))")
    return known.select(
        "doc_id", "_tx",
        F.when(F.col("_at").isNotNull(), F.element_at(langs, F.col("_at"))).otherwise("und").alias("lang_pred"),
        F.coalesce(1 / F.when(F.col("_at").isNotNull(), weight), F.lit(0.0)).alias("score"),
        F.when(F.col("_at").isNotNull(), F.col("_best") > F.element_at("_limit", F.col("_at")) + 4 * slack).otherwise(True).alias("rejected"),
    ) if models.langs else scored.select("doc_id", "_tx", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
