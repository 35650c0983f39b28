"""Scores: detection quality, throughput, latency, agreement, threshold search."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.config import DEFAULTS, SEVERITIES, Settings
from roadloom.functions.text import base_name, median3
from roadloom.operators.ranking import seeded_rank
from roadloom.session import cut


def class_universe(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    return predictions.select("class_name").union(truth.select("class_name")).distinct()


def detection_scores(predictions: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 per class and overall (class_name = 'overall').

    ``matches``: l_id, the matched prediction. All three inputs are reduced to one row per
    class before they meet.
    """
    hits = matches.select(F.col("l_id").alias("defect_id")).withColumn("tp", F.lit(1))
    p = predictions.join(hits, "defect_id", "left").groupBy("class_name").agg(
        F.count("*").alias("p"), F.count("tp").alias("tp")
    )
    t = truth.groupBy("class_name").agg(F.count("*").alias("t"))
    zero = F.lit(0).cast("bigint")
    per = p.join(t, "class_name", "full").select(
        "class_name", F.coalesce("tp", zero).alias("tp"), F.coalesce("p", zero).alias("p"), F.coalesce("t", zero).alias("t")
    )
    every = per.rollup("class_name").agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    tp, np_, nt = F.coalesce("tp", zero), F.coalesce("p", zero), F.coalesce("t", zero)
    empty = F.when((np_ == 0) & (nt == 0), F.lit(1.0)).otherwise(F.lit(0.0))
    scored = every.select(
        F.coalesce("class_name", F.lit("overall")).alias("class_name"),
        tp.alias("tp"),
        (np_ - tp).alias("fp"),
        (nt - tp).alias("fn"),
        F.when(np_ > 0, tp / np_).otherwise(empty).alias("precision"),
        F.when(nt > 0, tp / nt).otherwise(empty).alias("recall"),
    )
    pr, rc = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(pr + rc > 0, 2.0 * pr * rc / (pr + rc)).otherwise(F.lit(0.0)))


def fp_per_km(fp: Column, km: Column) -> Column:
    return F.when(km > 0, fp / km).otherwise(F.lit(0.0))


def throughput(timings: DataFrame) -> DataFrame:
    """Mean of per-survey km/h for automated and manual work, and the speed-up."""

    def speed(seconds: str) -> Column:
        s = F.col(seconds)
        return F.coalesce(F.avg(F.when(s > 0, F.col("route_distance_km") / (s / 3600.0))), F.lit(0.0))

    n = F.count_if(F.col("automated_time_s") > 0)
    out = timings.agg(n.alias("n_runs"), speed("automated_time_s").alias("auto_kmh"), speed("manual_time_s").alias("manual_kmh"))
    return out.withColumn(
        "speedup", F.when(F.col("manual_kmh") > 0, F.col("auto_kmh") / F.col("manual_kmh")).otherwise(F.lit(0.0))
    )


def latency(timings: DataFrame) -> DataFrame:
    return timings.filter(F.col("latency_s").isNotNull()).agg(
        F.count("*").alias("n_runs"),
        F.avg("latency_s").alias("mean_s"),
        F.min("latency_s").alias("min_s"),
        F.max("latency_s").alias("max_s"),
    )


def kappa(counts: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """Quadratic-weighted kappa per key from confusion counts (keys, i, j, n).

    Needs only moments of the counts: with row and column marginals the expected squared
    difference has a closed form. Null with a note where a rater is constant.
    """
    i, j, n = F.col("i").cast("double"), F.col("j").cast("double"), F.col("n")
    agg = counts.groupBy(*keys).agg(
        F.sum("n").cast("bigint").alias("n"),
        F.sum(n * (i - j) * (i - j)).alias("_o"),
        F.sum(n * i).alias("_si"),
        F.sum(n * j).alias("_sj"),
        F.sum(n * i * i).alias("_sii"),
        F.sum(n * j * j).alias("_sjj"),
        F.min("i").alias("_i1"),
        F.max("i").alias("_i2"),
        F.min("j").alias("_j1"),
        F.max("j").alias("_j2"),
    )
    expected = F.col("_sii") + F.col("_sjj") - 2.0 * F.col("_si") * F.col("_sj") / F.col("n")
    flat_i, flat_j = F.col("_i1") == F.col("_i2"), F.col("_j1") == F.col("_j2")
    same = flat_i & flat_j & (F.col("_i1") == F.col("_j1"))
    return agg.select(
        *keys,
        "n",
        F.when(flat_i | flat_j, F.lit(None)).otherwise(1.0 - F.col("_o") / expected).alias("kappa"),
        F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("no ratings")).when(same, F.lit("single category")).when(flat_i | flat_j, F.lit("constant rater")).alias("note"),
    )


def confusion_counts(df: DataFrame, i: Column, j: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, i.alias("i"), j.alias("j")).agg(F.count("*").alias("n"))


def full_confusion(counts: DataFrame, k: int = 3) -> DataFrame:
    """k x k cells with zeros where a pair of labels never occurs."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
    grid = counts.sparkSession.range(1).select(F.explode(steps).alias("i")).withColumn("j", F.explode(steps))
    return grid.join(counts, ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"))


def with_consensus(ratings: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Median of the raters of each crop, rounded half to even and clamped to 0..2."""
    middle = median3(F.array(*[F.col(r).cast("double") for r in raters]))
    return ratings.withColumn(
        "consensus", F.greatest(F.lit(0), F.least(F.lit(2), F.bround(middle, 0))).cast("bigint")
    )


def join_metadata(sheet: DataFrame, meta: DataFrame) -> DataFrame:
    """Sheet rows with ``area_ratio``: their own (``own``), else that of the crop file of the same name.

    sheet: filename, own; meta: file, meta_ratio (of a repeated name the largest). Rows with
    neither are dropped.
    """
    named = meta.groupBy(base_name(F.col("file")).alias("_name")).agg(F.max("meta_ratio").alias("_ratio"))
    return (
        sheet.withColumn("_name", base_name(F.col("filename")))
        .join(named, "_name", "left")
        .withColumn("area_ratio", F.coalesce("own", "_ratio"))
        .filter(F.col("area_ratio").isNotNull())
        .drop("_name", "_ratio")
    )


def pairwise_kappa(ratings: DataFrame, raters: Sequence[str], system: str = "system") -> DataFrame:
    """Kappa of the system with every rater and of all rater pairs; blanks drop pairwise.

    All pairs are formed inside the row, so ratings are scanned and shuffled once.
    """
    pairs = [(system, r) for r in raters] + list(combinations(raters, 2))
    arr = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("i"), F.col(b).alias("j"))
            for a, b in pairs
        ]
    )
    rows = ratings.select(F.explode(arr).alias("p")).select("p.*").filter("i is not null and j is not null")
    return kappa(rows.groupBy("a", "b", "i", "j").agg(F.count("*").alias("n")), ["a", "b"])


LOW_STEPS = (0.005, 0.06, 24)
MEDIUM_STEPS = (0.04, 0.20, 33)


def _grid(spec: tuple[float, float, int]) -> list[float]:
    start, stop, n = spec
    step = (stop - start) / (n - 1)
    return [stop if q == n - 1 else q * step + start for q in range(n)]


def _doubles(values: list) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def seeded_split(crops: DataFrame, id_col: str, seed: int, ratio: float = 0.7) -> DataFrame:
    """Adds ``is_train``: the first max(1, round(ratio n)) rows of a seeded order, all but one at most."""
    ranked = seeded_rank(crops, F.col(id_col).cast("string"), seed, "_rk", [id_col])
    n = F.count("*")
    size = F.greatest(F.lit(1), F.bround(n * F.lit(ratio), 0).cast("bigint"))
    size = crops.agg(F.when(size >= n, n - 1).otherwise(size)).scalar()
    return ranked.withColumn("is_train", F.col("_rk") <= size).drop("_rk")


def tune_thresholds(
    crops: DataFrame, id_col: str = "crop_id", seed: int = 42, ratio: float = 0.7, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Grid search of the two severity thresholds against the consensus; one result row.

    Crops (area_ratio, consensus 0..2) are counted once per (interval between neighbouring
    thresholds, consensus, split): at most 60 x 3 x 2 rows whatever the input size. The
    792 grid points are tried on those counts.
    """
    lows, meds = _grid(LOW_STEPS), _grid(MEDIUM_STEPS)
    at = sorted(
        {v for v in lows + meds}
        | {round(v, 4) for v in lows + meds}
        | {cfg.low_max_ratio, cfg.medium_max_ratio}
    )
    cuts = F.expr(_doubles(at))
    binned = (
        seeded_split(crops, id_col, seed, ratio)
        .withColumn("bin", F.size(F.filter(cuts, lambda v: v <= F.col("area_ratio"))))
        .groupBy("is_train", "bin", F.col("consensus").alias("j"))
        .agg(F.count("*").alias("n"))
    )
    binned = cut(binned)
    position = {v: n + 1 for n, v in enumerate(at)}

    def pick(values: list, n: Column) -> Column:
        return F.element_at(F.expr(_doubles(values)), n + 1)

    a, b = F.col("a"), F.col("b")
    steps = binned.filter("is_train").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(len(lows) - 1))))
    steps = steps.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(len(meds) - 1))))
    grid = steps.select(
        "bin", "j", "n",
        (a * len(meds) + b).alias("g"),
        pick(lows, a).alias("low"), pick(meds, b).alias("med"),
        pick([position[v] for v in lows], a).alias("lb"), pick([position[v] for v in meds], b).alias("mb"),
    ).filter("low < med")

    def predicted(low_bin, med_bin) -> Column:
        return F.when(F.col("bin") < low_bin, F.lit(0)).when(F.col("bin") < med_bin, F.lit(1)).otherwise(F.lit(2))

    tried = grid.select("g", "low", "med", predicted(F.col("lb"), F.col("mb")).alias("i"), "j", "n")
    scores = kappa(tried.groupBy("g", "low", "med", "i", "j").agg(F.sum("n").alias("n")), ["g", "low", "med"])
    best = scores.select(
        F.struct(F.round(F.coalesce("kappa", F.lit(0.0)), 12).alias("kappa"), (-F.col("g")).alias("order"), "low", "med").alias("s")
    ).agg(F.max("s").alias("s")).select(
        F.col("s.kappa").alias("tuned_train_kappa"), F.round("s.low", 4).alias("low"), F.round("s.med", 4).alias("med")
    )

    def score(train: bool, low_bin, med_bin) -> DataFrame:
        part = binned.filter(F.col("is_train") == train)
        c = part.groupBy(predicted(low_bin, med_bin).alias("i"), "j").agg(F.sum("n").alias("n"))
        return kappa(c, []).select(F.coalesce("kappa", F.lit(0.0)).alias("kappa"), "n")

    best = cut(best)
    # both proposed thresholds are rounded grid values, so they are cut points themselves
    low_bin = best.select(F.array_position(cuts, F.col("low")).cast("int")).scalar()
    med_bin = best.select(F.array_position(cuts, F.col("med")).cast("int")).scalar()
    low0, med0 = position[cfg.low_max_ratio], position[cfg.medium_max_ratio]
    before_train, before_test = cut(score(True, low0, med0)), cut(score(False, low0, med0))
    out = (
        best.withColumn("initial_train_kappa", before_train.select("kappa").scalar())
        .withColumn("initial_test_kappa", before_test.select("kappa").scalar())
        .withColumn("n_initial_train_kappa", before_train.select("n").scalar())
        .withColumn("n_initial_test_kappa", before_test.select("n").scalar())
        .withColumn("tuned_test_kappa", score(False, low_bin, med_bin).select("kappa").scalar())
    )
    total = F.col("n_initial_train_kappa") + F.col("n_initial_test_kappa")
    return out.select(
        total.alias("n_samples"),
        F.col("n_initial_train_kappa").alias("train_size"),
        F.col("n_initial_test_kappa").alias("test_size"),
        "initial_train_kappa", "initial_test_kappa", "low", "med", "tuned_train_kappa", "tuned_test_kappa",
        F.when(total < 30, F.lit("small sample")).otherwise(F.lit("")).alias("warnings"),
    )


def metric_row(source: DataFrame, name: str, n: Column, value: Column) -> DataFrame:
    """One line of the consolidated report."""
    rows = source.agg(n.cast("bigint").alias("n"), value.cast("double").alias("value"))
    measured = F.coalesce("n", F.lit(0)) > 0
    return rows.select(
        F.lit(name).alias("metric"),
        F.when(measured, F.lit("MEASURED")).otherwise(F.lit("NOT MEASURED")).alias("state"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(measured, F.col("value")).alias("value"),
    )


def label_number(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), label) - 1
