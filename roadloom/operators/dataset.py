"""Image dataset jobs: grouped splits, leakage checks, label audits, class mapping, crops."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.config import EXCLUDED_CLASSES, ORIENTATION, THREE_CLASS
from roadloom.functions import boxes
from roadloom.operators.ranking import seeded_key, seeded_rank
from roadloom.session import cut

IMG_W, IMG_H = 640, 640


# splits ------------------------------------------------------------------------------


def grouped_split(
    images: DataFrame, seed: int = 42, train: float = 0.70, val: float = 0.15, group_col: str = "grp"
) -> DataFrame:
    """(image, grp, split): whole groups assigned in a seeded order; one group goes to test only."""
    groups = images.select(F.col(group_col).alias("grp")).distinct()
    n = F.count("*")
    want_train = F.greatest(F.lit(1), F.bround(n * F.lit(train), 0).cast("bigint"))
    n_train = F.least(want_train, n - 2)
    n_val = F.least(F.greatest(F.lit(1), F.bround(n * F.lit(val), 0).cast("bigint")), n - n_train - 1)
    # with fewer than two groups the train count is negative, which slices off the tail
    size = groups.agg(n.alias("n"), n_train.alias("a"), n_val.alias("b"))
    cut_a = size.select(F.when(F.col("a") >= 0, F.col("a")).otherwise(F.greatest(F.lit(0), F.col("n") + F.col("a")))).scalar()
    end = F.col("a") + F.col("b")
    cut_b = size.select(F.when(end >= 0, end).otherwise(F.greatest(F.lit(0), F.col("n") + end))).scalar()
    start_b = size.select(F.when(F.col("a") >= 0, F.col("a")).otherwise(F.greatest(F.lit(0), F.col("n") + F.col("a")))).scalar()
    ranked = seeded_rank(groups, F.col("grp"), seed, "rk", ["grp"])
    split = (
        F.when(F.col("rk") <= cut_a, F.lit("train"))
        .when((F.col("rk") > start_b) & (F.col("rk") <= cut_b), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    assigned = ranked.select("grp", split.alias("split"))
    return images.select("image", F.col(group_col).alias("grp")).join(assigned, "grp").select("image", "grp", "split")


def split_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(F.count("*").alias("n_images"), F.count_distinct("grp").alias("n_groups"))


def singleton_warning(images: DataFrame, group_col: str = "grp") -> DataFrame:
    """Are all groups single images, so that the key carries no sequence structure?"""
    sizes = images.groupBy(group_col).agg(F.count("*").alias("n"))
    single, total = F.count_if(F.col("n") == 1), F.count("*")
    return sizes.agg(
        total.alias("n_groups"), single.alias("n_single"), ((single == total) & (total > 1)).alias("all_single")
    )


# leakage -----------------------------------------------------------------------------


def last_rows(manifest: DataFrame) -> DataFrame:
    """A repeated image counts with its last row (``pos`` is the file order)."""
    return manifest.groupBy("image").agg(F.max(F.struct("pos", "grp", "split")).alias("m")).select("image", "m.grp", "m.split")


def leaking_groups(manifest: DataFrame) -> DataFrame:
    """Groups with rows in more than one split."""
    return (
        manifest.groupBy("grp")
        .agg(F.count_distinct("split").alias("n_splits"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"))
        .filter("n_splits > 1")
    )


def leakage_summary(manifest: DataFrame) -> DataFrame:
    leaks = leaking_groups(manifest)
    return manifest.agg(F.count_distinct("grp").alias("n_groups"), F.count_distinct("image").alias("n_images")).withColumn(
        "n_leaking", leaks.agg(F.count("*")).scalar()
    )


def cross_split_pairs(images: DataFrame) -> DataFrame:
    """Per leaking group: number of image pairs that straddle splits, and the first such pair.

    Counted from the split sizes; the pairs themselves are never formed. The first pair in
    name order joins the first names of the two splits whose first names come first.
    """
    per = images.groupBy("grp", "split").agg(F.count("*").alias("n"), F.min("image").alias("first"))
    n, sq = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    firsts = F.array_sort(F.collect_list("first"))
    return (
        per.groupBy("grp")
        .agg(((n * n - sq) / 2).cast("bigint").alias("n_pairs"), F.count("*").alias("k"), firsts.alias("f"))
        .filter("k > 1")
        .select("grp", "n_pairs", F.col("f")[0].alias("first_a"), F.col("f")[1].alias("first_b"))
    )


# labels ------------------------------------------------------------------------------


def class_name(raw_id: Column, id_map: dict[int, str]) -> Column:
    """Name of a numeric label through the id map, else the raw text."""
    out = raw_id
    for n, name in id_map.items():
        out = F.when(raw_id == str(n), F.lit(name)).otherwise(out)
    return out


def image_status(images: DataFrame, labels: DataFrame, id_map: dict[int, str]) -> DataFrame:
    """Adds n_boxes and state: no_label, empty_label, excluded_only or labelled.

    images: image, split, has_label; labels: image, raw_id.
    """
    excluded = class_name(F.col("raw_id"), id_map).isin(*EXCLUDED_CLASSES)
    per = labels.groupBy("image").agg(F.count("*").alias("n_boxes"), F.bool_and(excluded).alias("all_excluded"))
    j = images.join(per, "image", "left").withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)))
    state = (
        F.when(~F.col("has_label"), F.lit("no_label"))
        .when(F.col("n_boxes") == 0, F.lit("empty_label"))
        .when(F.col("all_excluded"), F.lit("excluded_only"))
        .otherwise(F.lit("labelled"))
    )
    return j.select("image", "split", "n_boxes", state.alias("state"))


def audit(status: DataFrame) -> DataFrame:
    def n(state: str) -> Column:
        return F.count_if(F.col("state") == state)

    return status.groupBy("split").agg(
        F.count("*").alias("total_images"),
        F.sum("n_boxes").alias("total_boxes"),
        n("excluded_only").alias("excluded_only"),
        n("empty_label").alias("empty_label"),
        n("no_label").alias("no_label"),
    )


def boxes_per_class(images: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(images.select("image", "split"), "image").groupBy("split", "raw_id").agg(F.count("*").alias("n"))


def listed_names(status: DataFrame, state: str, limit: int | None = None) -> DataFrame:
    """Names of a state per split as a report lists them; with ``limit`` the first ones and the size of the rest."""
    rows = status.filter(F.col("state") == state)
    totals = rows.groupBy("split").agg(F.count("*").alias("total"))
    w = Window.partitionBy("split").orderBy("image")
    top = rows.withColumn("pos", F.row_number().over(w).cast("bigint"))
    top = top if limit is None else top.filter(F.col("pos") <= limit)
    return top.join(totals, "split").select(
        "split", "pos", "image", (F.greatest(F.lit(0), F.col("total") - limit) if limit is not None else F.lit(0).cast("bigint")).alias("n_more")
    )


def three_class(labels: DataFrame, id_map: dict[int, str]) -> DataFrame:
    """Boxes of mapped classes with ``new_id`` and ``original_class``; all others are dropped."""
    name = class_name(F.col("raw_id"), id_map)
    new_id = F.lit(None).cast("bigint")
    for cls, n in THREE_CLASS.items():
        new_id = F.when(name == cls, F.lit(n).cast("bigint")).otherwise(new_id)
    return labels.withColumn("original_class", name).withColumn("new_id", new_id).filter(F.col("new_id").isNotNull())


def crack_origins(converted: DataFrame) -> DataFrame:
    return converted.filter("new_id = 0").select("image", "box_idx", "original_class")


def excluded_policy(status: DataFrame, policy: str, parity: bool = False) -> DataFrame:
    """Images that stay in the dataset. ``drop`` removes excluded-only images; with
    ``parity`` both policies keep every image (with an empty label file)."""
    if policy not in ("drop", "keep_as_background"):
        raise ValueError(f"unknown policy {policy!r}")
    kept = status.withColumn("background", F.col("state") != "labelled")
    return kept if parity or policy == "keep_as_background" else kept.filter("state <> 'excluded_only'")


def locate_files(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Manifest with image and label path: split folder first, then the flat one, then (images) the root.

    inventory: rel_path below the dataset root. Rows without an image are dropped.
    """
    stem = F.regexp_replace("image", r"(?<=.)\.[^.]*$", "")
    slots = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), path.alias("rel_path"))
            for kind, rank, path in (
                ("image", 0, F.concat("split", F.lit("/images/"), "image")),
                ("image", 1, F.concat(F.lit("images/"), "image")),
                ("image", 2, F.col("image")),
                ("label", 0, F.concat("split", F.lit("/labels/"), stem, F.lit(".txt"))),
                ("label", 1, F.concat(F.lit("labels/"), stem, F.lit(".txt"))),
            )
        ]
    )
    wanted = manifest.select("image", "split", F.explode(slots).alias("s")).select("image", "split", "s.*")
    found = wanted.join(inventory.select("rel_path").distinct(), "rel_path")

    def path(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.struct("rank", "rel_path")))["rel_path"]

    return (
        found.groupBy("image", "split")
        .agg(path("image").alias("image_path"), path("label").alias("label_path"))
        .filter(F.col("image_path").isNotNull())
    )


def orientation_crops(
    labels: DataFrame, origins: DataFrame, img_w: Column, img_h: Column, min_size: int = 10
) -> DataFrame:
    """Crop rows of train and val boxes of a known orientation that are large enough.

    labels: image, split, box_idx, raw_id, cx, cy, w, h; origins: image, box_idx, original_class.
    """
    px = boxes.pixel_box(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), img_w, img_h)
    cls = F.coalesce("original_class", "raw_id")
    label = F.lit(None).cast("string")
    for name, side in ORIENTATION.items():
        label = F.when(cls == name, F.lit(side)).otherwise(label)
    return (
        labels.filter(F.col("split").isin("train", "val"))
        .filter("cx is not null and cy is not null and w is not null and h is not null")
        .join(origins, ["image", "box_idx"], "left")
        .withColumn("label", label)
        .filter(F.col("label").isNotNull())
        .select("image", "split", "box_idx", "label", *[e.alias(n) for n, e in px.items()])
        .filter((F.col("x2") - F.col("x1") >= min_size) & (F.col("y2") - F.col("y1") >= min_size))
    )


def orientation_features(crops: DataFrame) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return crops.filter(h != 0).select(
        "image", "split", "box_idx", "label", (w / h).alias("aspect"), (w > h).cast("double").alias("is_wider")
    )


def logistic_fit(rows: DataFrame, inputs: Sequence[str], target: str, penalty: float = 1.0, steps: int = 50) -> list[float] | None:
    """Intercept and weights that minimise the summed log loss plus ``penalty`` / 2 times the squared weights.

    Newton's steps, that is weighted least squares: each is one aggregation of the gradient and of
    the upper half of the curvature, of a size fixed by ``inputs``. The intercept isn't penalised. None
    if ``rows`` are empty; where one class is alone, the steps end once its score is beyond doubt.
    """
    x = [F.lit(1.0), *[F.col(c) for c in inputs]]
    size = len(x)
    beta = np.zeros(size)
    ridge = np.diag([0.0] + [penalty] * len(inputs))
    for _ in range(steps):
        score = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        p = 1.0 / (1.0 + F.exp(-score))
        pulls = [F.sum((F.col(target) - p) * c) for c in x]
        bends = [F.sum(p * (1.0 - p) * x[a] * x[b]) for a in range(size) for b in range(a, size)]
        row = rows.agg(F.count("*"), *pulls, *bends).first()
        if not row[0]:
            return None
        curve = ridge.copy()
        values = iter(row[1 + size :])
        for a in range(size):
            for b in range(a, size):
                v = next(values)
                curve[a, b] += v
                if a != b:
                    curve[b, a] += v
        if np.linalg.cond(curve) > 1e14:
            break
        step = np.linalg.solve(curve, np.array(row[1 : 1 + size]) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10 or abs(beta[0]) > 30:
            break
    return [float(b) for b in beta]


def orientation_baseline(features: DataFrame, max_iter: int = 50) -> DataFrame:
    """Logistic regression on train crops, scored on val crops: one row per class.

    Columns: class, support, precision, recall, accuracy. An absent class has no scores.
    """
    y = F.when(F.col("label") == "transverse", F.lit(1.0)).otherwise(F.lit(0.0))
    ready = features.withColumn("y", y)
    beta = logistic_fit(ready.filter("split = 'train'"), ["aspect", "is_wider"], "y", steps=max_iter)
    if beta is None:
        return features.sparkSession.createDataFrame([], "class string, support bigint, precision double, recall double, accuracy double")
    score = F.lit(beta[0]) + F.lit(beta[1]) * F.col("aspect") + F.lit(beta[2]) * F.col("is_wider")
    scored = ready.filter("split = 'val'").select("y", F.when(score > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("prediction"))
    names = features.sparkSession.range(1).select(
        F.explode(F.array(F.struct(F.lit("longitudinal").alias("class"), F.lit(0.0).alias("id")), F.struct(F.lit("transverse").alias("class"), F.lit(1.0).alias("id")))).alias("c")
    ).select("c.*")
    counts = scored.groupBy("y", "prediction").agg(F.count("*").alias("n"))
    accuracy = counts.agg(F.sum(F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")).scalar()
    truth = counts.groupBy(F.col("y").alias("id")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp")
    )
    said = counts.groupBy(F.col("prediction").alias("id")).agg(F.sum("n").alias("said"))
    j = names.join(truth, "id", "left").join(said, "id", "left")
    has = F.coalesce("support", F.lit(0)) > 0
    return j.select(
        "class",
        F.coalesce("support", F.lit(0)).alias("support"),
        F.when(has, F.when(F.coalesce("said", F.lit(0)) > 0, F.col("tp") / F.col("said")).otherwise(0.0)).alias("precision"),
        F.when(has, F.col("tp") / F.col("support")).alias("recall"),
        accuracy.alias("accuracy"),
    )


# rating sheet ------------------------------------------------------------------------


def rating_sheet(crops: DataFrame, size: int = 100, seed: int = 42, id_col: str = "crop_id") -> DataFrame:
    """Stratified seeded sample of at most ``size`` crops: a third per severity, then a fill.

    Unknown severities count as Low. Only the first rows of each stratum leave their tasks.
    """
    target = max(1, size // 3)
    known = F.col("system_severity").isin("Low", "Medium", "High")
    pool = crops.withColumn("stratum", F.when(known, F.col("system_severity")).otherwise(F.lit("Low"))).withColumn(
        "_key", seeded_key(F.col(id_col).cast("string"), seed)
    )
    w = Window.partitionBy("stratum").orderBy("_key", id_col)
    # a stratum can give at most target + size rows: its share, and the whole fill
    top = pool.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= target + size)
    order = F.when(F.col("stratum") == "Low", 0).when(F.col("stratum") == "Medium", 1).otherwise(2)
    phase = F.when(F.col("_rk") <= target, order).otherwise(F.lit(3))
    sheet = top.withColumn("_phase", phase)
    line = F.row_number().over(Window.orderBy("_phase", "_key", id_col)).cast("bigint")
    return (
        sheet.withColumn("sheet_id", line)
        .filter(F.col("sheet_id") <= size)
        .select("sheet_id", id_col, "system_severity", (F.col("_phase") == 3).alias("is_fill"))
    )
