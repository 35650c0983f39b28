"""Queries over image sets: labels, splits, leakage, crops, detector output, hashes, media."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import boxes, text
from roadloom.operators import dataset, hashing, imaging, nearest
from roadloom.plans.fixtures import ID_MAP, view
from roadloom.plans.registry import cte, query, shared
from roadloom.plans.telemetry import deg
from roadloom.session import cut
from roadloom.sources import intake


@shared
def label_rows(spark, sf):
    return cut(view(spark, sf, "v_label_box"))


@shared
def images(spark, sf):
    """One row per image; the label rows are read for it once."""
    b = label_rows(spark, sf)
    return cut(b.groupBy("image").agg(
        F.min("leaky_split").alias("split"), F.bool_or(F.col("raw_id").isNotNull()).alias("has_label"), F.min("doc_id").alias("pos")
    ))


def labels(spark, sf):
    return label_rows(spark, sf).filter("raw_id is not null").select("image", "box_idx", "raw_id", "cx", "cy", "w", "h")


def grouped(spark, sf):
    return images(spark, sf).withColumn("grp", text.prefix_group(F.col("image")))


def manifest(spark, sf):
    return grouped(spark, sf).select("image", "grp", "split", "pos")


NAME = "CASE raw_id WHEN '0' THEN 'D00' WHEN '1' THEN 'D10' WHEN '2' THEN 'D20' WHEN '3' THEN 'D40' WHEN '4' THEN 'D44' WHEN '5' THEN 'D43' ELSE raw_id END"
cte("o_img", "SELECT image, min(leaky_split) AS split, bool_or(raw_id IS NOT NULL) AS has_label, split_part(image,'_',1) AS grp FROM v_label_box GROUP BY image")
cte("o_lab", f"SELECT image, leaky_split AS split, box_idx, raw_id, {NAME} AS name, cx, cy, w, h FROM v_label_box WHERE raw_id IS NOT NULL")
cte("o_stat", """SELECT i.image, i.split, coalesce(n,0) AS n_boxes, CASE WHEN NOT has_label THEN 'no_label' WHEN coalesce(n,0)=0 THEN 'empty_label' WHEN ex THEN 'excluded_only' ELSE 'labelled' END AS state
FROM o_img i LEFT JOIN (SELECT image, count(*) AS n, bool_and(name IN ('D44','D01','D43','D11','D50','D0w0')) AS ex FROM o_lab GROUP BY image) b USING (image)""")
cte("o_conv", "SELECT *, CAST(CASE name WHEN 'D00' THEN 0 WHEN 'D10' THEN 0 WHEN 'D20' THEN 1 ELSE 2 END AS BIGINT) AS new_id FROM o_lab WHERE name IN ('D00','D10','D20','D40')")
cte("o_crop", """SELECT * FROM (SELECT l.image, l.split, l.box_idx, CASE coalesce(o.name, l.raw_id) WHEN 'D00' THEN 'longitudinal' WHEN 'D10' THEN 'transverse' END AS label,
greatest(0,CAST(trunc((cx-w/2e0)*640) AS BIGINT)) AS x1, greatest(0,CAST(trunc((cy-h/2e0)*640) AS BIGINT)) AS y1, least(640,CAST(trunc((cx+w/2e0)*640) AS BIGINT)) AS x2, least(640,CAST(trunc((cy+h/2e0)*640) AS BIGINT)) AS y2
FROM o_lab l LEFT JOIN (SELECT image, box_idx, name FROM o_conv WHERE new_id=0) o USING (image, box_idx) WHERE l.split IN ('train','val')) WHERE label IS NOT NULL AND x2-x1>=10 AND y2-y1>=10""")


# labels ------------------------------------------------------------------------------


@query("f06_pixel_boxes", "SELECT image, box_idx, greatest(0,CAST(trunc((cx-w/2e0)*640) AS BIGINT)) AS x1, greatest(0,CAST(trunc((cy-h/2e0)*640) AS BIGINT)) AS y1, least(640,CAST(trunc((cx+w/2e0)*640) AS BIGINT)) AS x2, least(640,CAST(trunc((cy+h/2e0)*640) AS BIGINT)) AS y2 FROM o_lab")
def f06(spark, sf):
    px = boxes.pixel_box(*[F.col(c) for c in ("cx", "cy", "w", "h")], F.lit(640), F.lit(640))
    return labels(spark, sf).select("image", "box_idx", *[e.alias(n) for n, e in px.items()])


@query("f12_three_class", "SELECT image, box_idx, name AS original_class, new_id FROM o_conv")
def f12(spark, sf):
    return dataset.three_class(labels(spark, sf), ID_MAP).select("image", "box_idx", "original_class", "new_id")


@query("f12_crack_origins", "SELECT image, box_idx, name AS original_class FROM o_conv WHERE new_id=0")
def f12_origins(spark, sf):
    return dataset.crack_origins(dataset.three_class(labels(spark, sf), ID_MAP))


@query("f13_excluded_policy", "SELECT image, split, n_boxes, state, state<>'labelled' AS background FROM o_stat WHERE state<>'excluded_only'")
def f13(spark, sf):
    status = dataset.image_status(images(spark, sf), labels(spark, sf), ID_MAP)
    return dataset.excluded_policy(status, "drop")


@query("a16_dataset_audit", "SELECT split, count(*) AS total_images, CAST(sum(n_boxes) AS BIGINT) AS total_boxes, CAST(count_if(state='excluded_only') AS BIGINT) AS excluded_only, CAST(count_if(state='empty_label') AS BIGINT) AS empty_label, CAST(count_if(state='no_label') AS BIGINT) AS no_label FROM o_stat GROUP BY split")
def a16(spark, sf):
    return dataset.audit(dataset.image_status(images(spark, sf), labels(spark, sf), ID_MAP))


@query("a16_boxes_per_class", "SELECT split, raw_id, count(*) AS n FROM o_lab GROUP BY ALL")
def a16_boxes(spark, sf):
    return dataset.boxes_per_class(images(spark, sf), labels(spark, sf))


@query("t05_listed_names", "SELECT split, CAST(pos AS BIGINT) AS pos, image, CAST(0 AS BIGINT) AS n_more FROM (SELECT split, image, row_number() OVER (PARTITION BY split ORDER BY image) AS pos FROM o_stat WHERE state='labelled')")
def t05(spark, sf):
    return dataset.listed_names(dataset.image_status(images(spark, sf), labels(spark, sf), ID_MAP), "labelled")


@query("f17_orientation_crops", "SELECT * FROM o_crop")
def f17(spark, sf):
    boxes_ = labels(spark, sf).join(images(spark, sf).select("image", "split"), "image")
    origins = dataset.crack_origins(dataset.three_class(labels(spark, sf), ID_MAP))
    return dataset.orientation_crops(boxes_, origins, F.lit(640), F.lit(640))


@query("f18_orientation_features", "SELECT image, split, box_idx, label, round((x2-x1)/(y2-y1),6) AS aspect, CASE WHEN x2-x1>y2-y1 THEN 1e0 ELSE 0e0 END AS is_wider FROM o_crop")
def f18(spark, sf):
    return dataset.orientation_features(f17(spark, sf)).withColumn("aspect", deg("aspect"))


@query("a17_crop_counts", "SELECT split, CAST(count_if(label='longitudinal') AS BIGINT) AS longitudinal, CAST(count_if(label='transverse') AS BIGINT) AS transverse FROM o_crop GROUP BY split")
def a17(spark, sf):
    side = F.col("label")
    return f17(spark, sf).groupBy("split").agg(
        F.count_if(side == "longitudinal").alias("longitudinal"), F.count_if(side == "transverse").alias("transverse")
    )


# the model's steps written out: each a weighted least-squares solution by determinants
cte("o_ori", "SELECT split, (x2-x1)/CAST(y2-y1 AS DOUBLE) AS a, CASE WHEN x2-x1>y2-y1 THEN 1e0 ELSE 0e0 END AS w, CASE label WHEN 'transverse' THEN 1e0 ELSE 0e0 END AS y FROM o_crop")
cte("o_newton0", "SELECT 0e0 AS b0, 0e0 AS b1, 0e0 AS b2")
NEWTON = 14
for _k in range(NEWTON):
    cte(f"o_newton{_k + 1}", f"""SELECT b0+(g0*(h11*h22-h12*h12)-h01*(g1*h22-h12*g2)+h02*(g1*h12-h11*g2))/det AS b0, b1+(h00*(g1*h22-g2*h12)-g0*(h01*h22-h12*h02)+h02*(h01*g2-g1*h02))/det AS b1,
b2+(h00*(h11*g2-h12*g1)-h01*(h01*g2-g1*h02)+g0*(h01*h12-h11*h02))/det AS b2 FROM (SELECT *, h00*(h11*h22-h12*h12)-h01*(h01*h22-h12*h02)+h02*(h01*h12-h11*h02) AS det FROM (
SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(y-p) AS g0, sum((y-p)*a)-any_value(b1) AS g1, sum((y-p)*w)-any_value(b2) AS g2, sum(q) AS h00, sum(q*a) AS h01, sum(q*w) AS h02,
sum(q*a*a)+1e0 AS h11, sum(q*a*w) AS h12, sum(q*w*w)+1e0 AS h22 FROM (SELECT *, p*(1e0-p) AS q FROM (SELECT o.*, b.*, 1e0/(1e0+exp(-(b0+b1*a+b2*w))) AS p FROM o_ori o, o_newton{_k} b WHERE split='train'))))""")


@query("a20_orientation_baseline", f"""SELECT c.class, CAST(count_if(y=id) AS BIGINT) AS support, CASE WHEN count_if(y=id)>0 THEN CASE WHEN count_if(said=id)>0 THEN count_if(y=id AND said=id)/count_if(said=id) ELSE 0e0 END END AS precision,
CASE WHEN count_if(y=id)>0 THEN count_if(y=id AND said=id)/count_if(y=id) END AS recall, count_if(y=said)/count(*) AS accuracy
FROM (SELECT y, CASE WHEN b0+b1*a+b2*w>0 THEN 1e0 ELSE 0e0 END AS said FROM o_ori, o_newton{NEWTON} WHERE split='val'), (SELECT 'longitudinal' AS class, 0e0 AS id UNION ALL SELECT 'transverse', 1e0) c GROUP BY c.class""")
def a20(spark, sf):
    return dataset.orientation_baseline(cut(dataset.orientation_features(f17(spark, sf))))


@query("j12_locate_files", """SELECT image, split, CASE pos%4 WHEN 0 THEN split||'/images/'||image WHEN 1 THEN 'images/'||image ELSE image END AS image_path,
CASE pos%3 WHEN 0 THEN split||'/labels/'||stem||'.txt' WHEN 1 THEN 'labels/'||stem||'.txt' END AS label_path FROM (SELECT image, min(leaky_split) AS split, min(doc_id) AS pos, replace(image,'.jpg','') AS stem FROM v_label_box GROUP BY image) WHERE pos%4<>3""")
def j12(spark, sf):
    """The inventory holds each image in one of the layouts, or not at all, and copies lower in rank."""
    m = images(spark, sf)
    split, name, stem_ = F.col("split"), F.col("image"), text.stem(F.col("image"))
    flat_image, flat_label = F.concat(F.lit("images/"), name), F.concat(F.lit("labels/"), stem_, F.lit(".txt"))
    slot = F.col("pos") % 4
    files = F.array(
        F.when(slot == 0, F.concat(split, F.lit("/images/"), name)),
        F.when(slot <= 1, flat_image),
        F.when(slot <= 2, name),
        F.when(F.col("pos") % 3 == 0, F.concat(split, F.lit("/labels/"), stem_, F.lit(".txt"))),
        F.when(F.col("pos") % 3 <= 1, flat_label),
    )
    inventory = m.select(F.explode(files).alias("rel_path")).filter("rel_path is not null")
    return dataset.locate_files(m.select("image", "split"), inventory)


# groups, splits, leakage -------------------------------------------------------------


@query("g07_levenshtein", "SELECT image, CAST(levenshtein(image, first) AS BIGINT) AS edits FROM (SELECT image, min(image) OVER (PARTITION BY grp) AS first FROM o_img)")
def g07(spark, sf):
    g = grouped(spark, sf)
    first = g.groupBy("grp").agg(F.min("image").alias("first"))
    return g.join(first, "grp").select("image", F.levenshtein("image", "first").cast("bigint").alias("edits"))


@query("g09_prefix_group", "SELECT url, CASE WHEN instr(stem,'_')>0 THEN split_part(stem,'_',1) ELSE substr(stem,1,4) END AS grp FROM (SELECT url, CASE WHEN instr(name,'.')>1 THEN regexp_replace(name,'[.][^.]*$','') ELSE name END AS stem FROM (SELECT url, split_part(url,'/',-1) AS name FROM pages))")
def g09(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("url", text.prefix_group(F.col("url")).alias("grp"))


@query("g10_window_group", "SELECT image, CAST(CAST(regexp_extract(replace(image,'.jpg',''),'([0-9]+)$',1) AS BIGINT)//10 AS VARCHAR) AS grp FROM o_img")
def g10(spark, sf):
    return images(spark, sf).select("image", text.window_group(F.col("image")).alias("grp"))


@query("g12_file_names", "SELECT path, split_part(path,'/',-1) AS name, lower(regexp_extract(path,'([.][^./]*)$',1)) AS ext, regexp_replace(split_part(path,'/',-1),'[.][^.]*$','') AS stem FROM v_media")
def g12(spark, sf):
    p = F.col("path")
    return view(spark, sf, "v_media").select(
        "path", text.base_name(p).alias("name"), text.extension(p).alias("ext"), text.stem(p).alias("stem")
    )


cte("o_grp", "SELECT grp, row_number() OVER (ORDER BY md5('42:'||grp), grp) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(CAST(regexp_extract(replace(image,'.jpg',''),'([0-9]+)$',1) AS BIGINT)//10 AS VARCHAR) AS grp FROM o_img)")
cte("o_assign", """SELECT grp, CASE WHEN rk<=nt THEN 'train' WHEN rk<=nt+least(nv,n-nt-1) THEN 'val' ELSE 'test' END AS split FROM
(SELECT *, least(greatest(1,CAST(round_even(7e-1*n,0) AS BIGINT)), n-2) AS nt, greatest(1,CAST(round_even(15e-2*n,0) AS BIGINT)) AS nv FROM o_grp)""")
cte("o_manifest", "SELECT image, g.grp, a.split FROM (SELECT image, CAST(CAST(regexp_extract(replace(image,'.jpg',''),'([0-9]+)$',1) AS BIGINT)//10 AS VARCHAR) AS grp FROM o_img) g JOIN o_assign a USING (grp)")


@shared
def split_manifest(spark, sf):
    i = images(spark, sf).select("image", text.window_group(F.col("image")).alias("grp"))
    return cut(dataset.grouped_split(i, 42))


@query("w06_grouped_split", "SELECT * FROM o_manifest")
def w06(spark, sf):
    i = images(spark, sf).select("image", text.window_group(F.col("image")).alias("grp"))
    return dataset.grouped_split(i, 42)


@query("t06_manifest_order", "SELECT image, grp, split FROM o_manifest ORDER BY image")
def t06(spark, sf):
    return split_manifest(spark, sf).orderBy("image")


@query("a17_split_counts", "SELECT split, count(*) AS n_images, count(DISTINCT grp) AS n_groups FROM o_manifest GROUP BY split")
def a17_split(spark, sf):
    return dataset.split_counts(split_manifest(spark, sf))


@query("a21_leaking_groups", "SELECT grp, count(DISTINCT split) AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM o_img GROUP BY grp HAVING count(DISTINCT split)>1")
def a21(spark, sf):
    return dataset.leaking_groups(manifest(spark, sf))


@query("a21_leakage_summary", "SELECT count(DISTINCT grp) AS n_groups, count(DISTINCT image) AS n_images, CAST(0 AS BIGINT) AS n_leaking FROM o_manifest")
def a21_summary(spark, sf):
    return dataset.leakage_summary(split_manifest(spark, sf))


@query("a22_singleton_groups", "SELECT count(*) AS n_groups, CAST(count_if(n=1) AS BIGINT) AS n_single, count_if(n=1)=count(*) AND count(*)>1 AS all_single FROM (SELECT grp, count(*) AS n FROM o_img GROUP BY grp)")
def a22(spark, sf):
    return dataset.singleton_warning(grouped(spark, sf))


cte("o_cross", "SELECT a.grp, a.image AS a, b.image AS b FROM o_img a JOIN o_img b ON a.grp=b.grp AND a.image<b.image AND a.split<>b.split")


@query("j16_cross_split_pairs", "SELECT grp, count(*) AS n_pairs, min(a) AS first_a, arg_min(b, (a, b)) AS first_b FROM o_cross GROUP BY grp")
def j16(spark, sf):
    return dataset.cross_split_pairs(manifest(spark, sf))


@query("t04_nearest_cross_split", "SELECT a, b, CAST(levenshtein(a,b) AS BIGINT) AS edit_distance FROM o_cross ORDER BY levenshtein(a,b), a, b LIMIT 1")
def t04(spark, sf):
    return nearest.nearest_names(dataset.last_rows(manifest(spark, sf)))


@query("u03_remainder", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u03(spark, sf):
    d, l = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return d.select("doc_id").join(l.select("doc_id"), "doc_id", "left_anti")


# detector output ---------------------------------------------------------------------


def raw_predictions(spark, sf):
    return view(spark, sf, "v_raw_pred").withColumn("scores", F.array("s1", "s2", "s3", "s4"))


cte("o_dec", """SELECT image_id, pos, CASE WHEN s1>=s2 AND s1>=s3 AND s1>=s4 THEN 'D00' WHEN s2>=s3 AND s2>=s4 THEN 'D10' WHEN s3>=s4 THEN 'D20' ELSE 'D40' END AS class_name, greatest(s1,s2,s3,s4) AS score,
cx-w/2e0 AS x1, cy-h/2e0 AS y1, cx+w/2e0 AS x2, cy+h/2e0 AS y2 FROM v_raw_pred WHERE greatest(s1,s2,s3,s4)>25e-2""")
IOU = """(greatest(0e0,least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0e0,least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"""
SIZE = "(({a}.x2-{a}.x1)*({a}.y2-{a}.y1))"


def iou_sql(a: str, b: str, floor: str = "0e0") -> str:
    i = IOU.format(a=a, b=b)
    return f"({i}/greatest({floor}, {SIZE.format(a=a)}+{SIZE.format(a=b)}-{i}))"


cte("o_order", "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pos) AS rk FROM o_dec")
cte("o_beat", f"SELECT b.image_id, b.rk, list(a.rk) AS beaten_by FROM o_order a JOIN o_order b ON a.image_id=b.image_id AND a.rk<b.rk AND {iou_sql('a', 'b')}>45e-2 GROUP BY ALL")
cte("o_nms", """SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept FROM o_order
UNION ALL SELECT w.image_id, o.rk, CASE WHEN b.rk IS NULL OR NOT list_has_any(b.beaten_by, w.kept) THEN list_append(w.kept, o.rk) ELSE w.kept END
FROM o_nms w JOIN o_order o ON o.image_id=w.image_id AND o.rk=w.rk+1 LEFT JOIN o_beat b ON b.image_id=o.image_id AND b.rk=o.rk""", recursive=True)
cte("o_kept", "SELECT o.* FROM o_order o JOIN o_nms n ON n.image_id=o.image_id AND n.rk=o.rk AND list_contains(n.kept, o.rk)")


@query("f04_corner_boxes", "SELECT image_id, pos, round(cx-w/2e0,4) AS x1, round(cy-h/2e0,4) AS y1, round(cx+w/2e0,4) AS x2, round(cy+h/2e0,4) AS y2 FROM v_raw_pred")
def f04(spark, sf):
    c = boxes.corners(*[F.col(x) for x in ("cx", "cy", "w", "h")])
    return raw_predictions(spark, sf).select("image_id", "pos", *[F.round(c[x], 4).alias(x) for x in c])


@query("f05_decode_predictions", "SELECT image_id, pos, class_name, round(score,6) AS score, round(x1,4) AS x1, round(y1,4) AS y1 FROM o_dec")
def f05(spark, sf):
    return imaging.decode(raw_predictions(spark, sf)).select(
        "image_id", "pos", "class_name", deg("score"), F.round("x1", 4).alias("x1"), F.round("y1", 4).alias("y1")
    )


@query("g06_iou", f"SELECT a.image_id, a.pos, round({iou_sql('a', 'b', '1e0')},6) AS iou FROM o_dec a JOIN (SELECT image_id, min(pos) AS p FROM o_dec GROUP BY 1) f ON f.image_id=a.image_id JOIN o_dec b ON b.image_id=a.image_id AND b.pos=f.p")
def g06(spark, sf):
    d = imaging.decode(raw_predictions(spark, sf))
    first = d.groupBy("image_id").agg(F.min(F.struct("pos", "x1", "y1", "x2", "y2")).alias("f"))
    j = d.join(first, "image_id")
    a = {c: F.col(c) for c in imaging.BOX}
    b = {c: F.col(f"f.{c}") for c in imaging.BOX}
    return j.select("image_id", "pos", F.round(boxes.iou(a, b), 6).alias("iou"))


@query("c03_suppression", "SELECT image_id, pos, class_name, round(score,6) AS score FROM o_kept")
def c03(spark, sf):
    kept = imaging.suppress(imaging.decode(raw_predictions(spark, sf)))
    return kept.select("image_id", "pos", "class_name", deg("score"))


FACE = "((x2-x1)*(y2-y1)/409600e0 BETWEEN 5e-3 AND 4e-1 AND (y2-y1)/greatest(1e0,x2-x1) BETWEEN 8e-1 AND 22e-1)"
PLATE = "((x2-x1)*(y2-y1)/409600e0 BETWEEN 2e-3 AND 25e-2 AND (x2-x1)/greatest(1e0,y2-y1) BETWEEN 18e-1 AND 55e-1)"
cte("o_region", f"SELECT image_id, pos, x1, y1, x2, y2, 'face' AS kind FROM o_dec WHERE {FACE} UNION ALL SELECT image_id, pos, x1, y1, x2, y2, 'license_plate' FROM o_dec WHERE {PLATE}")
cte("o_truth_box", "SELECT image_id, pos, CASE WHEN pos%3=0 THEN 'license_plate' ELSE 'face' END AS kind, cx-w*4e-1 AS x1, cy-h*4e-1 AS y1, cx+w*4e-1 AS x2, cy+h*4e-1 AS y2 FROM v_raw_pred")


@query("f15_sensitive_regions", "SELECT image_id, pos, kind FROM o_region")
def f15(spark, sf):
    return imaging.sensitive_candidates(imaging.decode(raw_predictions(spark, sf)), 640, 640).select("image_id", "pos", "kind")


@query("f16_redaction_plan", """SELECT image_id, pos, kind, px1, py1, px2, py2, greatest(15, ((px2-px1)//3)*2+1, ((py2-py1)//3)*2+1) AS ksize FROM (
SELECT *, greatest(px1+1, least(640, CAST(trunc(x2) AS BIGINT))) AS px2, greatest(py1+1, least(640, CAST(trunc(y2) AS BIGINT))) AS py2 FROM (
SELECT *, greatest(0, least(639, CAST(trunc(x1) AS BIGINT))) AS px1, greatest(0, least(639, CAST(trunc(y1) AS BIGINT))) AS py1 FROM o_region))""")
def f16(spark, sf):
    r = imaging.sensitive_candidates(imaging.decode(raw_predictions(spark, sf)), 640, 640)
    size = F.lit(640).cast("bigint")
    plan = boxes.blur_plan(*[F.col(c) for c in imaging.BOX], size, size)
    return r.select("image_id", "pos", "kind", *[e.alias(n) for n, e in plan.items()])


@query("j14_region_recall", f"""SELECT kind, count(*) AS total, CAST(count_if(hit) AS BIGINT) AS matched, round(count_if(hit)/count(*),6) AS recall FROM (
SELECT l.kind, EXISTS (SELECT 1 FROM o_region r WHERE r.image_id=l.image_id AND r.kind=l.kind AND {iou_sql('l', 'r', '1e0')}>=3e-1) AS hit FROM o_truth_box l) GROUP BY kind""")
def j14(spark, sf):
    raw = raw_predictions(spark, sf)
    kind = F.when(F.col("pos") % 3 == 0, F.lit("license_plate")).otherwise(F.lit("face"))
    truth = raw.select(
        "image_id", "pos", kind.alias("kind"), (F.col("cx") - F.col("w") * 0.4).alias("x1"), (F.col("cy") - F.col("h") * 0.4).alias("y1"),
        (F.col("cx") + F.col("w") * 0.4).alias("x2"), (F.col("cy") + F.col("h") * 0.4).alias("y2"),
    )
    regions = imaging.sensitive_candidates(imaging.decode(raw), 640, 640)
    return imaging.region_recall(truth, regions).withColumn("recall", deg("recall"))


# hashes ------------------------------------------------------------------------------

# the sign bits of all 64 values; the last one is the sign of the number
BIT = {n + 1: f"{1 << n}" if n < 63 else f"({-(1 << 63) + 1}-1)" for n in range(64)}
HASH_SQL = "+".join(f"CASE WHEN embedding[{n}]>0 THEN CAST({b} AS HUGEINT) ELSE 0 END" for n, b in BIT.items())
cte("o_hash", f"SELECT vec_id, 'img_'||lpad(CAST(vec_id AS VARCHAR),6,'0')||'.jpg' AS image, CAST({HASH_SQL} AS BIGINT) AS hash FROM embeddings")
CLOSE = "bit_count(xor(a.hash,b.hash))<=18"  # at the default of 10 no two vectors of the tables link
cte("o_near", f"SELECT a.hash AS a, b.hash AS b FROM (SELECT DISTINCT hash FROM o_hash) a JOIN (SELECT DISTINCT hash FROM o_hash) b ON a.hash<>b.hash AND {CLOSE}")
cte("o_hreach", "SELECT DISTINCT hash AS node, hash AS root FROM o_hash UNION SELECT n.b, r.root FROM o_hreach r JOIN o_near n ON n.a=r.node", recursive=True)


@shared
def hashes(spark, sf):
    """Sign bits of the embedding as a hash, one image per vector."""
    bits = " + ".join(f"CASE WHEN embedding[{n - 1}] > 0 THEN {b.replace('-1)', 'L-1L)') if b[0] == '(' else b + 'L'} ELSE 0L END" for n, b in BIT.items())
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return cut(e.selectExpr("vec_id", "concat('img_', lpad(cast(vec_id as string), 6, '0'), '.jpg') AS image", f"{bits} AS hash"))


@query("g08_hamming", "SELECT vec_id, CAST(bit_count(xor(hash, (SELECT min(hash) FROM o_hash))) AS BIGINT) AS bits FROM o_hash")
def g08(spark, sf):
    h = hashes(spark, sf)
    return h.select("vec_id", hashing.hamming(F.col("hash"), h.agg(F.min("hash")).scalar()).alias("bits"))


@query("j15_similar_hashes", "SELECT a, b FROM o_near WHERE a<b")
def j15(spark, sf):
    return hashing.similar_pairs(hashes(spark, sf), 18)


@query("c02_hash_groups", "SELECT h.image, min(f.image) AS grp FROM o_hash h JOIN (SELECT node, min(root) AS comp FROM o_hreach GROUP BY node) c ON c.node=h.hash JOIN (SELECT node, min(root) AS comp FROM o_hreach GROUP BY node) k ON k.comp=c.comp JOIN o_hash f ON f.hash=k.node GROUP BY h.image")
def c02(spark, sf):
    return hashing.hash_groups(hashes(spark, sf), 18).select("image", "grp")


cte("o_hashed", "SELECT i.grp, i.image, i.split, h.hash FROM o_img i JOIN (SELECT DISTINCT image, doc_id FROM v_label_box) d ON d.image=i.image JOIN o_hash h ON h.vec_id=d.doc_id")


@query("t04_nearest_hash", """SELECT a.image AS a, b.image AS b, CAST(bit_count(xor(a.hash,b.hash)) AS BIGINT) AS distance FROM o_hashed a JOIN o_hashed b ON a.grp=b.grp AND a.split<>b.split AND a.image<b.image
ORDER BY distance, a, b LIMIT 1""")
def t04_hash(spark, sf):
    """Image n has the hash of vector n; images beyond the vectors have none."""
    of_image = view(spark, sf, "v_label_box").select("image", F.col("doc_id").alias("vec_id")).distinct()
    found = dataset.last_rows(manifest(spark, sf)).join(of_image, "image").join(hashes(spark, sf).select("vec_id", "hash"), "vec_id", "left")
    return nearest.nearest_hashes(found)


# media and sheets --------------------------------------------------------------------

NOW = "2024-01-31 00:00:00"
MEDIA = "lower(regexp_extract(path,'([.][^./]*)$',1)) IN ('.jpg','.jpeg','.png','.mp4','.avi','.mkv','.webp')"


@query("s15_purge_plan", f"SELECT path, epoch_us(TIMESTAMP '{NOW}')-epoch_us(mtime)>2592000000000 AS purge FROM v_media WHERE {MEDIA}")
def s15(spark, sf):
    m = view(spark, sf, "v_media").withColumn("mtime", F.col("mtime").cast("timestamp"))
    return intake.purge_plan(m, F.lit(NOW).cast("timestamp")).select("path", "purge")


@query("s15_purge_counts", f"SELECT count(*) AS scanned, CAST(count_if(old) AS BIGINT) AS purged, CAST(count_if(NOT old) AS BIGINT) AS retained FROM (SELECT epoch_us(TIMESTAMP '{NOW}')-epoch_us(mtime)>2592000000000 AS old FROM v_media WHERE {MEDIA})")
def s15_counts(spark, sf):
    m = view(spark, sf, "v_media").withColumn("mtime", F.col("mtime").cast("timestamp"))
    return intake.purge_counts(intake.purge_plan(m, F.lit(NOW).cast("timestamp")))


@query("s14_upload_checks", """SELECT path, length, concat_ws(',', CASE WHEN ext NOT IN ('.mp4','.avi','.mkv','.csv','.gpx') THEN 'extension' END, CASE WHEN length>52428800 THEN 'size' END,
CASE WHEN ext IN ('.mp4','.avi','.mkv') AND starts_with(body,'MZ') THEN 'executable' END, CASE WHEN ext IN ('.csv','.gpx') AND NOT contains(substr(body,1,64),'xml') AND NOT contains(substr(body,1,64),',') THEN 'gps_content' END) AS reasons FROM (
SELECT path, lower(regexp_extract(path,'([.][^./]*)$',1)) AS ext, event_id*9000 AS length, body FROM (
SELECT event_id, CASE event_id%3 WHEN 0 THEN replace(path,'.png','.csv') WHEN 1 THEN replace(path,'.JPG','.GPX') ELSE path END AS path, CASE event_id%5 WHEN 0 THEN 'MZ' WHEN 1 THEN '<?xml' WHEN 2 THEN 'time,lat' ELSE 'plain' END||props AS body FROM (SELECT m.event_id, m.path, replace(replace(e.props,',',';'),'xml','') AS props FROM v_media m JOIN events e ON e.event_id=m.event_id)))""")
def s14(spark, sf):
    m = view(spark, sf, "v_media")
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props")
    n = F.col("event_id")
    path = F.when(n % 3 == 0, F.replace("path", F.lit(".png"), F.lit(".csv"))).when(
        n % 3 == 1, F.replace("path", F.lit(".JPG"), F.lit(".GPX"))
    ).otherwise(F.col("path"))
    lead = F.when(n % 5 == 0, "MZ").when(n % 5 == 1, "<?xml").when(n % 5 == 2, "time,lat").otherwise("plain")
    body = F.concat(lead, F.replace(F.replace("props", F.lit(","), F.lit(";")), F.lit("xml"), F.lit("")))
    files = m.join(e, "event_id").select(path.alias("path"), (n * 9000).alias("length"), body.cast("binary").alias("content"))
    return intake.check_uploads(files).withColumn("reasons", F.array_join("reasons", ","))


@query("f14_truth_validation", """SELECT row_no, concat_ws(',', CASE WHEN id IS NULL THEN 'id_not_integer' WHEN id<=0 THEN 'id_not_positive' WHEN row_no>min(row_no) OVER (PARTITION BY id) THEN 'id_duplicate' END, CASE WHEN class_name<>'pothole' THEN 'class_unknown' END,
CASE WHEN la IS NULL THEN 'lat_not_number' WHEN la NOT BETWEEN -90 AND 90 THEN 'lat_range' END, CASE WHEN lo IS NULL THEN 'lon_not_number' WHEN lo NOT BETWEEN -180 AND 180 THEN 'lon_range' END) AS errors
FROM (SELECT *, TRY_CAST(defect_id AS BIGINT) AS id, TRY_CAST(lat AS DOUBLE) AS la, TRY_CAST(lon AS DOUBLE) AS lo FROM v_truth_raw)""")
def f14(spark, sf):
    checked = intake.validate_ground_truth(view(spark, sf, "v_truth_raw"), ["pothole"])
    return checked.select("row_no", F.array_join("errors", ",").alias("errors"))
