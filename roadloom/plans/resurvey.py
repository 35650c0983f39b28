"""Queries over re-surveys and scores: matching, verification, agreement, tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.config import STATUSES
from roadloom.functions import text
from roadloom.operators import dataset, matching, metrics, spatial, verification
from roadloom.operators.ranking import blocked_rank
from roadloom.operators.temporal import route_length_km
from roadloom.plans import roads  # noqa: F401  (its oracle definitions)
from roadloom.plans.fixtures import view
from roadloom.plans.process import verify_in_store
from roadloom.plans.registry import cte, hav, query, shared
from roadloom.plans.telemetry import CFG, chain, deg, defects, met
from roadloom.session import cut, landing_path
from roadloom.sources.store import SurveyStore

RATERS = ["rater_1", "rater_2", "rater_3"]


@shared
def old_matches(spark, sf):
    return cut(matching.greedy_match(view(spark, sf, "v_old"), view(spark, sf, "v_new"), CFG.match_radius_m))


@shared
def prediction_matches(spark, sf):
    return cut(matching.greedy_match(view(spark, sf, "v_new"), view(spark, sf, "v_old"), CFG.match_radius_m))


@shared
def covered(spark, sf):
    return cut(verification.covered_by(view(spark, sf, "v_old"), view(spark, sf, "v_path"), CFG))


@shared
def outcome(spark, sf):
    return cut(
        verification.transitions(
            view(spark, sf, "v_old"), view(spark, sf, "v_new"), old_matches(spark, sf), covered(spark, sf).select("defect_id", "covered")
        )
    )


cte("o_cand", f"""SELECT o.defect_id AS o_id, n.defect_id AS n_id, (o.defect_id-1)//3 AS g, o.class_name, round({hav('o.lat', 'o.lon', 'n.lat', 'n.lon')},6) AS d
FROM v_old o JOIN v_new n ON o.class_name=n.class_name AND abs(o.lat-n.lat)<1e-4 AND abs(o.lon-n.lon)<2e-4 AND {hav('o.lat', 'o.lon', 'n.lat', 'n.lon')}<=10.0000005e0""")
cte("o_pair", "SELECT * FROM o_cand WHERE d<=1e1")


def walk_ctes(name: str, order: str, source: str = "o_pair") -> None:
    cte(f"{name}_rank", f"SELECT *, row_number() OVER (PARTITION BY g ORDER BY {order}) AS rk FROM {source}")
    free = "NOT list_contains(w.os,p.o_id) AND NOT list_contains(w.ns,p.n_id)"
    cte(f"{name}_walk", f"""SELECT DISTINCT g, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS os, CAST([] AS BIGINT[]) AS ns, CAST(NULL AS BIGINT) AS o_id, CAST(NULL AS BIGINT) AS n_id, CAST(NULL AS DOUBLE) AS d FROM {name}_rank
UNION ALL SELECT w.g, p.rk, CASE WHEN {free} THEN list_append(w.os, p.o_id) ELSE w.os END, CASE WHEN {free} THEN list_append(w.ns, p.n_id) ELSE w.ns END,
CASE WHEN {free} THEN p.o_id END, CASE WHEN {free} THEN p.n_id END, p.d FROM {name}_walk w JOIN {name}_rank p ON p.g=w.g AND p.rk=w.rk+1""", recursive=True)
    cte(f"{name}_match", f"SELECT o_id, n_id, d, g FROM {name}_walk WHERE o_id IS NOT NULL")


walk_ctes("o_g", "d, o_id, n_id")
walk_ctes("o_p", "d, n_id, o_id")
cte("o_covered", f"SELECT defect_id, EXISTS (SELECT 1 FROM v_path p WHERE abs(p.lat-o.lat)<2e-4 AND {hav('o.lat', 'o.lon', 'p.lat', 'p.lon')}<=15e0) AS covered FROM v_old o")
cte("o_outcome", """SELECT 'old' AS side, o.defect_id, o.class_name, CASE WHEN m.o_id IS NOT NULL THEN CASE WHEN status='Repaired' THEN 'Failed' ELSE 'Open' END WHEN covered THEN 'Repaired' ELSE status END AS status,
m.o_id IS NOT NULL AND status='Repaired' AS recurrence, m.o_id IS NULL AND NOT covered AS unverified, CAST(NULL AS BIGINT) AS matched_prev_id
FROM v_old o LEFT JOIN o_g_match m ON m.o_id=o.defect_id JOIN o_covered c ON c.defect_id=o.defect_id
UNION ALL SELECT 'new', n.defect_id, n.class_name, CASE WHEN m.o_id IS NULL THEN 'New' WHEN o.status='Repaired' THEN 'Failed' ELSE 'Open' END, coalesce(o.status='Repaired',false), false, m.o_id
FROM v_new n LEFT JOIN o_g_match m ON m.n_id=n.defect_id LEFT JOIN v_old o ON o.defect_id=m.o_id""")


# the same for twenty pairs of surveys; g names pair and place
cte("o_many_cand", f"""SELECT o.defect_id AS o_id, n.defect_id AS n_id, o.pair_id*1000000+(o.defect_id-1)//3 AS g, round({hav('o.lat', 'o.lon', 'n.lat', 'n.lon')},6) AS d
FROM v_pair_old o JOIN v_pair_new n ON o.pair_id=n.pair_id AND o.class_name=n.class_name AND abs(o.lat-n.lat)<1e-4 AND abs(o.lon-n.lon)<2e-4""")
cte("o_many_pair", "SELECT * FROM o_many_cand WHERE d<=1e1")
walk_ctes("o_m", "d, o_id, n_id", "o_many_pair")
cte("o_many_match", "SELECT g//1000000 AS pair_id, o_id, n_id FROM o_m_match")
cte("o_many_covered", f"SELECT pair_id, defect_id, EXISTS (SELECT 1 FROM v_pair_path p WHERE p.pair_id=o.pair_id AND abs(p.lat-o.lat)<2e-4 AND {hav('o.lat', 'o.lon', 'p.lat', 'p.lon')}<=15e0) AS covered FROM v_pair_old o")


cte("o_pair_outcome", """SELECT o.pair_id, 'old' AS side, o.defect_id, o.class_name, CASE WHEN m.o_id IS NOT NULL THEN CASE WHEN status='Repaired' THEN 'Failed' ELSE 'Open' END WHEN covered THEN 'Repaired' ELSE status END AS status,
m.o_id IS NOT NULL AND status='Repaired' AS recurrence, m.o_id IS NULL AND NOT covered AS unverified, CAST(NULL AS BIGINT) AS matched_prev_id
FROM v_pair_old o LEFT JOIN o_many_match m ON m.o_id=o.defect_id AND m.pair_id=o.pair_id JOIN o_many_covered c ON c.defect_id=o.defect_id AND c.pair_id=o.pair_id
UNION ALL SELECT n.pair_id, 'new', n.defect_id, n.class_name, CASE WHEN m.o_id IS NULL THEN 'New' WHEN o.status='Repaired' THEN 'Failed' ELSE 'Open' END, coalesce(o.status='Repaired',false), false, m.o_id
FROM v_pair_new n LEFT JOIN o_many_match m ON m.n_id=n.defect_id AND m.pair_id=n.pair_id LEFT JOIN v_pair_old o ON o.defect_id=m.o_id AND o.pair_id=m.pair_id""")


@query("q04_verify_pairs", "SELECT * FROM o_pair_outcome")
def q04_pairs(spark, sf):
    """Twenty re-surveys in one job; their defects share ids and places."""
    old, new, path = (view(spark, sf, f"v_pair_{side}") for side in ("old", "new", "path"))
    return verification.verify(old, new, path, CFG, ["pair_id"])


cte("o_wb", "SELECT *, CAST(row_number() OVER (ORDER BY survey_id, defect_id) AS BIGINT) AS stored_id FROM (SELECT pair_id*2 AS survey_id, defect_id FROM v_pair_old UNION ALL SELECT pair_id*2+1, defect_id FROM v_pair_new)")


@query("q04_write_back", """SELECT w.survey_id, w.stored_id AS defect_id, v.class_name, v.status, v.recurrence, v.unverified, p.stored_id AS matched_prev_id FROM o_pair_outcome v
JOIN o_wb w ON w.survey_id=v.pair_id*2+CASE side WHEN 'new' THEN 1 ELSE 0 END AND w.defect_id=v.defect_id LEFT JOIN o_wb p ON p.survey_id=v.pair_id*2 AND p.defect_id=v.matched_prev_id""")
def q04_write_back(spark, sf):
    """Twenty stored surveys and their re-surveys: verified in the store, which is then read again."""
    old, new, path = (view(spark, sf, f"v_pair_{side}") for side in ("old", "new", "path"))
    blank = {c: F.lit(0.0) for c in ("area_px", "confidence", "x1", "y1", "x2", "y2")} | {"severity": F.lit("Low")}
    rows = old.withColumn("survey_id", F.col("pair_id") * 2).drop("pair_id").unionByName(
        new.select((F.col("pair_id") * 2 + 1).alias("survey_id"), "defect_id", "class_name", "lat", "lon", F.lit("New").alias("status"))
    )
    store = SurveyStore(spark, landing_path(spark, "store"))
    store.add_defects(rows.withColumns(blank))
    known = blocked_rank(rows, [], "defect_id", "stored", lead=[("survey_id", True)]).filter("status <> 'New'")
    store.update_defects(known.select("survey_id", F.col("stored").alias("defect_id"), "status", F.lit(None).cast("bigint").alias("matched_prev_id"), F.lit(False).alias("recurrence"), F.lit(False).alias("unverified")))
    pairs = old.select((F.col("pair_id") * 2).alias("old_survey"), (F.col("pair_id") * 2 + 1).alias("new_survey")).distinct()
    verify_in_store(store, pairs, path.withColumn("survey_id", F.col("pair_id") * 2 + 1), CFG)
    return store.read("defects").select(
        F.col("survey_id").cast("bigint").alias("survey_id"), "defect_id", "class_name", "status", "recurrence", "unverified", "matched_prev_id"
    )


@query("j06_coverage", "SELECT defect_id, covered FROM o_covered")
def j06(spark, sf):
    return verification.covered_by(view(spark, sf, "v_old"), view(spark, sf, "v_path"), CFG).select("defect_id", "covered")


@query("j07_candidates", "SELECT o_id AS defect_id, count(*) AS n_candidates, round(min(d),4) AS nearest_m FROM o_pair GROUP BY 1")
def j07(spark, sf):
    """Candidates per old defect; copies at one place are counted, not listed."""
    old, new = view(spark, sf, "v_old"), view(spark, sf, "v_new")
    keys = ["class_name"]
    o, n = matching._sites(old, keys), matching._sites(new, keys)
    per = (
        spatial.site_pairs(o, n, CFG.match_radius_m, keys)
        .join(n.select(F.col("site").alias("r_site"), "n"), "r_site")
        .groupBy(F.col("l_site").alias("site"))
        .agg(F.sum("n").alias("n_candidates"), F.min("d").alias("nearest_m"))
    )
    at = old.join(o.select(*keys, "lat", "lon", "site"), [*keys, "lat", "lon"])
    return at.join(per, "site").select("defect_id", "n_candidates", met("nearest_m"))


@query("j08_greedy_match", "SELECT o_id AS l_id, n_id AS r_id, round(d,4) AS d FROM o_g_match")
def j08(spark, sf):
    return matching.greedy_match(view(spark, sf, "v_old"), view(spark, sf, "v_new"), CFG.match_radius_m).select(
        "l_id", "r_id", met("d")
    )


@query("j09_status_transition", "SELECT * FROM o_outcome")
def j09(spark, sf):
    return verification.transitions(
        view(spark, sf, "v_old"), view(spark, sf, "v_new"), old_matches(spark, sf), covered(spark, sf).select("defect_id", "covered")
    )


@query("q04_verify_survey", "SELECT side, status, count(*) AS n, CAST(count_if(recurrence) AS BIGINT) AS n_recurrent, CAST(count_if(unverified) AS BIGINT) AS n_unverified FROM o_outcome GROUP BY ALL")
def q04(spark, sf):
    out = verification.verify(view(spark, sf, "v_old"), view(spark, sf, "v_new"), view(spark, sf, "v_path"), CFG)
    return out.groupBy("side", "status").agg(
        F.count("*").alias("n"), F.count_if("recurrence").alias("n_recurrent"), F.count_if("unverified").alias("n_unverified")
    )


@query("j10_truth_match", "SELECT n_id AS prediction_id, o_id AS truth_id, round(d,4) AS d FROM o_p_match")
def j10(spark, sf):
    m = matching.greedy_match(view(spark, sf, "v_new"), view(spark, sf, "v_old"), CFG.match_radius_m)
    return m.select(F.col("l_id").alias("prediction_id"), F.col("r_id").alias("truth_id"), met("d"))


@query("u01_class_universe", "SELECT class_name FROM v_new UNION SELECT class_name FROM v_old")
def u01(spark, sf):
    return metrics.class_universe(view(spark, sf, "v_new"), view(spark, sf, "v_old"))


cte("o_per", """SELECT coalesce(class_name,'overall') AS class_name, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS p, CAST(sum(t) AS BIGINT) AS t FROM (
SELECT class_name, count(m.n_id) AS tp, count(*) AS p, 0 AS t FROM v_new n LEFT JOIN o_p_match m ON m.n_id=n.defect_id GROUP BY class_name
UNION ALL SELECT class_name, 0, 0, count(*) FROM v_old GROUP BY class_name) GROUP BY ROLLUP (class_name)""")


@query("a06_detection_scores", "SELECT class_name, tp, p-tp AS fp, t-tp AS fn, round(tp/p,6) AS precision, round(tp/t,6) AS recall, round(CASE WHEN tp>0 THEN 2e0*(tp/p)*(tp/t)/(tp/p+tp/t) ELSE 0e0 END,6) AS f1 FROM o_per")
def a06(spark, sf):
    s = metrics.detection_scores(view(spark, sf, "v_new"), view(spark, sf, "v_old"), prediction_matches(spark, sf))
    return s.select("class_name", "tp", "fp", "fn", deg("precision"), deg("recall"), deg("f1"))


@query("a07_fp_per_km", "SELECT survey_id, n AS fp, round(km,6) AS km, round(n/km,4) AS fp_per_km FROM (SELECT survey_id, count(*) AS n FROM o_def GROUP BY 1) JOIN (SELECT survey_id, sum(step_m)/1e3 AS km FROM o_step GROUP BY 1) USING (survey_id)")
def a07(spark, sf):
    n = defects(spark, sf).groupBy("survey_id").agg(F.count("*").alias("fp"))
    km = chain(spark, sf).groupBy("survey_id").agg((F.sum("step_m") / 1000.0).alias("km"))
    return n.join(km, "survey_id").select(
        "survey_id", "fp", deg("km"), met(metrics.fp_per_km(F.col("fp"), F.col("km")), "fp_per_km")
    )


@query("a09_throughput", """SELECT CAST(count_if(automated_time_s>0) AS BIGINT) AS n_runs, round(avg(route_distance_km/(automated_time_s/36e2)),6) AS auto_kmh,
round(avg(CASE WHEN manual_time_s>0 THEN route_distance_km/(manual_time_s/36e2) END),6) AS manual_kmh, round(avg(route_distance_km/(automated_time_s/36e2))/avg(CASE WHEN manual_time_s>0 THEN route_distance_km/(manual_time_s/36e2) END),6) AS speedup FROM v_timing""")
def a09(spark, sf):
    return metrics.throughput(view(spark, sf, "v_timing")).select("n_runs", deg("auto_kmh"), deg("manual_kmh"), deg("speedup"))


@query("a10_latency", "SELECT count(*) AS n_runs, round(avg(latency_s),6) AS mean_s, min(latency_s) AS min_s, max(latency_s) AS max_s FROM v_timing WHERE latency_s IS NOT NULL")
def a10(spark, sf):
    return metrics.latency(view(spark, sf, "v_timing")).select("n_runs", deg("mean_s"), "min_s", "max_s")


# ratings -----------------------------------------------------------------------------

cte("o_cons", """SELECT *, CAST(greatest(0,least(2,round_even(median,0))) AS BIGINT) AS consensus FROM (SELECT *, CAST(list_sort([rater_1,rater_2,rater_3])[2] AS DOUBLE) AS median FROM v_rating)""")


def kappa_sql(rows: str, keys: str) -> str:
    """Kappa text over rows(keys, i, j)."""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}CAST(n AS BIGINT) AS n, CASE WHEN i1=i2 OR j1=j2 THEN NULL ELSE round(1e0-o/(sii+sjj-2e0*si*sj/n),9) END AS kappa,
CASE WHEN i1=i2 AND j1=j2 AND i1=j1 THEN 'single category' WHEN i1=i2 OR j1=j2 THEN 'constant rater' END AS note FROM (
SELECT {lead}count(*) AS n, sum((i-j)*(i-j))*1e0 AS o, sum(i)*1e0 AS si, sum(j)*1e0 AS sj, sum(i*i)*1e0 AS sii, sum(j*j)*1e0 AS sjj, min(i) AS i1, max(i) AS i2, min(j) AS j1, max(j) AS j2 FROM ({rows}) {group})"""


@query("a11_weighted_kappa", kappa_sql("SELECT system AS i, consensus AS j FROM o_cons", ""))
def a11(spark, sf):
    r = metrics.with_consensus(view(spark, sf, "v_rating"), RATERS)
    k = metrics.kappa(metrics.confusion_counts(r, F.col("system"), F.col("consensus")), [])
    return k.select("n", F.round("kappa", 9).alias("kappa"), "note")


@query("a11_confusion_matrix", "SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, count(crop_id) AS n FROM (SELECT unnest(range(3)) AS k) a CROSS JOIN (SELECT unnest(range(3)) AS k) b LEFT JOIN o_cons ON system=a.k AND consensus=b.k GROUP BY ALL")
def a11_matrix(spark, sf):
    r = metrics.with_consensus(view(spark, sf, "v_rating"), RATERS)
    return metrics.full_confusion(metrics.confusion_counts(r, F.col("system"), F.col("consensus")))


@query("a12_consensus", "SELECT crop_id, consensus, CASE consensus WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS consensus_severity FROM o_cons")
def a12(spark, sf):
    r = metrics.with_consensus(view(spark, sf, "v_rating"), RATERS)
    return r.select("crop_id", "consensus", text.severity_name(F.col("consensus").cast("double")).alias("consensus_severity"))


@query("a13_pairwise_kappa", kappa_sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS i, {b} AS j FROM v_rating" for a, b in [("system", r) for r in RATERS] + [("rater_1", "rater_2"), ("rater_1", "rater_3"), ("rater_2", "rater_3")]), "a, b"))
def a13(spark, sf):
    k = metrics.pairwise_kappa(view(spark, sf, "v_rating"), RATERS)
    return k.select("a", "b", "n", F.round("kappa", 9).alias("kappa"), "note")


cte("o_split", "SELECT *, rk <= greatest(1, CASE WHEN round_even(7e-1*n,0)>=n THEN n-1 ELSE round_even(7e-1*n,0) END) AS is_train FROM (SELECT *, row_number() OVER (ORDER BY md5('42:'||crop_id), crop_id) AS rk, count(*) OVER () AS n FROM o_cons)")
cte("o_bin", "SELECT is_train, area_ratio, consensus AS j, count(*) AS c FROM o_split GROUP BY ALL")
cte("o_grid", """SELECT CASE WHEN a=23 THEN 6e-2 ELSE a*((6e-2-5e-3)/23e0)+5e-3 END AS low, CASE WHEN b=32 THEN 2e-1 ELSE b*((2e-1-4e-2)/32e0)+4e-2 END AS med, a*100+b AS g
FROM (SELECT unnest(range(24)) AS a) CROSS JOIN (SELECT unnest(range(33)) AS b)""")


def weighted(rows: str, keys: str) -> str:
    return f"""SELECT {keys}, CASE WHEN min(i)=max(i) OR min(j)=max(j) THEN 0e0 ELSE 1e0-sum(c*(i-j)*(i-j))/(sum(c*i*i)+sum(c*j*j)-2e0*sum(c*i)*sum(c*j)/sum(c)) END AS kappa, CAST(sum(c) AS BIGINT) AS n FROM ({rows}) GROUP BY {keys}"""


LABEL = "CASE WHEN area_ratio<{lo} THEN 0 WHEN area_ratio<{me} THEN 1 ELSE 2 END"
cte("o_try", weighted(f"SELECT g, low, med, {LABEL.format(lo='low', me='med')} AS i, j, c FROM o_bin, o_grid WHERE is_train AND low<med", "g, low, med"))
cte("o_win", "SELECT round(low,4) AS low, round(med,4) AS med, round(kappa,12) AS tuned_train_kappa FROM o_try ORDER BY round(kappa,12) DESC, g LIMIT 1")
cte("o_first", weighted(f"SELECT is_train, {LABEL.format(lo='2e-2', me='8e-2')} AS i, j, c FROM o_bin", "is_train"))
cte("o_final", weighted(f"SELECT is_train, {LABEL.format(lo='low', me='med')} AS i, j, c FROM o_bin, o_win", "is_train"))


@query("a14_threshold_search", """SELECT a.n+b.n AS n_samples, a.n AS train_size, b.n AS test_size, round(a.kappa,9) AS initial_train_kappa, round(b.kappa,9) AS initial_test_kappa, low, med,
round(tuned_train_kappa,9) AS tuned_train_kappa, round(f.kappa,9) AS tuned_test_kappa, CASE WHEN a.n+b.n<30 THEN 'small sample' ELSE '' END AS warnings FROM o_win, o_first a, o_first b, o_final f WHERE a.is_train AND NOT b.is_train AND NOT f.is_train""")
def a14(spark, sf):
    r = metrics.with_consensus(view(spark, sf, "v_rating"), RATERS)
    t = metrics.tune_thresholds(r, cfg=CFG)
    kappas = ["initial_train_kappa", "initial_test_kappa", "tuned_train_kappa", "tuned_test_kappa"]
    return t.withColumns({k: F.round(k, 9) for k in kappas})


@query("w07_seeded_split", "SELECT crop_id, is_train FROM o_split")
def w07(spark, sf):
    return metrics.seeded_split(view(spark, sf, "v_rating"), "crop_id", 42).select("crop_id", "is_train")


@query("w05_rating_sheet", """SELECT CAST(sheet_id AS BIGINT) AS sheet_id, crop_id, system_severity, phase=3 AS is_fill FROM (SELECT *, row_number() OVER (ORDER BY phase, k, crop_id) AS sheet_id FROM (
SELECT *, CASE WHEN rk<=33 THEN CASE system_severity WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END ELSE 3 END AS phase FROM (
SELECT *, md5('42:'||crop_id) AS k, row_number() OVER (PARTITION BY system_severity ORDER BY md5('42:'||crop_id), crop_id) AS rk FROM v_rating))) WHERE sheet_id<=100""")
def w05(spark, sf):
    return dataset.rating_sheet(view(spark, sf, "v_rating"), 100, 42)


@query("j13_ratings_metadata", """SELECT r.crop_id, round(CASE WHEN r.crop_id%3<>0 THEN r.area_ratio ELSE m.max_area_ratio END,6) AS area_ratio, consensus
FROM o_cons r LEFT JOIN (SELECT crop_id, area_ratio*2e0 AS max_area_ratio FROM v_rating WHERE crop_id%4<>0) m USING (crop_id) WHERE r.crop_id%3<>0 OR m.max_area_ratio IS NOT NULL""")
def j13(spark, sf):
    """A third of the sheet rows lack their own ratio; a quarter of the crops lack metadata."""
    r = metrics.with_consensus(view(spark, sf, "v_rating"), RATERS)
    sheet = r.select("crop_id", "filename", "consensus", F.when(F.col("crop_id") % 3 != 0, F.col("area_ratio")).alias("own"))
    meta = view(spark, sf, "v_rating").select(
        F.col("filename").alias("file"), F.when(F.col("crop_id") % 4 != 0, F.col("area_ratio") * 2.0).alias("meta_ratio")
    )
    return metrics.join_metadata(sheet, meta).select("crop_id", deg("area_ratio"), "consensus")


@query("g11_severity_numbers", """SELECT raw, CASE lower(trim(raw)) WHEN 'medium' THEN CAST(1 AS BIGINT) WHEN 'high' THEN CAST(2 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS number, half, CASE CAST(greatest(0,least(2,round_even(half,0))) AS INT) WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS name, count(*) AS n FROM (
SELECT ' '||CASE WHEN crop_id%5=4 THEN 'unknown' WHEN crop_id%2=0 THEN upper(system_severity) ELSE lower(system_severity) END||' ' AS raw, (rater_1+rater_2)/2e0 AS half FROM v_rating) GROUP BY ALL""")
def g11(spark, sf):
    r = view(spark, sf, "v_rating")
    s = F.col("system_severity")
    word = F.when(F.col("crop_id") % 5 == 4, F.lit("unknown")).when(F.col("crop_id") % 2 == 0, F.upper(s)).otherwise(F.lower(s))
    raw = F.concat(F.lit(" "), word, F.lit(" "))
    rows = r.select(raw.alias("raw"), ((F.col("rater_1") + F.col("rater_2")) / 2.0).alias("half"))
    return rows.groupBy("raw", "half").agg(F.count("*").alias("n")).select(
        "raw", text.severity_number(F.col("raw")).alias("number"), "half", text.severity_name(F.col("half")).alias("name"), "n"
    )


# verification scores -----------------------------------------------------------------

cte("o_look", """SELECT o.defect_id, o.status AS actual, CASE WHEN p.status IN ('New','Open','Repaired','Failed') THEN p.status ELSE 'unverified' END AS predicted
FROM v_old o LEFT JOIN (SELECT * FROM o_outcome WHERE side='old' AND NOT unverified) p ON p.defect_id=o.defect_id""")


def looked_up(spark, sf):
    truth = view(spark, sf, "v_old").select("defect_id", F.col("status").alias("actual"))
    said = outcome(spark, sf).filter("side = 'old' and not unverified").select("defect_id", "status", F.lit(0).alias("pos"))
    return verification.lookup_predictions(truth, said)


@query("j11_verification_lookup", "SELECT * FROM o_look")
def j11(spark, sf):
    return looked_up(spark, sf).select("defect_id", "actual", "predicted")


STATUS_LIST = ",".join(f"'{s}'" for s in STATUSES)


@query("a15_confusion", f"SELECT a.s AS actual, b.s AS predicted, count(defect_id) AS n FROM (SELECT unnest([{STATUS_LIST}]) AS s) a CROSS JOIN (SELECT unnest([{STATUS_LIST}]) AS s) b LEFT JOIN o_look ON actual=a.s AND predicted=b.s GROUP BY ALL")
def a15(spark, sf):
    return verification.confusion(looked_up(spark, sf))


@query("a15_verification_accuracy", "SELECT count(*) AS total, CAST(count_if(actual=predicted) AS BIGINT) AS correct, round(count_if(actual=predicted)/count(*),6) AS accuracy FROM o_look")
def a15_accuracy(spark, sf):
    return verification.accuracy(looked_up(spark, sf)).select("total", "correct", deg("accuracy"))


@query("a19_metric_table", f"""SELECT 'unique_defect_f1' AS metric, 'MEASURED' AS state, p AS n, round(2e0*(tp/p)*(tp/t)/(tp/p+tp/t),6) AS value FROM o_per WHERE class_name='overall'
UNION ALL SELECT 'fp_per_km', 'MEASURED', (SELECT count(*) FROM o_survey), round((SELECT count(*) FROM o_def)/(SELECT sum(step_m)/1e3 FROM o_step),6)
UNION ALL SELECT 'survey_kmh', 'MEASURED', count(*), round(avg(route_distance_km/(automated_time_s/36e2)),6) FROM v_timing
UNION ALL SELECT 'severity_kappa', 'MEASURED', n, round(kappa,6) FROM ({kappa_sql("SELECT system AS i, consensus AS j FROM o_cons", "")})
UNION ALL SELECT 'verification_accuracy', 'MEASURED', count(*), round(count_if(actual=predicted)/count(*),6) FROM o_look
UNION ALL SELECT 'latency_s', 'MEASURED', count(*), round(avg(latency_s),6) FROM v_timing
UNION ALL SELECT 'blur_recall', 'NOT MEASURED', CAST(0 AS BIGINT), CAST(NULL AS DOUBLE)""")
def a19(spark, sf):
    overall = metrics.detection_scores(view(spark, sf, "v_new"), view(spark, sf, "v_old"), prediction_matches(spark, sf)).filter(
        "class_name = 'overall'"
    )
    km = route_length_km(view(spark, sf, "v_gps"))
    per = km.join(defects(spark, sf).groupBy("survey_id").agg(F.count("*").alias("fp")), "survey_id", "left")
    timing = view(spark, sf, "v_timing")
    rated = metrics.with_consensus(view(spark, sf, "v_rating"), RATERS)
    kappa = metrics.kappa(metrics.confusion_counts(rated, F.col("system"), F.col("consensus")), [])
    checked = verification.accuracy(looked_up(spark, sf))
    none = view(spark, sf, "v_timing").filter("latency_s < 0")
    rows = [
        metrics.metric_row(overall, "unique_defect_f1", F.max(F.col("tp") + F.col("fp")), F.max("f1")),
        metrics.metric_row(per, "fp_per_km", F.count("*"), F.sum("fp") / F.sum("route_km")),
        metrics.metric_row(metrics.throughput(timing), "survey_kmh", F.max("n_runs"), F.max("auto_kmh")),
        metrics.metric_row(kappa, "severity_kappa", F.max("n"), F.max("kappa")),
        metrics.metric_row(checked, "verification_accuracy", F.max("total"), F.max("accuracy")),
        metrics.metric_row(metrics.latency(timing), "latency_s", F.max("n_runs"), F.max("mean_s")),
        metrics.metric_row(none, "blur_recall", F.count("*"), F.avg("latency_s")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("value", F.round("value", 6))
