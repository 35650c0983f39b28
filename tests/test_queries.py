"""Registered queries against their oracle SQL on the smallest data set."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

KEYS = [
    "j01_gps_interpolation", "c04_dedup_tracks", "w04_segments", "t02_budget_selection", "j08_greedy_match", "a06_detection_scores",
    "a14_threshold_search", "c03_suppression", "c02_hash_groups", "t05_listed_names", "s07_score_sheets", "a11_weighted_kappa", "a03_union_area", "w06_grouped_split", "f14_truth_validation", "s02_gpx",
    "s11_status_update", "x01_streaming_closest_approach", "x02_streaming_survey_load",
    "s01_gps_csv", "s03_osm_cache", "s05_defect_list", "s12_queue_export", "q04_verify_pairs", "q05_from_files",
    "s05_defect_json", "s08_label_text", "s09_file_inventory", "s13_report_files", "s14_landed_uploads", "f14_truth_file", "f20_store_lookup", "t04_nearest_cross_split", "t04_nearest_hash",
    "j15_similar_hashes", "q04_write_back", "c04_defect_tracks", "a02_defect_boxes", "g13_survey_clocks", "a20_orientation_baseline", "j03_snap_to_trace",
]


@pytest.fixture(scope="module")
def duck():
    from roadloom.plans.fixtures import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_oracle(spark, duck, key):
    from roadloom.plans.catalogue import ORACLES, QUERIES

    df = QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted((str(tuple(r[c] for c in cols)) for r in df.collect()))
    cur = duck.execute(ORACLES[key])
    names = [d[0] for d in cur.description]
    want = sorted(str(tuple(dict(zip(names, row))[c] for c in cols)) for row in cur.fetchall())
    assert sorted(names) == cols and got == want and got


def test_every_query_has_an_oracle():
    from roadloom.plans.catalogue import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)


def test_entry_gives_a_ranked_queue(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).limit(5).collect()
    assert len(rows) == 5 and rows[0].queue_rank == 1
