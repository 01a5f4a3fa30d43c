"""Some of the registered queries against their SQL; the driver runs all of them."""

import math
import os

import duckdb
import pytest

from tidepool import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["title_features", "percolate_compound_anyof", "percolate_forbidden_phrase", "percolate_part_queries", "rank_tree_topk", "registry_create_conflicts", "load_csv", "learn_bigrams_npmi", "percolate_mixed", "percolate_mixed_lanes", "mixed_cost_classes", "percolate_bodies", "rank_copies", "load_bulk", "feedback_report", "registry_metrics", "rank_merged_parts", "total_hits_merged", "owned_emissions", "delivery_checksums", "delivery_files", "load_files", "profile_fingerprints", "rank_saturated", "parse_limits", "query_shapes", "explain_pairs", "solr_aliases", "learned_aliases", "learned_phrases", "vocabulary_merged", "registry_durable", "rank_pages"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["percolate_prefiltered", "explain_failures"])
def test_all_titles_are_prefiltered_and_explained(spark, name, monkeypatch):
    monkeypatch.setitem(globals(), "SF", SF.replace("sf0.001", "sf0.01"))  # more titles than the queries over some ids take
    test_query_equals_its_sql(spark, name)
    assert catalog.QUERIES[name](spark, SF).where("title_id > 200").limit(1).count() == 1
