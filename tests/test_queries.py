"""Every registered query equals its SQL twin on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from filmgrain.plans import catalogue
from tests.conftest import SMALL
from tools.compare import TABLES, connect, differences

# The corpus queries have their own module beside their other tests.
NAMES = sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    problem, rows = differences(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql().get(name), SMALL)
    assert problem is None
    assert rows >= 0


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries()) >= set(NAMES)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The same tables with about a third of the rows under one key or one text."""
    out = str(tmp_path_factory.mktemp("skewed"))
    hot = {
        "events": "SELECT * REPLACE (CASE WHEN event_id%3=0 THEN 1 ELSE user_id END AS user_id)",
        "lineitem": "SELECT * REPLACE (CASE WHEN (l_orderkey+l_partkey)%3=0 THEN 1 ELSE l_suppkey END AS l_suppkey)",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey%3=0 THEN 1 ELSE o_custkey END AS o_custkey)",
        "documents": "SELECT * REPLACE (CASE WHEN doc_id%3=0 THEN 'same text' ELSE text END AS text)",
        "embeddings": "SELECT * REPLACE (CASE WHEN vec_id%3=0 THEN 1 ELSE label END AS label)",
    }
    for t in TABLES:
        duckdb.sql(f"COPY ({hot.get(t, 'SELECT *')} FROM '{SMALL}/{t}.parquet') TO '{os.path.join(out, t)}.parquet' (FORMAT PARQUET)")
    return out


@pytest.mark.parametrize("name", [
    "wn01_score_changes", "wn04_merge_short_shots", "jn02_point_to_shot", "jn06_frame_at_or_after", "jn13_match_cuts", "wn10_adjacent_pairs",
    "wn11_direction_consistency", "ag05_flow_statistics", "ag06_shot_motion", "wn15_timeline", "wn08_letterbox_bounds", "wn09_spread_pixels",
    "ag02_lightness", "ag12_window_levels", "jn14_illegal_moves", "wn20_next_stage", "src03_dedupe_ingest", "st03_first_copies", "ag08_primary_track",
    "ag13_spectral_flux", "shot_palette", "st04_move_audit", "src05_replace_documents", "prj31_command_verdict", "ag19_measured_facts",
])
def test_hot_key_gives_the_same_rows(spark, skewed, name):
    problem, _ = differences(spark, connect(skewed), name, entry_module.queries()[name], entry_module.oracle_sql().get(name), skewed)
    assert problem is None
