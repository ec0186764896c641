"""Registered queries against their SQL on the smallest tables. UNDERTOW_ALL=1 runs every one."""

import math
import os

import duckdb
import pytest

from undertow.plans.catalogue import ORACLES, QUERIES

QUICK = [
    "n02_normalize_label", "n05_synthetic_clock", "n11_sax_symbol", "n14_attack_family", "d01_inject", "d03_split_map", "d05_split_tags", "d11_split_profile",
    "d12_sequence_windows", "d14_curriculum", "d15_normal_holdout", "g02_exact_quantiles", "c03_f1_max", "c09_grid_sweep", "c10_operating_points",
    "e01_classification_metrics", "e08_roc_coordinates", "e12_score_stats", "h08_record_encoder", "h10_rff_encoder", "h17_encoder_separability",
    "t02_state_scan", "t07_fit_readout", "t11_state_space_scan", "m11_mahalanobis", "m18_lr_boost", "m28_ewma_drift", "m30_ewma_k",
    "s01_read_flows", "s03_read_hybrid", "e23_macro_average", "r04_stream_ewma", "r11_session_windows",
]
NAMES = sorted(ORACLES) if os.environ.get("UNDERTOW_ALL") else QUICK
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, (int, float)) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
