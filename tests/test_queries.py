"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from pixelloom.plans import registry

#: One or two of each family; the driver compares all of them.
SAMPLE = [
    "s8_stored_log", "p7_event_numbers", "c3_split_at_jumps", "c18_free_pixels", "t19_return_rate", "t23_autocorrelation_by_case", "d2_chosen_variables", "d5_training_rows", "x4_merged_periods", "x5_half_maximum_starts", "e6_single_variables", "e17_correlated_groups",
    "s1_raw_lines", "p6_dense_users", "p9_deduplicated", "c4_overlaps", "c14_active_area", "c18_pixel_owners", "t13_change_counts", "f1_f3_change_flags", "g12_gap_statistics", "g16_user_pair_radius",
    "t2_color_time", "t5_stability_stats", "t8_reference_images", "t11_differing_pixels", "t14_attack_defense", "t15_window_users", "w_series_windows", "x2_transitions", "u2_user_paths", "n4_largest_component",
    "d1_feature_windows", "e3_threshold_counts", "i5_block_modes",
]


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = Counter(repr(tuple(norm(r[i]) for i in at)) for r in found.fetchall())
    assert got == want and got


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
