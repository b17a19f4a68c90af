"""Times at the edges of binary numbers, against SQL: whole and half milliseconds."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def edge_events(tmp_path_factory):
    """Events at microseconds that are whole or half milliseconds, spread over thirty days."""
    folder = tmp_path_factory.mktemp("edges")
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 431963 * 1000 + CASE WHEN i % 2 = 0 THEN 500 ELSE 0 END) AS ts, i % 50 AS user_id,
        'click' AS event_type, CASE WHEN i % 9 = 0 THEN 400.0 ELSE 10.0 END AS value, '{{"k": ' || i % 100 || '}}' AS props FROM range(6000) r(i)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", ["p1_p2_times", "p9_deduplicated", "p9_without_repeated", "p13_log_checks", "s1_raw_lines"])
def test_edges_equal_sql(spark, edge_events, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{edge_events}/events.parquet'")
    df = __spark_entry__.queries()[name](spark, edge_events)
    want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
