"""The log is dealt and sorted once for all tables of a query, and what is made of it equals plain loops."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pixelloom import schemas
from pixelloom.operators import attack_defense, changes, state
from pixelloom.plans import registry, storage

WIDTH = 100.0
#: At one pixel: changes before, at and after the beginning of a life, two at one time, one at its end; at others: none before, none at all, one long before.
LOG = [
    (1, 40.0, 0, 0, 1, 5, False), (2, 100.0, 0, 0, 2, 6, False), (3, 100.0, 0, 0, 2, 7, False), (4, 130.0, 0, 0, 1, 5, True), (5, 130.0, 0, 0, 3, 8, False),
    (6, 300.0, 0, 0, 3, 9, False), (7, 310.0, 0, 0, 1, 9, False), (8, 120.0, 1, 0, 4, 5, False), (9, 160.0, 1, 0, None, 5, False), (10, 20.0, 2, 0, 1, 6, False), (11, 100.0, 4, 0, 1, 6, False),
]
LIVES = {"a": (100.0, 300.0), "b": (0.0, 350.0), "c": (135.0, 290.0)}


@pytest.fixture(scope="module")
def tables(spark):
    pixels = [(c, x, 0, *life) for c, life in LIVES.items() for x in range(5)]
    return spark.createDataFrame(LOG, schemas.LOG), spark.createDataFrame(pixels, schemas.COMP_PIXELS)


def loops(opened: float) -> set[tuple]:
    found = set()
    for comp, (t0, t1) in LIVES.items():
        for x in range(5):
            log = sorted((s, i, color) for i, s, at, _, _, color, _ in LOG if at == x)
            before = [color for s, _, color in log if s < t0]
            stays = [(t0, before[-1] if before else 31)] + [(s, color) for s, _, color in log if t0 < s < t1]
            for (beg, color), (end, _) in zip(stays, [*stays[1:], (t1, None)]):
                if end > max(beg, opened):
                    found.add((comp, x, color, max(beg, opened), end))
    return found


@pytest.mark.parametrize("opened", [0.0, 140.0])
def test_stays_equal_loops(tables, opened):
    rows = state.intervals(*tables, 31, F.lit(opened)).collect()
    assert {(r.comp_id, r.x, r.color, r.beg, r.end) for r in rows} == loops(opened) and len(rows) == len(loops(opened))


def test_flags_before_and_after_the_join(tables):
    log, pixels = tables
    after = changes.with_flags(changes.changes_in_comps(log, pixels), 50.0)
    before = changes.with_cheats(changes.changes_in_comps(changes.with_redundancy(log, ["x", "y"]), pixels), 50.0)
    names = ["comp_id", "event_id", "active", "redundant_col", "redundant_colanduser", "cooldown_cheat"]
    assert sorted(map(tuple, before.select(names).collect())) == sorted(map(tuple, after.select(names).collect()))


def test_counts_and_fights_in_one(tables):
    log, pixels = tables
    flagged = changes.with_flags(changes.changes_in_comps(log, pixels), 50.0)
    ref = state.reference_images(state.color_time(state.intervals(log, pixels, 31, F.lit(140.0)), WIDTH), pixels, WIDTH, 2)
    counts, fights = changes.change_counts(flagged, WIDTH), attack_defense.attack_defense(attack_defense.agreement(flagged, ref, WIDTH)).drop("n_users")
    both = attack_defense.counts_and_fights(flagged, ref, WIDTH)
    apart = counts.join(fights, ["comp_id", "bin"], "left").na.fill(0).select(both.columns)
    want = Counter(map(tuple, apart.collect()))
    assert Counter(map(tuple, both.na.fill(0).collect())) == want and len(want) > 3


def _reads_of_events(monkeypatch, spark, sf_dir, name: str) -> int:
    """How many tables that the query writes, and its result, are made of `events` itself."""
    read = []

    def write(df, table):
        read.append(any("events.parquet" in f for f in df.inputFiles()))
        return storage.write_shared(df, table)

    from pixelloom.plans import more_queries, series_queries, state_queries, table_queries

    for module in (more_queries, series_queries, state_queries, table_queries):
        monkeypatch.setattr(module, "write_shared", write)
    result = registry.QUERIES[name](spark, sf_dir)
    return sum(read) + any("events.parquet" in f for f in result.inputFiles())


def test_clean_features_read_events_once(monkeypatch, spark, sf_dir):
    assert _reads_of_events(monkeypatch, spark, sf_dir, "d8_clean_features") == 1


def test_half_maximum_starts_read_events_once(monkeypatch, spark, sf_dir):
    assert _reads_of_events(monkeypatch, spark, sf_dir, "x5_half_maximum_starts") == 1
