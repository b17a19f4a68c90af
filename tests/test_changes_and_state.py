"""The hand-computed micro log, and invariants on generated logs."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom import schemas
from pixelloom.operators import attack_defense, changes, preparation, series, state, transitions

WHITE, WIDTH = 31, 100.0
MICRO = [
    (1, 10.0, 0, 0, 1, 5, False), (2, 60.0, 0, 0, 1, 5, False), (3, 100.0, 1, 0, 2, 7, False),
    (4, 150.0, 0, 0, 3, 31, False), (5, 260.0, 0, 0, 1, 5, False), (6, 150.0, 1, 0, 9, 7, True),
]


@pytest.fixture(scope="module")
def micro(spark):
    log = spark.createDataFrame(MICRO, schemas.LOG)
    pixels = spark.createDataFrame([("c", 0, 0, 0.0, 250.0), ("c", 1, 0, 0.0, 250.0)], schemas.COMP_PIXELS)
    stays = state.intervals(log, pixels, WHITE, F.lit(0.0))
    times = state.color_time(stays, WIDTH).cache()
    return log, pixels, stays, times


def test_flags(micro):
    log, pixels, _, _ = micro
    flagged = changes.with_flags(changes.changes_in_comps(log, pixels), 250.0)
    rows = {r.event_id: r for r in flagged.collect()}
    assert {i for i, r in rows.items() if r.redundant_col} == {2, 6}
    assert {i for i, r in rows.items() if r.redundant_colanduser} == {2}
    assert {i for i, r in rows.items() if r.cooldown_cheat} == {2, 5, 6}
    assert {i for i, r in rows.items() if not r.active} == {5}
    counts = {r.bin: r.n_changes for r in changes.change_counts(flagged, WIDTH).collect()}
    assert counts == {1: 3, 2: 2}


def test_color_times_and_references(micro):
    _, pixels, stays, times = micro
    found = {(r.x, r.bin, r.color): r.secs for r in times.collect()}
    assert found == {(0, 1, 31): 10, (0, 1, 5): 90, (0, 2, 5): 50, (0, 2, 31): 50, (0, 3, 31): 50, (1, 1, 31): 100, (1, 2, 7): 100, (1, 3, 7): 50}
    refs = {(r.x, r.bin): r.ref for r in state.reference_images(times, pixels, WIDTH, 2).collect()}
    assert refs == {(0, 1): 5, (1, 1): 31, (0, 2): 5, (1, 2): 31, (0, 3): 31, (1, 3): 7}
    images = {(r.x, r.bin): r.inst for r in state.instant_images(stays, WIDTH).collect()}
    assert (images[0, 2], images[1, 2]) == (31, 7)


def test_attacks(micro):
    log, pixels, _, times = micro
    flagged = changes.with_flags(changes.changes_in_comps(log, pixels), 250.0)
    agreed = attack_defense.agreement(flagged, state.reference_images(times, pixels, WIDTH, 2), WIDTH)
    rows = {r.bin: r for r in attack_defense.attack_defense(agreed).collect()}
    assert (rows[2].n_attack, rows[2].n_defense, rows[2].n_attackonly_users) == (2, 0, 2)
    assert rows[1].n_attack + rows[1].n_defense == 3


events = st.lists(st.tuples(st.floats(0, 400, width=32), st.integers(0, 2), st.integers(0, 3), st.integers(0, 3), st.booleans()), max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=events)
def test_color_time_is_all_the_time(spark, rows):
    log = spark.createDataFrame([(i, float(t), x, 0, u, c, m) for i, (t, x, u, c, m) in enumerate(rows)], schemas.LOG)
    pixels = spark.createDataFrame([("c", x, 0, 20.0, 333.0) for x in range(3)], schemas.COMP_PIXELS)
    times = state.color_time(state.intervals(log, pixels, 3, F.lit(0.0)), WIDTH)
    per_bin = {(r.x, r.bin): r.s for r in times.groupBy("x", "bin").agg(F.sum("secs").alias("s")).collect()}
    assert set(per_bin) == {(x, b) for x in range(3) for b in range(1, 5)}
    assert all(abs(s - (100 if b < 4 else 13)) < 1e-6 for (_, b), s in per_bin.items())
    flagged = changes.with_flags(changes.changes_in_comps(log, pixels), 250.0)
    agreed = attack_defense.agreement(flagged, state.reference_images(times, pixels, WIDTH, 2), WIDTH)
    assert agreed.count() == flagged.where("active and seconds > 20").count()


def brute_window_users(rows, window):
    last = max(b for b, _ in rows) + window
    return {b: len({u for c, u in rows if b - window < c <= b}) for b in range(1, last + 1)}


def test_window_users(spark):
    rows = [(1, 1), (1, 2), (3, 1), (6, 2), (7, 1), (7, 3), (8, 3), (20, 1)]
    frame = spark.createDataFrame([("c", b * 10.0 - 5, 0.0, 300.0, u, True) for b, u in rows], "comp_id string, seconds double, t0 double, t1 double, user long, active boolean")
    found, held = {r.bin: r.n_users_window for r in attack_defense.window_users(frame, 10.0, 3).collect()}, 0
    for b, n in brute_window_users(rows, 3).items():
        held = found.get(b, held)
        assert held == n


def test_deduplication_keeps_moderators(spark):
    rows = [(1, 5.0001, 0, 0, 1, 2, False), (2, 5.0002, 0, 0, 1, 2, False), (3, 5.0, 0, 0, 1, 2, True), (4, 5.0, 0, 0, 1, 2, True), (5, 5.2, 0, 0, 1, 2, False)]
    log = spark.createDataFrame(rows, schemas.LOG)
    assert sorted(r.event_id for r in preparation.deduplicated(log).collect()) == [1, 3, 4, 5]
    assert sorted(r.event_id for r in preparation.deduplicated(log, "none").collect()) == [3, 4, 5]


def brute_kendall(values):
    n, m = len(values), len(set(values))
    s = sum((values[j] > values[i]) - (values[j] < values[i]) for i in range(n) for j in range(i + 1, n))
    return 0.0 if m == 1 else 2 * s / (n * n * (m - 1) / m)


def test_kendall(spark):
    values = [3.0, 3.0, 1.0, 4.0, 4.0, 4.0, 2.0, 9.0, 0.0, 5.0, 5.0, 7.0]
    frame = spark.createDataFrame([("c", "v", i + 1, v) for i, v in enumerate(values)], "comp_id string, variable string, bin int, val double")
    for r in series.rolling_kendall(frame, 5).collect():
        assert r.tau == pytest.approx(brute_kendall(values[max(0, r.bin - 5) : r.bin]))


def test_cooldown_walk():
    assert transitions._fire([1, 2, 3, 6, 7, 20], 4) == [True, False, False, True, False, True]
    assert transitions._fire([], 4) == []
