"""Kernels against slow statements, sources against hand-written files."""

from __future__ import annotations

import json
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom import schemas
from pixelloom.operators import complexity, compositions, entropy, evaluation, learning, network, nullmodels, users
from pixelloom.config import TEST_CANVAS
from pixelloom.plans.components import connected_components
from pixelloom.sources import atlas, raw_logs

ORIGIN = "2022-04-01 12:44:10"


def test_raw_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'time,user,color,coords\n2022-04-01 12:44:10.315 UTC,AAAA==,#FF4500,"42,42"\n2022-04-03 18:00:00 UTC,BBBB==,#FFFFFF,"10,20,12,21"\nbad line\n'
    )
    (tmp_path / "b.csv").write_text('h\n2022-04-01 12:44:09 UTC,AAAA==,#ffffff,"-1,0"\n')
    lines = raw_logs.read_lines(spark, str(tmp_path))
    events = raw_logs.expand_shapes(raw_logs.event_numbers(raw_logs.parse_lines(lines, ORIGIN)))
    rows = sorted((r.event_id, r.seconds, r.x, r.y, r.moderator) for r in events.collect())
    assert rows[0] == (0, 0.315, 42, 42, False) and rows[-1] == (10_000_000, -1.0, -1, 0, False)
    assert [r[2:4] for r in rows[1:7]] == [(x, y) for x in (10, 11, 12) for y in (20, 21)] and {r[0] for r in rows[1:7]} == {1}
    colors, users = raw_logs.dense_colors(events), raw_logs.dense_users(events)
    assert {r.hex: r.color for r in colors.collect()} == {"#FFFFFF": 0, "#FF4500": 1}
    assert {r.user_hash: r.user for r in users.collect()} == {"AAAA==": 0, "BBBB==": 1}
    log = raw_logs.condense(events, colors, users)
    raw_logs.write_log(log, str(tmp_path / "log"))
    assert raw_logs.read_log(spark, str(tmp_path / "log")).count() == 8
    assert raw_logs.read_log(spark, str(tmp_path / "log"), before=1.0).count() == 2


def test_circles(spark):
    line = '2023-07-21 10:00:00 UTC,DDDD==,"{X: 5, Y: 5, R: 2}",#000000'
    lines = spark.createDataFrame([(line,)], "line string")
    pixels = raw_logs.expand_shapes(raw_logs.parse_lines(lines, ORIGIN, color_last=True))
    assert pixels.count() == 9 and pixels.where("moderator").count() == 9


def test_old_csv(spark, tmp_path):
    (tmp_path / "old.csv").write_text("ts,user_hash,x_coordinate,y_coordinate,color\n2017-04-01 10:00:01.5 UTC,a,1,2,3\n2017-04-01 10:00:01.5 UTC,a,1,2,3\nnot a time,b,1,2,3\n2017-04-01 10:00:03 UTC,,1,2,3\n2017-04-01 10:00:02 UTC,b,4,5,6\n2018-04-01 10:00:02 UTC,b,4,5,6\n")
    rows = raw_logs.clean_old_log(raw_logs.read_old_csv(spark, str(tmp_path / "old.csv")), "2017-04-01 00:00:00", "2017-04-02 00:00:00").collect()
    assert sorted((r.seconds, r.user_hash) for r in rows) == [(0.0, "a"), (0.5, "b")]


def test_atlas(spark, tmp_path):
    box = [[0, 0], [0, 9], [9, 9], [9, 0]]
    entries = [
        {"id": "a", "name": "n", "description": "", "links": {}, "path": {"T": box}},
        {"id": "b", "name": "n", "description": "", "links": {"subreddit": ["s"]}, "path": {"5-10, 12": box, "T": box}},
        {"id": "bad", "name": "n", "description": "", "links": {}, "path": {"1": box}},
    ]
    (tmp_path / "atlas.json").write_text(json.dumps(entries))
    read = atlas.repair(atlas.read_atlas(spark, str(tmp_path / "atlas.json")), ["bad"])
    rows = [(r.comp_id, r.seq, r.t0, r.t1) for r in atlas.borders_of(read, 1800.0, 9e5).orderBy("comp_id", "seq").collect()]
    assert rows == [("a", 0, 0.0, 9e5), ("b", 0, 7200.0, 18000.0), ("b", 1, 19800.0, 21600.0)]


def test_scaling_csv(spark, tmp_path):
    table = spark.createDataFrame([("a", True, False), ("b", False, True), ("c", False, False)], "comp_id string, streamer boolean, alliance boolean")
    atlas.write_scaling(table, str(tmp_path / "s"))
    parts = atlas.read_scaling(spark, str(tmp_path / "s"), "comp_id string, streamer boolean, alliance boolean")
    assert {k: [r.comp_id for r in v.collect()] for k, v in parts.items()} == {"streamer": ["a"], "alliance": ["b"], "other": ["c"]}


def slow_inside(xs, ys, px, py):
    """On the border's exact line, or inside by even-odd crossing."""
    n, inside = len(xs), False
    for i in range(n):
        x0, y0, x1, y1 = xs[i], ys[i], xs[(i + 1) % n], ys[(i + 1) % n]
        if (x1 - x0) * (py - y0) == (y1 - y0) * (px - x0) and min(x0, x1) <= px <= max(x0, x1) and min(y0, y1) <= py <= max(y0, y1):
            return True
        if (y0 > py) != (y1 > py) and px < x0 + (py - y0) * (x1 - x0) / (y1 - y0):
            inside = not inside
    return inside


def edge_distance(xs, ys, px, py):
    best = float("inf")
    for i in range(len(xs)):
        a, b = np.array([xs[i], ys[i]], float), np.array([xs[(i + 1) % len(xs)], ys[(i + 1) % len(xs)]], float)
        t = np.clip(np.dot(np.array([px, py]) - a, b - a) / max(np.dot(b - a, b - a), 1e-12), 0, 1)
        best = min(best, float(np.hypot(*(a + t * (b - a) - (px, py)))))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=3, max_size=3, unique=True))
def test_triangles(points):
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    found = filled(xs, ys)
    want = {(x, y) for x in range(13) for y in range(13) if slow_inside(xs, ys, x, y)}
    assert want <= found
    assert all(edge_distance(xs, ys, x, y) < 0.71 for x, y in found - want)  # border pixels lie next to the exact line


def slow_fill(xs, ys):
    """By a set: Bresenham lines, and every pixel between the cuts of each scan line."""
    found, n = set(), len(xs)
    for i in range(n):
        found.update((x, y) for y, x in compositions._line(xs[i], ys[i], xs[(i + 1) % n], ys[(i + 1) % n]))
    for y in range(min(ys), max(ys) + 1):
        cuts = sorted(xs[i] + (y - ys[i]) * (xs[(i + 1) % n] - xs[i]) / (ys[(i + 1) % n] - ys[i]) for i in range(n) if (ys[i] <= y) != (ys[(i + 1) % n] <= y))
        for a, b in zip(cuts[::2], cuts[1::2], strict=True):
            found.update((x, y) for x in range(int(-(-a // 1)), int(b // 1) + 1))
    return found


def filled(xs, ys):
    y, x0, x1 = (v.tolist() for v in compositions.polygon_runs(xs, ys))
    pixels = [(x, c) for c, a, b in zip(y, x0, x1, strict=True) for x in range(a, b + 1)]
    assert len(pixels) == len(set(pixels)) and sorted(zip(y, x0, strict=True)) == list(zip(y, x0, strict=True))
    assert all(c != d or b + 1 < a for c, b, d, a in zip(y, x1, y[1:], x0[1:], strict=False))  # runs of a line don't touch
    return set(pixels)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.integers(-25, 25), st.integers(-25, 25)), min_size=1, max_size=9))
def test_runs_equal_sets(points):
    xs, ys = [x for x, _ in points], [y for _, y in points]
    assert filled(xs, ys) == slow_fill(xs, ys)


def test_large_border_is_filled_at_once():
    began = time.time()
    y, x0, x1 = compositions.polygon_runs([0, 1999, 1999, 1000, 0], [0, 0, 1999, 700, 1999])
    assert time.time() - began < 5 and (x1 - x0 + 1).sum() > 2_000_000 and len(y) < 5000


def test_concave_polygon():
    xs, ys = [0, 0, 8, 8, 4], [0, 8, 8, 0, 4]
    found = filled(xs, ys)
    assert (4, 2) not in found and (4, 4) in found and (1, 1) in found and (0, 8) in found


def test_hilbert_order_visits_neighbours():
    order = entropy.hilbert_order(8, 8)
    assert sorted(order.tolist()) == list(range(64))
    y, x = np.divmod(order, 8)
    assert (np.abs(np.diff(x)) + np.abs(np.diff(y)) == 1).all()
    assert sorted(entropy.hilbert_order(5, 3).tolist()) == list(range(15))


def slow_phrases(data):
    known, phrase, count = set(), b"", 0
    for i in range(len(data)):
        phrase += data[i : i + 1]
        if phrase not in known:
            known.add(phrase)
            phrase, count = b"", count + 1
    return count + bool(phrase)


@given(st.binary(max_size=60))
def test_lz78(data):
    assert entropy.lz78_phrases(data) == slow_phrases(data)


def test_shift_correlation():
    rng = np.random.default_rng(1)
    now, old = rng.integers(0, 3, (5, 4)), rng.integers(0, 3, (5, 4))
    found = complexity.shift_correlation(now, old)
    for dy in range(5):
        for dx in range(4):
            assert np.isclose(found[dy, dx], (now == np.roll(old, (dy, dx), (0, 1))).mean())


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (10, 9), (None, 4), *[(100, i) for i in range(101, 160)], *[(i, i + 1) for i in range(200, 240)]]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8, 100: 100} | dict.fromkeys(range(101, 160), 100) | dict.fromkeys(range(200, 241), 200)
    assert found == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_clustering(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0)], "u long, v long, w double")
    row = network.clustering(edges).first()
    assert (row.n_triangles, row.n_triples, row.clustering) == (1, 5, 0.6)


def test_whole_clustering_keeps_weak_edges_of_the_largest_component(spark, monkeypatch):
    from pixelloom.plans import registry, user_queries

    big, small = [(1, 2, 0.01), (2, 3, 0.02), (1, 3, 0.5), (3, 4, 0.1)], [(7, 8, 0.9), (8, 9, 0.9), (7, 9, 0.9)]
    made = spark.createDataFrame(big + small, "u long, v long, w double")
    monkeypatch.setattr(user_queries, "edges", lambda s, d: made)
    row = registry.QUERIES["n5_whole_clustering"](spark, "").first()
    assert (row.n_triangles, row.n_triples, row.clustering) == (1, 5, 0.6)


def test_null_models_follow_their_weights(spark):
    log = spark.range(20_000).select(F.col("id").alias("event_id"), (F.col("id") * 100.0).alias("seconds"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1).cast("long").alias("user"), F.lit(0).alias("color"), F.lit(False).alias("moderator"))
    weights = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (5, 2, 4.0)], "x int, y int, weight double")
    drawn = nullmodels.weighted(log, weights)
    shares = {(r.x, r.y): r["count"] / 20_000 for r in drawn.groupBy("x", "y").count().collect()}
    assert drawn.count() == 20_000 and all(abs(shares[k] - w) < 0.02 for k, w in {(0, 0): 0.125, (0, 1): 0.375, (5, 2): 0.5}.items())
    free = nullmodels.uniform(log, TEST_CANVAS)
    assert free.where("seconds < 432000 and x > 4").count() == 0 and free.where("color > 2 and seconds < 864000").count() == 0


def test_polygon_kernel_in_spark(spark):
    path = [(0, 0), (0, 2), (2, 2), (2, 0)]
    borders = spark.createDataFrame([("c", path, 0.0, 1.0)], "comp_id string, path array<struct<x:int,y:int>>, t0 double, t1 double")
    assert compositions.polygon_pixels(borders).count() == 9
    merged = compositions.merge_ranges(spark.createDataFrame([("c", 0, 0, 0.0, 5.0), ("c", 0, 0, 5.0, 7.0), ("c", 0, 0, 9.0, 10.0)], schemas.COMP_PIXELS))
    assert sorted((r.t0, r.t1) for r in merged.collect()) == [(0.0, 7.0), (9.0, 10.0)]


@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=1, max_size=12))
def test_convex_hull(points):
    hull = learning.convex_hull(points)
    assert set(hull) <= set(points)
    if len(hull) > 2:
        for a, b in zip(hull, hull[1:] + hull[:1], strict=True):
            assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for p in points)


def test_decay_times(spark):
    rows = [(c, 1000.0 * i, float(np.exp(-1000.0 * i / tau))) for c, tau in ((0, 4000.0), (1, 90_000.0)) for i in range(8)]
    found = {r.size_class: r.tau for r in learning.decay_times(spark.createDataFrame(rows, "size_class int, age double, share double")).collect()}
    assert abs(found[0] / 4000 - 1) < 1e-3 and abs(found[1] / 90_000 - 1) < 1e-3


def brute_lz77(symbols):
    at = count = 0
    while at < len(symbols):
        best = 0
        for start in range(at):
            length = 0
            while at + length < len(symbols) and symbols[start + length] == symbols[at + length]:
                length += 1
            best = max(best, length)
        at, count = at + max(1, best), count + 1
    return count


def test_lz77_factors_equal_brute_force():
    rng = random.Random(3)
    for n in (0, 1, 2, 5, 40, 90):
        for letters in (1, 2, 5):
            symbols = bytes(rng.randrange(letters) for _ in range(n))
            assert entropy.lz77_factors(symbols) == brute_lz77(symbols)


def test_db4_step_keeps_the_energy_inside():
    """The filters are orthonormal: a signal far from both ends keeps its energy; a constant and a line have no high part inside."""
    signal = np.zeros(64)
    signal[24:40] = np.random.default_rng(1).standard_normal(16)
    assert sum(complexity.db4_energies(signal)) == pytest.approx((signal**2).sum())
    low, high = complexity.db4_energies(np.full(32, 3.0))
    assert high == pytest.approx(0, abs=1e-12) and low > 0


def test_t_quantiles():
    """Fixed values of the tables."""
    for p, degrees, t in ((0.975, 1, 12.7062), (0.975, 5, 2.5706), (0.95, 30, 1.6973), (0.975, 98, 1.98447)):
        assert users.t_quantile(p, degrees) == pytest.approx(t, abs=1e-3)


def test_least_useful_features(spark):
    strengths = {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.9, "rand_0": 0.5}
    attributions = spark.createDataFrame([(f, s * sign) for f, s in strengths.items() for sign in (1, -1)], "feature string, attribution double")
    matrix = spark.createDataFrame([("a", "b", -0.95), ("a", "c", 0.2), ("b", "c", 0.99)], "a string, b string, correlation double")
    assert evaluation.least_useful(attributions, matrix, 5, 0.9) == ["a", "c"]
    assert evaluation.least_useful(attributions, matrix, 1, 0.9) == ["a"]


def test_shift_descriptors(spark):
    rows = [("c", 1, d, 1, a) for d, a in ((0, 1.0), (1, 0.8), (2, 0.5), (3, 0.5), (4, 0.2))] + [("e", 1, 0, 1, 1.0), ("e", 1, 1, 1, 0.4)]
    found = {r.comp_id: r for r in complexity.shift_descriptors(spark.createDataFrame(rows, "comp_id string, bin int, distance int, n_shifts int, agreement double")).collect()}
    w, d, a = np.array([1, 1, 2, 2]), np.array([1, 2, 3, 4]), np.array([0.8, 0.5, 0.5, 0.2])
    dc, ac = d - (w * d).sum() / 6, a - (w * a).sum() / 6
    assert (found["c"].least, found["c"].at) == (0.2, 4) and found["c"].slope == pytest.approx((w * dc * ac).sum() / (w * dc * dc).sum())
    assert (found["e"].at, found["e"].slope) == (1, None)


def test_lone_pixel_has_a_perimeter(spark):
    pixels = spark.createDataFrame([("c", 1, 1), ("d", 5, 5), ("d", 5, 6)], "comp_id string, x int, y int")
    assert {(r.x, r.y): r.weight for r in nullmodels.perimeter_weights(pixels).collect()} == {(1, 1): 1.0, (5, 5): 2.0, (5, 6): 2.0}
