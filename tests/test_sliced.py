"""Weights and draws by time slices against loops over slices and pixels."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from pixelloom.operators import compositions
from pixelloom.operators.sliced import SlicedWeights

LOG = "event_id long, seconds double, x int, y int, user long, color int, moderator boolean"


def brute(pixels, exponent, how, unowned, layers=2):
    """{(t_beg, t_end): {(x, y): weight}} from rows (comp_id, x, y, t0, t1)."""
    area = Counter(c for c, x, y in {(c, x, y) for c, x, y, _, _ in pixels})
    times = sorted({t for p in pixels for t in p[3:]})
    out = {}
    for a, b in zip(times, times[1:], strict=False):
        held = {}
        for c, x, y, t0, t1 in pixels:
            if t0 <= a and t1 >= b:
                held.setdefault((x, y), set()).add(c)
        owned = {p: sorted(cs, key=lambda c: (area[c], c))[:layers] for p, cs in held.items()}
        count = Counter((k, c) for cs in owned.values() for k, c in enumerate(cs))
        weight = {}
        for p, cs in owned.items():
            w = [float(count[k, cs[k]]) ** exponent if k < len(cs) else unowned for k in range(layers)]
            weight[p] = {"max": max(w), "sum": sum(w), "mean": sum(w) / max(1, len(cs))}[how]
        out[a, b] = {p: w for p, w in weight.items() if w > 0}
    return {k: v for k, v in out.items() if v}


@pytest.fixture(scope="module")
def pixels():
    rng, rows = random.Random(8), []
    for c in range(9):
        x0, y0, t0 = rng.randrange(6), rng.randrange(6), rng.randrange(8) * 10
        t1 = t0 + rng.randrange(1, 6) * 10
        rows += [(f"c{c}", x, y, float(t0), float(t1)) for x in range(x0, x0 + rng.randrange(1, 5)) for y in range(y0, y0 + rng.randrange(1, 5))]
    rows += [("back", 9, 9, 0.0, 10.0), ("back", 9, 9, 30.0, 40.0), ("back", 8, 9, 0.0, 40.0)]  # on, off and on again
    return rows


def sliced(spark, pixels, **options):
    return SlicedWeights(compositions.pixel_owners(spark.createDataFrame(pixels, "comp_id string, x int, y int, t0 double, t1 double")), **options)


@pytest.mark.parametrize(("how", "unowned"), [("max", 0.0), ("mean", 0.0), ("sum", 1.5)])
def test_weights_equal_loops(spark, pixels, how, unowned):
    got = {}
    for r in sliced(spark, pixels, exponent=0.7, how=how, unowned=unowned).pixel_weights().collect():
        assert (r.x, r.y) not in got.setdefault((r.t_beg, r.t_end), {})
        got[r.t_beg, r.t_end][r.x, r.y] = r.weight
    want = brute(pixels, 0.7, how, unowned)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_draws_follow_the_weights_of_their_time(spark, pixels):
    log = [(i, (i * 7919 % 131000) / 1000, -1, -2, i % 5, i % 3, False) for i in range(40_000)]
    df = spark.createDataFrame(log, LOG)
    model = sliced(spark, pixels)
    got = {r.event_id: r for r in model.draw(df).collect()}
    assert {i: (r.seconds, r.user, r.color) for i, r in got.items()} == {e[0]: (e[1], e[4], e[5]) for e in log}
    want, seen = brute(pixels, 1.0, "max", 0.0), {}
    for i, seconds, *_ in log:
        at = next((w for (a, b), w in want.items() if a <= seconds < b), None)
        if at is None:
            assert (got[i].x, got[i].y, got[i].owners) == (-1, -2, None)
        else:
            assert (got[i].x, got[i].y) in at  # never outside a composition that is alive
            seen.setdefault(next(k for k in want if k[0] <= seconds < k[1]), Counter())[got[i].x, got[i].y] += 1
    for k, weight in want.items():
        n, total = sum(seen[k].values()), sum(weight.values())
        for p, w in weight.items():
            expected = n * w / total
            assert abs(seen[k][p] - expected) < 5 * expected**0.5 + 3
    again = {r.event_id: (r.x, r.y) for r in model.draw(df.repartition(7)).collect()}
    assert again == {i: (r.x, r.y) for i, r in got.items()}
    assert any((r.x, r.y) != again[r.event_id] for r in model.draw(df, seed=1).collect())


def test_no_compositions_and_no_log(spark, pixels):
    log = spark.createDataFrame([(1, 5.0, 3, 4, 1, 1, False)], LOG)
    none = SlicedWeights(compositions.pixel_owners(spark.createDataFrame([], "comp_id string, x int, y int, t0 double, t1 double")))
    assert none.pixel_weights().count() == 0
    assert [(x.x, x.y, x.owners) for x in none.draw(log).collect()] == [(3, 4, None)]
    assert sliced(spark, pixels).draw(log.where("false")).count() == 0
    with pytest.raises(ValueError, match="median"):
        sliced(spark, pixels, how="median")
