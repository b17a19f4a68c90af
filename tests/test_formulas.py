"""Figures computed by hand from the surveyed formulas, on the smallest tables that tell them from similar ones."""

from __future__ import annotations

import math

import pytest

from pyspark.sql import functions as F

from pixelloom.operators import complexity, compositions, evaluation, series, state, transitions, users

STAYS = "comp_id string, x int, y int, color int, beg double, end double, t0 double, t1 double"


def stays_of(spark, *pixels):
    """Pixels as lists of (color, beginning), the last stay ending at 600."""
    rows = []
    for x, held in enumerate(pixels):
        for (color, beg), (_, end) in zip(held, [*held[1:], (None, 600.0)], strict=True):
            rows.append(("c", x, 0, color, float(beg), float(end), 0.0, 600.0))
    return spark.createDataFrame(rows, STAYS)


def test_variances_and_autocorrelations(spark):
    # bins of 100: the first pixel shows 75 / 25 / 0 and then 50 / 0 / 50, the second always one colour
    times = state.color_time(stays_of(spark, [(1, 0), (2, 75), (1, 100), (3, 150)], [(1, 0)]), 100.0)
    var = {r.bin: r for r in state.color_variances(times).collect()}[2]
    assert (var.var_inverse, var.var_multinomial, var.var_subdominant) == pytest.approx((1 / 0.75, 0.25, 0.125))
    auto = {r.bin: r for r in state.color_autocorrelation(times).collect()}
    assert 1 not in auto
    assert (auto[2].autocorr_multinomial, auto[2].dissimilarity, auto[2].autocorr_subdominant) == pytest.approx((0.625 / 2, 0.1875 / 2, 0.0))
    # the third bin: the first pixel all colour 3 after 50 / 0 / 50
    assert (auto[3].autocorr_multinomial, auto[3].dissimilarity, auto[3].autocorr_subdominant) == pytest.approx((0.25, 0.125, 0.0))


def test_unrestored_attacks_count_with_the_total_time(spark):
    # reference 1; the first pixel begins off it, comes to it at 10, is attacked at 20 (again at 30), restored at 50, attacked at 70 for good
    stays = stays_of(spark, [(5, 0), (1, 10), (2, 20), (3, 30), (1, 50), (2, 70)], [(2, 0), (3, 5), (1, 15)], [(2, 0)], [(1, 0)])
    constant = spark.createDataFrame([("c", x, 0, 1) for x in range(4)], "comp_id string, x int, y int, ref_const int")
    flips = state.attack_flips(stays, constant, 1000.0)
    assert sorted((r.x, r.beg, r.duration) for r in flips.collect()) == [(0, 20.0, 30.0), (0, 70.0, 1000.0), (1, 5.0, 10.0)]
    found = {r.bin: r for r in state.return_times(flips, 60.0).collect()}
    assert (found[1].n, found[1].mean, found[1].median_ln2) == pytest.approx((2, 20.0, 20.0 / math.log(2)))
    assert (found[2].n, found[2].mean, found[2].median_ln2) == pytest.approx((1, 1000.0, 1000.0 / math.log(2)))


def test_return_time_follows_the_reference_of_each_bin(spark):
    stays = stays_of(spark, [(1, 0), (2, 150), (1, 180), (2, 250)])
    refs = spark.createDataFrame([("c", 0, 0, b, r) for b, r in ((1, 1), (2, 1), (3, 2), (4, 1), (5, 2))], "comp_id string, x int, y int, bin int, ref int")
    found = {r.bin: r.return_time for r in state.windowed_return_times(stays, state.instant_images(stays, 100.0), refs, 100.0, 2).collect()}
    # 1: never lost, so lost and got at the beginning; 2: lost at 150, back at 180; 3: colour 2 was lost at 180 and is back at 250
    # 4: colour 1 is lost since 250 and it is 400 now; 5: colour 2 was last lost at 180, before the window
    assert found == {1: 0.0, 2: 30.0, 3: 70.0, 4: 150.0, 5: None}
    stats = {r.bin: r for r in state.return_time_stats(state.windowed_return_times(stays, state.instant_images(stays, 100.0), refs, 100.0, 2)).collect()}
    assert (stats[4].mean, stats[4].median, stats[5].mean, stats[5].decile_mean) == (150.0, 150.0, 0.0, 0.0)


def test_ranks_over_counts(spark):
    values = [0.0] * 7 + [1.0] * 5 + [2.0] * 3 + [3.0, 4.0, 5.0, 6.0, 7.0]  # twenty: the top decile is 6 and 7
    rows = spark.createDataFrame([("c", 1, x, 0, v) for x, v in enumerate(values)], "comp_id string, bin int, x int, y int, v double")
    high, low = (state.integrated_stats(rows, "v", low=k).first() for k in (False, True))
    assert (high["mean"], high["median"], high["percentile"], high["decile_mean"]) == (pytest.approx(sum(values) / 20), 1.0, 6.0, 6.5)
    assert (low["percentile"], low["decile_mean"]) == (0.0, 0.0)


def series_of(spark, values, ahead=None, comp="c", width=100.0, unsettled=()):
    """A series of bins from 1, with ratios to the mean of four; the forward variable is the same unless given."""
    ahead = values if ahead is None else ahead
    frame = spark.createDataFrame([(comp, i + 1, v, f) for i, (v, f) in enumerate(zip(values, ahead, strict=True))], "comp_id string, bin int, val double, fwd double")
    rows = series.ratio_to_mean(frame, 4, ["comp_id"])
    forward = series.ratio_to_mean(frame.select("comp_id", "bin", F.col("fwd").alias("val")), 4, ["comp_id"]).select("comp_id", "bin", F.col("val").alias("fwd_val"), F.col("ratio").alias("fwd_ratio"))
    return rows.join(forward, ["comp_id", "bin"]).withColumns({"t": F.col("bin") * width, "settled": ~F.col("bin").isin(list(unsettled))})


def spans(rows, relative=1.5, reach=1000, greyout=float("inf")):
    found = transitions.find_transitions(rows, F.lit(0.5), F.lit(relative), 4, ["comp_id"], reach, greyout)
    return [(r.bin_beg, r.bin_end) for r in found.orderBy("trans_idx").collect()]


def test_transition_ends_with_the_later_of_calm_and_run(spark):
    low = [0.1] * 6
    # the run of bins 7 and 8 ends before 9; calm is in sight from 9 on, and with a forward variable that is calm at once the run itself decides
    assert spans(series_of(spark, [*low, 0.9, 0.8, *low])) == [(7, 9)]
    assert spans(series_of(spark, [*low, 0.9, 0.8, *low], [0.1] * 14)) == [(7, 9)]
    # the forward variable stays high until bin 11: the transition lasts until then, though the run is over
    late = [*low, 0.9, 0.8, 0.9, 0.9, 0.1, 0.1, 0.1, 0.1]
    assert spans(series_of(spark, [*low, 0.9, 0.8, *low], late)) == [(7, 11)]
    # no calm within reach: the run's own end, or the reach if that is sooner
    high = [*low, *[0.9] * 8]
    assert spans(series_of(spark, [*low, 0.9, 0.8, *low], high)) == [(7, 9)]
    assert spans(series_of(spark, [*low, 0.9, 0.8, *low], late), reach=3) == [(7, 9)]
    assert spans(series_of(spark, [*low, 0.9, 0.8, *low], high), reach=1) == [(7, 8)]
    # a forward ratio below 1 / 1.5 is calm, too: 0.55 after a mean of 0.9
    assert spans(series_of(spark, [*low, 0.9, 0.8, *low], [*[0.9] * 8, 0.55, *[0.9] * 5])) == [(7, 9)]


def test_transition_starts(spark):
    low = [0.1] * 6
    # a window into life is late enough: bin 4 of a window of four, not bin 3
    assert spans(series_of(spark, [0.1, 0.1, 0.1, 0.9, 0.1, 0.1])) == [(4, 5)]
    assert spans(series_of(spark, [0.1, 0.1, 0.9, 0.1, 0.1, 0.1])) == []
    # not while borders have just changed
    assert spans(series_of(spark, [*low, 0.9, 0.8, *low], unsettled=[7])) == [(8, 9)]
    # the bin after the first must end before the greyout
    assert spans(series_of(spark, [*low, 0.9, 0.8, *low]), greyout=800.0) == []
    assert spans(series_of(spark, [*low, 0.9, 0.8, *low]), greyout=801.0) == [(7, 9)]
    assert spans(series_of(spark, [*low, 0.9]), greyout=700.0) == [] and spans(series_of(spark, [*low, 0.9]), greyout=701.0) == [(7, 8)]


def test_runs_exactly_a_window_apart_merge(spark):
    runs = spark.createDataFrame([("c", 3, 5), ("c", 8, 9), ("c", 13, 14)], "comp_id string, beg int, fin int")
    merged = lambda gap: [(r.bin_beg, r.bin_end) for r in transitions.merge_close(runs, gap, ["comp_id"]).orderBy("trans_idx").collect()]
    assert merged(3) == [(3, 9), (13, 14)] and merged(2) == [(3, 5), (8, 9), (13, 14)] and merged(4) == [(3, 14)]


def pixels_of(spark, *borders):
    """Rows of (comp_id, xs, t0, t1): one pixel for each x."""
    rows = [(c, s, x, 0, float(t0), float(t1)) for s, (c, xs, t0, t1) in enumerate(borders) for x in xs]
    return spark.createDataFrame(rows, "comp_id string, seq int, x int, y int, t0 double, t1 double")


def test_stable_borders_break_at_holes_and_moves(spark):
    ten, moved = range(20), range(1, 21)  # 19 of 20 in common
    shapes = [("a", ten, 0, 10), ("a", moved, 10, 20), ("a", ten, 25, 30), ("a", range(3, 23), 30, 40), ("b", ten, 0, 10), ("b", ten, 10, 20)]
    pixels = pixels_of(spark, *shapes)
    borders = pixels.select("comp_id", "seq", "t0", "t1").distinct()
    found = sorted((r.comp_id, r.piece, r.t0, r.t1) for r in compositions.stable_border_ranges(borders, pixels).collect())
    # a: the first two touch and are alike; then a hole; then 17 of 20 in common
    assert found == [("a", 0, 0.0, 20.0), ("a", 1, 25.0, 30.0), ("a", 2, 30.0, 40.0), ("b", 0, 0.0, 20.0)]


def test_location_jump_is_against_the_compositions_own_time(spark):
    pixels = pixels_of(
        spark, ("still", [0, 1], 0, 10), ("still", [0, 1], 10, 20), ("part", [0, 1], 0, 10), ("part", [1, 2], 10, 20), ("jump", [0, 1], 0, 10), ("jump", [5, 6], 10, 20),
        ("hole", [0, 1], 0, 10), ("hole", [1, 2], 15, 20), ("apart", [0], 0, 10), ("apart", [1], 15, 20),
    )
    found = {r.comp_id: r.jumps for r in compositions.location_jumps(pixels).collect()}
    # part: pixel 1 is on throughout, though pixel 0 is on for the first half only
    assert found == {"still": False, "part": False, "jump": True, "hole": False, "apart": True}


def test_overlaps_reject_border_by_border(spark):
    box, other = range(10), range(100, 110)
    pixels = pixels_of(
        spark, ("a", box, 0, 10), ("a", other, 10, 30), ("b", box, 5, 20), ("c", other, 10, 20), ("d", range(200, 210), 0, 5), ("e", range(200, 210), 5, 9), ("f", range(300, 310), 0, 5), ("g", range(300, 310), 0, 5),
    )
    found = sorted((r.comp_id, r.t0, r.t1) for r in compositions.rejected_overlaps(pixels, 0.9).collect())
    # a and b share a box from 5 to 10 only, b is later; a and c begin together, a is longer; d and e never meet; f and g are the same
    assert found == [("b", 5.0, 10.0), ("c", 10.0, 20.0), ("g", 0.0, 5.0)]


def test_centre_has_a_margin(spark):
    sections = spark.createDataFrame([(0, 0.0, 0, 99, 0, 99)], "section int, t_open double, xmin int, xmax int, ymin int, ymax int")
    at = lambda lo, hi: [("c%d_%d" % (lo, hi), 0, x, y, 0.0, 1.0) for x in (lo, hi) for y in (lo, hi)]
    pixels = spark.createDataFrame([*at(40, 46), *at(40, 47), *at(52, 60), *at(53, 60), *at(2, 5), *at(3, 5)], "comp_id string, seq int, x int, y int, t0 double, t1 double")
    found = {r.comp_id: (r.at_border, r.in_corner, r.in_centre) for r in compositions.placement(pixels, sections).collect()}
    # the middle is 49.5: 47 > 46.5 and 52 < 52.5 are within three of it
    assert {c: f[2] for c, f in found.items()} == {"c40_46": False, "c40_47": True, "c52_60": True, "c53_60": False, "c2_5": False, "c3_5": False}
    assert found["c2_5"][:2] == (True, True) and found["c3_5"][:2] == (False, False)


def curve_of(spark, *points):
    """Counts along cuts from (tp, fp) of ten signal and ten background rows."""
    rows = [(i, float(i), tp, fp, 10 - fp, 10 - tp, tp / 10, fp / 10, tp / (tp + fp) if tp + fp else None) for i, (tp, fp) in enumerate(points)]
    return spark.createDataFrame(rows, "i int, cut double, tp long, fp long, tn long, fn long, tpr double, fpr double, purity double")


def test_simpson(spark):
    def area(*points):
        df = spark.createDataFrame([([(float(x), float(y)) for x, y in points],)], "points array<struct<x:double,y:double>>")
        return df.select(evaluation.simpson(F.col("points"))).first()[0]

    square = lambda x: 3 * x * x - 2 * x + 1  # noqa: E731  its integral from 0 is x^3 - x^2 + x
    for xs in ([0, 1, 2], [0, 0.5, 2], [0, 1, 2, 3], [0, 0.25, 1, 3], [0, 1, 1.5, 2, 2.5, 4]):
        assert area(*((x, square(x)) for x in xs)) == pytest.approx(xs[-1] ** 3 - xs[-1] ** 2 + xs[-1])
    assert area((0, 1), (2, 3)) == 4.0 and area((0, 5)) == 0.0
    assert area((0, 1), (0, 2), (3, 4)) == pytest.approx(0.5 * (2 * 1 + 2 * 4))  # a step of no width: only the outer terms stay


def test_partial_area_is_a_share_of_the_limit(spark):
    # one cut at (0.5, 0.5) on the diagonal; the points up to 0.5 are (0, 0), (0, 0), (0.5, 0.5) and once more the end: 0.5, 0.5
    found = evaluation.roc_area(curve_of(spark, (5, 5)), max_fpr=0.5).first()["auc"]
    # pairs: the first two steps (0, 0.5): 0.5 / 6 * (2 * 0 + 2 * 0.5); the odd last step has no width: nothing
    assert found == pytest.approx((0.5 / 6 * 1.0) / 0.5)
    # the whole area: (0,0) (0,0) (.5,.5) (1,1) (1,1): steps 0, .5 and .5, 0
    whole = 0.5 / 6 * (2 * 0 + 2 * 0.5) + 0.5 / 6 * (0.5 * 2 + 1 * 2)
    assert evaluation.roc_area(curve_of(spark, (5, 5))).first()["auc"] == pytest.approx(whole)


def test_precision_recall_from_end_to_end(spark):
    # (0, ?) (0.5, 1) (1, 0.5): the purity before the first warning is that of the first with one
    assert evaluation.precision_recall_area(curve_of(spark, (5, 0))).first()["pr_auc"] == pytest.approx((1 + 4 * 1 + 0.5) / 6)


def predictions_of(spark, *rows):
    return spark.createDataFrame(rows, "comp_id string, bin int, segment int, true_s double, pred_s double")


def test_errors_do_not_cancel(spark):
    rows = predictions_of(spark, ("c", 1, 0, 10.0, 15.0), ("c", 2, 0, 10.0, 5.0), ("c", 3, 0, 0.0, 7.0))
    found = evaluation.relative_errors(rows).first()
    assert (found["mean"], found["rms"], found["n"]) == pytest.approx((0.5, 0.5, 2))
    weighted = evaluation.weighted_errors(rows.withColumn("w", F.col("bin")), F.col("w")).first()
    assert (weighted["mean"], weighted["rms"]) == pytest.approx((0.5, 0.5))


def test_final_runs_count_zero_where_there_is_none(spark):
    rows = predictions_of(
        spark, *(("c", b, 0, 5.0 - b, p) for b, p in enumerate([9.0, 1.0, 9.0, 1.0, 1.0])), *(("c", b, 1, 9.0 - b, p) for b, p in ((5, 1.0), (6, 9.0))), *(("d", b, 0, 40.0 - b, 1.0) for b in range(3))
    )
    starts = evaluation.final_run_starts(rows, 5.0, 12.0)
    assert sorted((r.comp_id, r.segment, r.earliest) for r in starts.collect()) == [("c", 0, 2.0), ("c", 1, 0.0), ("d", 0, 12.0)]
    assert [(r["quantile"], r.earliest, r.n) for r in evaluation.final_run_quantiles(starts, [0.0, 0.5, 1.0]).collect()] == [(0.0, 0.0, 3), (0.5, 2.0, 3), (1.0, 12.0, 3)]


def test_attention_slots_run_to_the_whiteout(spark):
    rows = [("c", u, x, 0, 100.0, 150.0, True) for u, n in ((1, 4), (2, 2), (3, 1)) for x in [0, 1] * n][:14]
    changes = spark.createDataFrame(rows, "comp_id string, user int, x int, y int, t0 double, t1 double, active boolean")
    found = users.attention(changes, 10.0, 200.0).first()
    # ten slots from 100 to 200, though the composition ends at 150; 8, 4 and 2 changes; the two least attentive of two pixels
    assert (found["mean"], found["median"], found["pix_norm"]) == pytest.approx((14 / 30, 0.4, 0.3))
    assert users.attention(changes, 10.0, 200.0, largest=True).first()["pix_norm"] == pytest.approx(0.6)


def test_boxes_from_four_corners(spark):
    # a row of four pixels of one colour on an image of 4 x 4: sizes 1, 2 and 3, all averaged over the four corners
    rows = [("c", 1, x, y, 7 if y == 0 else 1) for x in range(4) for y in range(4)]
    found = {(r.color, r.size): r.n_boxes for r in complexity.touched_boxes_by_corners(spark.createDataFrame(rows, "comp_id string, bin int, x int, y int, color int")).collect()}
    # size 3: from the left and from the right the row falls into boxes of 3 and 1 pixels: two in any grid
    assert {k: v for k, v in found.items() if k[0] == 7} == {(7, 1): 4.0, (7, 2): 2.0, (7, 3): 2.0}
    # the other colour has rows 1 to 3: from the top corners rows {1, 2} and {3}, from the bottom ones all three in one box
    assert found[1, 3] == (4 + 2 + 2 + 4) / 4 and found[1, 2] == 4.0


def test_uniform_changes_are_as_dense_as_chance(spark):
    pixels = spark.createDataFrame([("c", x, y) for x in range(30) for y in range(30)] + [("d", 0, 0)], "comp_id string, x int, y int")
    reference = complexity.random_ripley(pixels, [2.0, 5.0], points=60, trials=5)
    uniform = [("c", b, 1000 * b + i, (i * 7919 + b * 13) % 30, (i * 104729 // 7 + b * 17) % 30) for b in range(1, 9) for i in range(90)]
    tight = [("c", 20, 50_000 + i, i % 3, i // 3 % 3) for i in range(50)]
    points = spark.createDataFrame([*uniform, *tight, ("c", 30, 1, 5, 5)], "comp_id string, bin int, event_id long, x int, y int")
    found = {r.bin: r for r in complexity.normalised_ripley(complexity.ripley(points, [2.0, 5.0]), reference, 2).collect()}
    assert 0.7 < sum(found[b].ripley_norm_1 for b in range(1, 9)) / 8 < 1.3 and 0.9 < sum(found[b].distance_norm for b in range(1, 9)) / 8 < 1.1
    assert found[20].ripley_norm_1 > 5 and found[20].distance_norm < 0.3
    assert found[30].ripley_0 is None and found[30].distance_norm is None
