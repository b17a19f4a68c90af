"""Exact ranks against numpy, correlations of hundreds of columns, calibration and its inverse, boosting by folds."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import evaluation, learning, ranks, training

ROWS = "g string, i int, v double"


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = [("a", i, float(rng.choice([0, 1, 1, 1, 2.5, -3, i]))) for i in range(400)] + [("b", i, rng.gauss(0, 1)) for i in range(57)] + [("c", 0, 4.0)]
    rows += [("a", 1000, None), ("b", 1000, float("nan")), ("d", 0, None), ("a", 1001, -0.0)]
    return spark.createDataFrame(rows, ROWS).repartition(5)


def of(values, g):
    return sorted(r.v for r in values.collect() if r.g == g and r.v is not None and not math.isnan(r.v))


def test_quantiles_equal_numpy(values):
    at = [0.0, 0.1, 0.29, 0.5, 0.99, 1.0]
    found = ranks.quantiles(values, "v", at, ("g",)).collect()
    assert len(found) == 3 * len(at)
    for r in found:
        assert r.value == pytest.approx(float(np.quantile(of(values, r.g), at[r.i])))
    whole = {r.i: r.value for r in ranks.quantiles(values, "v", at).collect()}
    everything = of(values, "a") + of(values, "b") + of(values, "c")
    assert whole == pytest.approx({i: float(np.quantile(everything, q)) for i, q in enumerate(at)})
    assert ranks.quantiles(values.where("false"), "v", at).count() == 0


def test_no_task_sees_all_values(spark):
    rows = spark.range(20_000).select(F.col("id").cast("double").alias("v"))
    counted = ranks.counted_ranks(rows, "v")
    assert counted.where("below = value and n = 20000 and k = 1").count() == 20_000
    parts = ranks.counted_ranks(rows, "v").select(F.floor(F.col("below") / 100)).distinct().count()
    assert parts == 200


def test_percentile_ranks_average_ties(values):
    for r in ranks.percentile_ranks(values, "v", "p", ("g",)).collect():
        if r.v is None or math.isnan(r.v):
            assert r.p is None
        else:
            own = of(values, r.g)
            assert r.p == pytest.approx((sum(x < r.v for x in own) + (sum(x == r.v for x in own) + 1) / 2) / len(own))


def test_percentiles_equal_digitized_edges(values):
    for r in ranks.percentiles(values, "v", "p", ("g",)).collect():
        if r.v is None or math.isnan(r.v):
            assert r.p is None
        else:
            edges = np.nanpercentile(of(values, r.g), np.arange(101))
            assert abs(r.p - (np.digitize(r.v, edges) - 1) / 100) < 1e-9 or np.isclose(edges, r.v, rtol=1e-12).any()


def test_bucket_counts_cuts_below(spark):
    for cuts in ([], [1.0], [0.0, 1.0, 1.0, 2.0, 5.0], [float(c) for c in range(200)]):
        rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, 4.9, 5.0, 150.5, 1e9)], "v double")
        for r in rows.select("v", ranks.bucket(F.col("v"), cuts).alias("b")).collect():
            assert r.b == sum(c <= r.v for c in cuts)
        nothing = spark.createDataFrame([(None,)], "v double").select(ranks.bucket(F.col("v"), cuts).alias("b")).first().b
        assert nothing == len(cuts)


def test_histogram_closes_the_last_bin(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (3.999, 5.0), (None, 1.0), (1.0, float("nan"))], "x double, y double")
    found = {(r.x_bin, r.y_bin): r.n for r in ranks.two_dimensional_histogram(rows, "x", "y", 4).collect()}
    assert found == {(0, 0): 1, (1, 0): 1, (2, 0): 1, (3, 0): 2}


def test_correlations_of_584_columns(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 20))
    table = np.concatenate([base @ rng.normal(size=(20, 300)), rng.normal(size=(300, 282)), np.full((300, 1), 0.1), np.zeros((300, 1))], axis=1)
    names = [f"c{i:03d}_t_0_{i % 3}" for i in range(584)]
    rows = spark.createDataFrame([table[i].tolist() for i in range(300)], ", ".join(f"{n} double" for n in names))
    found = training.correlation_matrix(rows, names)
    got = {(r.a, r.b): r.correlation for r in found.collect()}
    with np.errstate(invalid="ignore"):
        want = np.nan_to_num(np.corrcoef(table.T))
    want[582:, :] = want[:, 582:] = 0
    assert len(got) == 584 * 583 // 2
    assert max(abs(got[names[i], names[j]] - want[i, j]) for i in range(584) for j in range(i + 1, 584)) < 1e-9
    assert training.correlation_matrix(rows.limit(0), names[:3]).count() == 0
    assert [r.correlation for r in training.correlation_matrix(rows.limit(1), names[:2]).collect()] == [0.0]


def test_percentile_slopes_by_hand(spark):
    # the percentiles of 0 to 100 are the values themselves over 100; c: attribution 2 p; d: flat but for noise; e: two rows
    rows = [("c", b, "v", float(b), 2 * b / 100) for b in range(0, 101, 2)] + [("d", b, "v", float(b), float((b // 2) % 2)) for b in range(1, 101, 2)]
    rows += [("e", 1, "w", 1.0, 1.0), ("e", 2, "w", 3.0, 2.0), ("f", 1, "z", 0.0, 3.0), ("f", 2, "z", 0.0, 5.0), ("f", 3, "z", 0.0, 7.0)]
    frame = spark.createDataFrame(rows, "comp_id string, bin int, variable string, value double, attribution double")
    found = {(r.comp_id, r.variable): r for r in evaluation.percentile_slopes(frame, ["comp_id"]).collect()}
    assert found["c", "v"].slope == pytest.approx(2.0) and found["c", "v"].error_share == pytest.approx(0, abs=1e-6) and found["c", "v"].good
    x, y = np.arange(1, 101, 2) / 100, np.array([float((b // 2) % 2) for b in range(1, 101, 2)])
    slope, base = np.polyfit(x, y, 1)
    error = math.sqrt(((y - slope * x - base) ** 2).sum() / (len(x) - 2)) / y.std()
    assert found["d", "v"].slope == pytest.approx(slope) and found["d", "v"].error_share == pytest.approx(error) and found["d", "v"].good == (error <= 1)
    assert found["e", "w"].error_share is None and not found["e", "w"].good
    assert found["f", "z"].slope is None and not found["f", "z"].good  # one percentile, the highest, for equal values


def test_calibration_finds_its_curve_and_inverts_it(spark):
    true = learning.Calibration(x_break=7200.0, y_break=5400.0, x_end=72000.0, y_end=40000.0, least=300.0)
    truth = np.linspace(learning._scale(0.0), learning._scale(72000.0), 44)
    points = spark.createDataFrame([(i, float(x), float(y), 5) for i, (x, y) in enumerate(zip(truth, true.curve(truth), strict=True))], "bin int, x double, y double, n int")
    found = learning.fit_calibration(points, 72000.0, 300.0, 40000.0, (1080.0, 18000.0), (1800.0, 14400.0))
    assert found.x_break == pytest.approx(7200.0, rel=0.02) and found.y_break == pytest.approx(5400.0, rel=0.02)
    # a prediction that lies on the curve comes back as its truth
    seconds = [0.0, 10.0, 600.0, 5000.0, 7200.0, 30000.0, 72000.0]
    predicted = [float(10 ** (true.curve(np.array([learning._scale(s)]))[0] + 1.5) - 100) for s in seconds]
    rows = spark.createDataFrame([(s, p) for s, p in zip(seconds, predicted, strict=True)] + [(-1.0, 0.0), (-2.0, 1e7)], "true_s double, pred_s double")
    back = {r.true_s: r.pred_s for r in learning.calibrated(rows, true, 20_001).collect()}
    for s in seconds:
        assert back[s] == pytest.approx(s, rel=2e-4 if s == 7200.0 else 1e-6, abs=1e-3)  # the break lies between two knots
    assert back[-1.0] == pytest.approx(0.0, abs=1e-6) and back[-2.0] == pytest.approx(72000.0)


def test_interpolation_equals_numpy(spark):
    xs, ys = [0.0, 1.0, 1.0, 4.0], [5.0, 6.0, 8.0, 2.0]
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.25, 0.999, 1.5, 4.0, 9.0, None)], "v double")
    for r in rows.select("v", learning.interpolated(F.col("v"), xs, ys).alias("y")).collect():
        assert r.y is None if r.v is None else r.y == pytest.approx(float(np.interp(r.v, xs, ys)))


def test_median_curve_leaves_outliers_out(spark):
    rows = [(0.0, 10.0), (0.0, 20.0), (0.0, 30.0), (0.0, 5000.0), (900.0, 400.0), (900.0, 1e6)]
    found = learning.median_curve(spark.createDataFrame(rows, "true_s double, pred_s double"), 3600.0, 3.5, 2).orderBy("bin").collect()
    lo, hi = math.log10(100) - 1.5, (math.log10(1000) - 1.5) * 1.01
    step = (hi - lo) / 2
    assert [(r.bin, r.n) for r in found] == [(0, 3), (1, 1)]
    assert [(r.x, r.y) for r in found] == [pytest.approx((lo + step / 2, math.log10(120) - 1.5)), pytest.approx((lo + 1.5 * step, math.log10(500) - 1.5))]


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(24):
        for b in range(15):
            x, noise = rng.uniform(-1, 1), rng.normal()
            rows.append((f"c{c}", b, float(x), float(noise), float(x > 0.2) + 0.05 * float(rng.normal()), 1.0))
    return spark.createDataFrame(rows, "comp_id string, bin int, x double, noise double, target double, weight double")


def test_cross_fitting_predicts_every_row_by_a_model_that_has_not_seen_it(learnable):
    predictions, losses = learning.cross_fitted(learnable, ["x", "noise"], folds=2, rounds=8, depth=2)
    joined = learnable.join(predictions, ["comp_id", "bin"])
    assert predictions.count() == learnable.count() == joined.count()
    assert predictions.groupBy("comp_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert joined.agg(F.corr("target", "prediction")).first()[0] > 0.9
    rounds = {}
    for r in losses.collect():
        rounds.setdefault((r.fold, r.part), {})[r["round"]] = r.loss
    for (_, part), by in rounds.items():
        assert sorted(by) == list(range(1, len(by) + 1)) and (part == "held" or by[len(by)] <= by[1])


def test_classification_by_folds(learnable):
    labelled = learnable.withColumn("target", (F.col("x") > 0.2).cast("double"))
    predictions, losses = learning.cross_fitted(labelled, ["x", "noise"], "classification", folds=2, rounds=4, depth=2)
    joined = labelled.join(predictions, ["comp_id", "bin"])
    assert joined.where("prediction between 0 and 1").count() == labelled.count()
    assert joined.where("(prediction > 0.5) = (target = 1)").count() > 0.95 * labelled.count()
    assert losses.count() >= 2 * 2


def test_down_sampling_takes_what_is_asked_whatever_the_partitions(spark):
    rows = spark.range(3000).select(F.concat(F.lit("c"), F.col("id") % 40).alias("comp_id"), F.col("id").cast("int").alias("bin"), F.lit("x").alias("more"))
    split = training.split_by_ids(rows, spark.createDataFrame([("c1",), ("c2",), ("c2",), ("none",)], "comp_id string"))
    assert split.where("is_test").count() == 150 and split.count() == 3000
    few = training.down_sampled(split, 500, 20)
    assert {r.is_test: r.n for r in few.groupBy("is_test").agg(F.count("*").alias("n")).collect()} == {True: 20, False: 500}
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, training.down_sampled(split.repartition(9), 500, 20).collect()))
    assert training.down_sampled(split, 10_000, 10_000).count() == 3000 and training.down_sampled(split.where("false"), 5, 5).count() == 0


def test_components_for_shares(spark):
    explained = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.15), (3, 0.02)], "component int, explained double")
    found = {r.share: (r.n_components, r.reached) for r in learning.components_for(explained, [0.5, 0.79, 0.95, 0.99]).collect()}
    assert found[0.5] == (1, 0.5) and found[0.79][0] == 2 and found[0.95][0] in (3, 4) and found[0.99] == (None, None)
