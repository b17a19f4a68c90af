"""Models on the training table with Spark's own library, and small fits on aggregates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.functions.columns import hash_unit
from pixelloom.operators import ranks
from pixelloom.operators.training import restored, transformed


def _fit(train: DataFrame, names: list[str], kind: str, rounds: int, depth: int, rate: float, patience: float, seed: int):
    """A boosted model with early stopping on the rows that are marked `held`, and its loss after each round on either part."""
    trees = {"regression": GBTRegressor, "classification": GBTClassifier}[kind]
    made = trees(
        featuresCol="features", labelCol="target", weightCol="weight", validationIndicatorCol="held", validationTol=patience, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed
    )
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(train)
    model = made.fit(vectors)
    loss = {"regression": ("squared",), "classification": ()}[kind]
    parts = [(name, vectors.where("held" if name == "held" else "not held")) for name in ("fitted", "held")]
    errors = [(name, i, float(e)) for name, part in parts for i, e in enumerate(model.evaluateEachIteration(part, *loss), 1)]
    return model, errors


def boosted_predictions(train: DataFrame, rows: DataFrame, names: list[str], rounds: int = 8, depth: int = 4, seed: int = 1) -> DataFrame:
    """`(comp_id, bin, true_s, pred_s)` of boosted trees on the transformed target `target`, weighted by `weight`."""
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTRegressor(featuresCol="features", labelCol="target", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed).fit(assembler.transform(train))
    found = model.transform(assembler.transform(rows))
    return found.select("comp_id", "bin", F.col("label").cast("double").alias("true_s"), (F.pow(F.lit(10.0), F.col("prediction") + 1.5) - 100).alias("pred_s"))


def cross_fitted(
    rows: DataFrame, names: list[str], kind: str = "regression", folds: int = 3, held_share: float = 0.2,
    rounds: int = 20, depth: int = 4, rate: float = 0.2, patience: float = 0.01, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Predictions for all compositions by models that haven't seen them, and each model's loss after each round.

    Compositions are dealt into `folds` by hash. A fold is predicted by a model fitted on the others, of whose compositions `held_share` are held
    out to stop early, when a round improves their loss by less than `patience`. Predictions: (comp_id, bin, fold, prediction), on the scale of
    `target`, or the probability of target 1 for `classification`. Losses: (fold, part, round, loss). rows: comp_id, bin, target, weight and the features, without nulls.
    """
    dealt = rows.withColumn("fold", F.floor(hash_unit(F.col("comp_id"), seed=seed) * folds).cast("int"))
    predictions, errors = [], []
    for fold in range(folds):
        held = hash_unit(F.col("comp_id"), seed=seed + 1000 + fold) < held_share
        model, losses = _fit(dealt.where(F.col("fold") != fold).withColumn("held", held), names, kind, rounds, depth, rate, patience, seed)
        found = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(dealt.where(F.col("fold") == fold)))
        value = F.col("prediction") if kind == "regression" else F.get(vector_to_array("probability"), F.lit(1))
        predictions.append(found.select("comp_id", "bin", "fold", value.alias("prediction")))
        errors += [(fold, *e) for e in losses]
    whole = predictions[0]
    for more in predictions[1:]:
        whole = whole.unionByName(more)
    return whole, rows.sparkSession.createDataFrame(errors, "fold int, part string, round int, loss double")


def weighted_components(rows: DataFrame, names: list[str], k: int) -> DataFrame:
    """`(component, explained)`: shares of variance of the principal components of the features, standardised by weighted mean and deviation and scaled by the root of the weight."""
    total = F.sum("weight")
    means = rows.agg(*(x for n in names for x in ((F.sum(F.col("weight") * F.col(n)) / total).alias(f"m_{n}"), (F.sum(F.col("weight") * F.col(n) * F.col(n)) / total).alias(f"q_{n}")))).first()
    scaled = {n: F.sqrt("weight") * (F.col(n) - means[f"m_{n}"]) / max(float(np.sqrt(max(means[f"q_{n}"] - means[f"m_{n}"] ** 2, 0.0))), 1e-9) for n in names}
    vectors = VectorAssembler(inputCols=names, outputCol="raw").transform(rows.withColumns(scaled))
    model = PCA(k=k, inputCol="raw", outputCol="components").fit(vectors)
    shares = [(i, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    return rows.sparkSession.createDataFrame(shares, "component int, explained double")


def components_for(explained: DataFrame, shares: list[float]) -> DataFrame:
    """`(share, n_components, reached)`: the fewest components, in order, that explain each share of the variance; null if all of them don't. explained: of `weighted_components`."""
    order = Window.orderBy("component")  # as many rows as components
    summed = explained.withColumn("reached", F.sum("explained").over(order))
    asked = explained.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    near = asked.join(F.broadcast(summed), F.col("reached") >= F.col("share"), "left")
    return near.groupBy("share").agg((F.min("component") + 1).alias("n_components"), F.min("reached").alias("reached"))


def standardised(rows: DataFrame, names: list[str]) -> DataFrame:
    """Features with mean 0 and deviation 1, as an array `scaled`."""
    vectors = VectorAssembler(inputCols=names, outputCol="raw").transform(rows)
    model = StandardScaler(inputCol="raw", outputCol="out", withMean=True).fit(vectors)
    return model.transform(vectors).select("comp_id", "bin", vector_to_array("out").alias("scaled"))


def calibration_points(predictions: DataFrame, width: float, most_off: float) -> DataFrame:
    """Median prediction and rows in bins of truth, predictions more than `most_off` away left out."""
    near = predictions.where(F.abs(F.col("pred_s") - F.col("true_s")) <= most_off)
    return near.groupBy(F.floor(F.col("true_s") / width).cast("int").alias("bin")).agg(F.avg("true_s").alias("x"), F.expr("percentile(pred_s, 0.5)").alias("y"), F.count("*").alias("n"))


def median_curve(predictions: DataFrame, slack: float, factor: float, bins: int = 44) -> DataFrame:
    """`(bin, x, y, n)` on the transformed scale: the median prediction in equal bins of truth, from the least to 1.01 times the greatest, `x` being a bin's middle.

    Outliers, whose prediction is not below `slack` + `factor` times the truth, are left out; empty bins have no row.
    """
    kept = predictions.where(F.col("pred_s") < slack + factor * F.col("true_s")).select(transformed(F.col("true_s")).alias("t"), transformed(F.col("pred_s")).alias("p"))
    ends = kept.agg(F.min("t").alias("lo"), (F.max("t") * 1.01).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(step > 0, F.least(F.floor((F.col("t") - F.col("lo")) / step), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    placed = kept.join(F.broadcast(ends)).select(at.alias("bin"), (F.col("lo") + (at + 0.5) * step).alias("x"), "p")  # one row of two numbers
    return placed.groupBy("bin", "x").agg(F.expr("percentile(p, 0.5)").alias("y"), F.count("*").alias("n"))


@dataclass(frozen=True)
class Calibration:
    """A curve of two straight pieces on the transformed scale, from (0, least) over a break to (`x_end`, `y_end`); truth and prediction in seconds."""

    x_break: float
    y_break: float
    x_end: float
    y_end: float
    least: float

    def curve(self, t: np.ndarray) -> np.ndarray:
        """Expected transformed prediction for a transformed truth; all lengths are counted from the transformed zero."""
        zero = _scale(0.0)
        t, xb, yb, low = t - zero, _scale(self.x_break) - zero, _scale(self.y_break) - zero, _scale(self.least) - zero
        xe, ye = _scale(self.x_end) - zero, _scale(self.y_end) - zero - low
        return np.where(t < xb, low + yb * t / xb, low + yb + (ye - yb) / (xe - xb) * (t - xb)) + zero

    def knots(self, n: int = 100) -> tuple[list[float], list[float]]:
        """Transformed predictions, rising, and the transformed truths that they stand for."""
        truth = np.linspace(_scale(0.0), _scale(self.x_end), n)
        expected = np.maximum.accumulate(self.curve(truth))
        return expected.tolist(), truth.tolist()


def _scale(v: float) -> float:
    return float(np.log10(v + 100) - 1.5)


def fit_calibration(
    points: DataFrame, x_end: float, least: float, greatest: float, x_bounds: tuple[float, float], y_bounds: tuple[float, float]
) -> Calibration:
    """The two-piece curve nearest to the points of `median_curve`, some dozens, with the break within bounds (seconds); `least`, `greatest`: the extremes of the kept predictions.

    For a given place of the break its height is a linear least-squares problem; the place is searched on a grid that is refined around the best.
    """
    rows = points.select("x", "y").collect()
    t, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    zero, low = _scale(0.0), _scale(least) - _scale(0.0)
    xe, ye = _scale(x_end) - zero, _scale(greatest) - zero - low
    span = [_scale(b) - zero for b in y_bounds]

    def best_height(xb: float) -> tuple[float, float]:
        s = t - zero
        rest = np.where(s < xb, 0.0, ye * (s - xb) / (xe - xb))
        slope = np.where(s < xb, s / xb, 1 - (s - xb) / (xe - xb))
        want = y - zero - low - rest
        yb = float(np.clip((slope @ want) / (slope @ slope) if slope.any() else span[0], *span))
        return float(((want - slope * yb) ** 2).sum()), yb

    lo, hi = (_scale(b) - zero for b in x_bounds)
    for _ in range(12):
        grid = np.linspace(lo, hi, 33)
        at = int(np.argmin([best_height(x)[0] for x in grid]))
        lo, hi = grid[max(0, at - 1)], grid[min(32, at + 1)]
    xb = float((lo + hi) / 2)
    back = lambda v: float(10 ** (v + zero + 1.5) - 100)
    return Calibration(back(xb), back(best_height(xb)[1]), x_end, greatest, least)


def interpolated(value: Column, xs: list[float], ys: list[float]) -> Column:
    """The piecewise-linear function through the knots, whose `xs` don't fall; its ends beyond them. A range look-up among as many knots as there are, by halving."""
    at = ranks.bucket(value, xs)
    x, y = (F.array(*(F.lit(float(v)) for v in k)) for k in (xs, ys))
    x0, x1, y0, y1 = F.get(x, at - 1), F.get(x, at), F.get(y, at - 1), F.get(y, at)
    inside = F.when(x1 > x0, y0 + (y1 - y0) * (value - x0) / F.when(x1 > x0, x1 - x0)).otherwise(y0)
    return F.when(value.isNull() | F.isnan(value), value).when(at == 0, F.lit(float(ys[0]))).when(at == len(xs), F.lit(float(ys[-1]))).otherwise(inside)


def calibrated(predictions: DataFrame, curve: Calibration, knots: int = 100) -> DataFrame:
    """`predictions` with `pred_s` replaced by the truth whose expected prediction it is: the interpolated inverse of the curve, from 0 to its end."""
    expected, truth = curve.knots(knots)
    return predictions.withColumn("pred_s", restored(interpolated(transformed(F.col("pred_s")), expected, truth)))


def decay_times(survivors: DataFrame, start: float = 1e5) -> DataFrame:
    """`(size_class, tau)`: the decay of share = exp(-age / tau) that leaves the least square error, for each class.

    Golden-section search over log tau on the sums of each class; a class is a handful of ages.
    """
    import pandas as pd

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        age, share = group["age"].to_numpy(), group["share"].to_numpy()
        error = lambda t: float(((np.exp(-age / np.exp(t)) - share) ** 2).sum())
        lo, hi, g = np.log(start) - 8, np.log(start) + 8, (np.sqrt(5) - 1) / 2
        for _ in range(80):
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if error(a) < error(b) else (a, hi)
        return pd.DataFrame([[int(group["size_class"].iloc[0]), float(np.exp((lo + hi) / 2))]])

    return survivors.where("share is not null").groupBy("size_class").applyInPandas(fit, "size_class int, tau double")


def convex_hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the hull by monotone chains."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(order: list[tuple[int, int]]) -> list[tuple[int, int]]:
        chain: list[tuple[int, int]] = []
        for p in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return half(points) + half(points[::-1])


def hull_perimeters(pixels: DataFrame) -> DataFrame:
    """`(comp_id, hull)`: length of the convex hull around the corners of a composition's pixels.

    Only each column's lowest and highest pixel can be on the hull, so that is all a group holds.
    """
    import pandas as pd

    ends = pixels.groupBy("comp_id", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        corners = [(x + dx, y) for x, lo, hi in zip(group["x"], group["lo"], group["hi"], strict=True) for dx in (0, 1) for y in (lo, hi + 1)]
        hull = convex_hull(corners)
        length = sum(float(np.hypot(a[0] - b[0], a[1] - b[1])) for a, b in zip(hull, hull[1:] + hull[:1], strict=True))
        return pd.DataFrame([[group["comp_id"].iloc[0], length]])

    return ends.groupBy("comp_id").applyInPandas(measure, "comp_id string, hull double")
