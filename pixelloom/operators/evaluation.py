"""Evaluation of warnings from predictions (comp_id, bin, true_s, pred_s), and of attributions.

A signal is a row whose truth is below `truth`; a prediction below a cut is a warning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.operators import ranks
from pixelloom.operators.transitions import _fire
from pixelloom.plans.components import connected_components


def cuts(predictions: DataFrame, truth: float, quantiles: list[float]) -> list[float]:
    """Distinct quantiles of the predictions of signal and background, in order, from exact ranks. Their number is that of `quantiles`, whatever the rows."""
    rows = ranks.quantiles(predictions.select((F.col("true_s") < truth).alias("s"), "pred_s"), "pred_s", quantiles, ("s",)).collect()
    return sorted({round(r["value"], 6) for r in rows})


def _rate(a, b):
    return F.when(b > 0, a / F.when(b > 0, b))


def threshold_counts(predictions: DataFrame, truth: float, at: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """TP, FP, TN, FN and rates at each cut: rows are counted once by the cuts they are below, then summed along the cuts."""
    counts = predictions.groupBy(*by, ranks.bucket(F.col("pred_s"), at).alias("i")).agg(
        F.sum((F.col("true_s") < truth).cast("long")).alias("s"), F.sum((F.col("true_s") >= truth).cast("long")).alias("b")
    )
    keys = predictions.select(*by).distinct() if by else None
    grid = predictions.sparkSession.createDataFrame(list(enumerate(map(float, at))) + [(len(at), float("inf"))], "i int, cut double")
    every = keys.join(F.broadcast(grid)) if by else grid
    filled = every.join(counts, [*by, "i"], "left").na.fill(0, ["s", "b"])
    upto = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("i")  # as many rows as cuts
    whole = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = filled.withColumns({"tp": F.sum("s").over(upto), "fp": F.sum("b").over(upto), "ps": F.sum("s").over(whole), "nb": F.sum("b").over(whole)}).where(F.col("i") < len(at))
    tp, fp, ps, nb = (F.col(c) for c in ("tp", "fp", "ps", "nb"))
    return summed.select(
        *by, "i", "cut", "tp", "fp", (nb - fp).alias("tn"), (ps - tp).alias("fn"), _rate(tp, ps).alias("tpr"), _rate(fp, nb).alias("fpr"),
        _rate(tp, tp + fp).alias("purity"), _rate(2 * tp, 2 * tp + fp + ps - tp).alias("f1"), _rate(tp + nb - fp, ps + nb).alias("accuracy"),
    )


def simpson(points: Column) -> Column:
    """Integral of y over x by Simpson's rule for uneven steps; `points` is an array of (x, y) in order.

    Pairs of steps are parabolas; the last of an odd number of steps takes the parabola through the point before it (Cartwright's correction). A single step is a
    trapezoid. Terms that would divide by a step of no width are left out.
    """
    n = F.size(points)
    x, y = (lambda k: F.get(points, k)["x"]), (lambda k: F.get(points, k)["y"])
    over = lambda a, b: F.when(b != 0, a / F.when(b != 0, b)).otherwise(0.0)

    def panel(k: Column) -> Column:
        a, b = x(k + 1) - x(k), x(k + 2) - x(k + 1)
        ratio, both = over(a, b), a + b
        return both / 6 * (y(k) * (2 - over(F.lit(1.0), ratio)) + y(k + 1) * both * over(both, a * b) + y(k + 2) * (2 - ratio))

    def last(k: Column) -> Column:
        a, b = x(k + 1) - x(k), x(k + 2) - x(k + 1)
        return over(2 * b * b + 3 * a * b, 6 * (a + b)) * y(k + 2) + over(b * b + 3 * a * b, 6 * a) * y(k + 1) - over(b * b * b, 6 * a * (a + b)) * y(k)

    paired = F.when(n % 2 == 1, n - 1).otherwise(n - 2)
    begins = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), lambda k: (k % 2 == 0) & (k + 2 <= paired))
    sum_ = F.aggregate(begins, F.lit(0.0), lambda total, k: total + panel(k))
    step = (x(F.lit(1)) - x(F.lit(0))) * (y(F.lit(0)) + y(F.lit(1))) / 2
    return F.when(n < 2, 0.0).when(n == 2, step).when(n % 2 == 1, sum_).otherwise(sum_ + last(n - 3))


def _curve(counts: DataFrame, by: tuple[str, ...], x: Column, y: Column) -> DataFrame:
    """`points` of (x, y) along the cuts: an array as long as there are cuts."""
    gathered = F.array_sort(F.collect_list(F.struct("i", x.alias("x"), y.alias("y"))))
    return counts.groupBy(*by).agg(F.transform(gathered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def roc_area(counts: DataFrame, by: tuple[str, ...] = (), max_fpr: float = 1.0) -> DataFrame:
    """Area under TPR over FPR from (0, 0) up to `max_fpr`, by Simpson's rule, divided by `max_fpr`.

    The curve has (0, 0) and (1, 1) for the cuts below and above all others, then once more (0, 0) before and the point interpolated at `max_fpr` after the
    points up to there, as in the surveyed work, whose rule of pairs depends on their number. Rates without signal or background are 0.
    """
    zero, one = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    curve = _curve(counts, by, F.coalesce("fpr", F.lit(0.0)), F.coalesce("tpr", F.lit(0.0)))
    curve = curve.select(*by, F.concat(F.array(zero), "points", F.array(one)).alias("points"))
    within = F.filter("points", lambda p: p["x"] <= max_fpr)
    low, high = F.element_at(within, -1), F.get(F.filter("points", lambda p: p["x"] > max_fpr), F.lit(0))
    at = F.when(high.isNull(), low["y"]).otherwise(low["y"] + (high["y"] - low["y"]) * (max_fpr - low["x"]) / (high["x"] - low["x"]))
    end = F.struct(F.lit(max_fpr).alias("x"), at.alias("y"))
    cut = curve.withColumn("points", F.concat(F.array(zero), within, F.array(end)))
    return cut.select(*by, (simpson(F.col("points")) / max_fpr).alias("auc"))


def compare_counts(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train over test of each measure at each cut."""
    names = ["tpr", "fpr", "purity", "f1", "accuracy"]
    other = test.select("i", *(F.col(n).alias(f"o_{n}") for n in names))
    return train.join(other, "i").select("i", "cut", *(_rate(F.col(n), F.col(f"o_{n}")).alias(n) for n in names))


def truth_by_prediction(predictions: DataFrame, per_decade: float) -> DataFrame:
    """Counts in log bins of truth and prediction, and their share of the truth's column."""
    at = lambda c: F.floor(F.log10(F.col(c) + 1) * per_decade).cast("int")
    counts = predictions.groupBy(at("true_s").alias("true_bin"), at("pred_s").alias("pred_bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true_bin")))


def relative_errors(predictions: DataFrame) -> DataFrame:
    """Mean absolute and RMS relative error, |truth - prediction| / truth, over rows with a truth above 0."""
    e = F.abs(F.col("true_s") - F.col("pred_s")) / F.col("true_s")
    return predictions.where("true_s > 0").agg(F.avg(e).alias("mean"), F.sqrt(F.avg(e * e)).alias("rms"), F.count("*").alias("n"))


def segments(predictions: DataFrame) -> DataFrame:
    """Add `segment`: it rises where truth plus time jumps, that is at each new transition ahead."""
    order = Window.partitionBy("comp_id").orderBy("bin")
    goal = F.col("true_s") + F.col("bin")
    jump = F.coalesce(F.abs(goal - F.lag(goal).over(order)) > 1e-6, F.lit(False)).cast("int")
    return predictions.withColumn("jump", jump).withColumn("segment", F.sum("jump").over(order)).drop("jump")


def eligible(predictions: DataFrame, truth: float, least_background: int, least_signal: int) -> DataFrame:
    """Compositions with enough background and signal."""
    s = F.sum((F.col("true_s") < truth).cast("long"))
    return predictions.groupBy("comp_id").agg(s.alias("n_signal"), (F.count("*") - s).alias("n_background")).where((F.col("n_signal") >= least_signal) & (F.col("n_background") >= least_background))


def false_warnings(predictions: DataFrame, truth: float, at: list[float], cooldown: int) -> DataFrame:
    """Warnings in background at each cut with `cooldown` bins between them, and the most there could be, in stretches without a hole.

    A stretch is walked in order, so each composition's background is a group; only warnings are passed to the walk.
    """
    background = predictions.where(F.col("true_s") >= truth)
    order = Window.partitionBy("comp_id").orderBy("bin")
    parted = background.withColumn("run", F.col("bin") - F.row_number().over(order))
    most = parted.groupBy("comp_id", "run").agg(F.ceil(F.count("*") / cooldown).alias("m")).groupBy("comp_id").agg(F.sum("m").alias("n_possible"))
    grid = predictions.sparkSession.createDataFrame([(float(c),) for c in at], "cut double")
    hits = parted.join(F.broadcast(grid)).where("pred_s < cut").select("comp_id", "cut", "run", "bin")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        return group[_fire(group["bin"].tolist(), cooldown)]

    fired = hits.groupBy("comp_id", "cut", "run").applyInPandas(walk, hits.schema).groupBy("comp_id", "cut").agg(F.count("*").alias("n_false"))
    return most.join(F.broadcast(grid)).join(fired, ["comp_id", "cut"], "left").select("comp_id", "cut", F.coalesce("n_false", F.lit(0)).alias("n_false"), "n_possible")


def first_warnings(parted: DataFrame, truth: float, cut: float) -> DataFrame:
    """The earliest warning of each segment's signal, and what is left of the time then over `truth`."""
    return parted.where((F.col("true_s") < truth) & (F.col("pred_s") < cut)).groupBy("comp_id", "segment").agg((F.max("true_s") / truth).alias("score"))


def final_run_starts(parted: DataFrame, cut: float, cap: float) -> DataFrame:
    """Time left at the first warning of the unbroken run that ends each segment, `cap` at most; 0 where the segment doesn't end in a warning."""
    quiet = F.max(F.when(F.col("pred_s") >= cut, F.col("bin"))).over(Window.partitionBy("comp_id", "segment"))
    left = F.min_by("true_s", F.when(F.col("bin") > F.coalesce("quiet", F.lit(-1)), F.col("bin")))
    return parted.withColumn("quiet", quiet).groupBy("comp_id", "segment").agg(F.least(F.coalesce(left, F.lit(0.0)), F.lit(cap)).alias("earliest"))


def final_run_quantiles(starts: DataFrame, at: list[float]) -> DataFrame:
    """Quantiles over segments of the time at which the final run starts, one row each; the rows of `starts` are as many as there are transitions."""
    found = starts.agg(F.expr(f"percentile(earliest, array({', '.join(f'{q}d' for q in at)}))").alias("q"), F.count("*").alias("n"))
    return found.select(F.posexplode("q").alias("i", "earliest"), "n").select(F.get(F.array(*map(F.lit, at)), F.col("i")).alias("quantile"), "earliest", "n")


def attribution_sums_by_range(attributions: DataFrame) -> DataFrame:
    """Sum of attributions over the variables of each time range (the feature's name from `_t_` on) for each row."""
    ranges = F.regexp_extract("feature", r"_t_(.*)$", 1)
    return attributions.groupBy("comp_id", "bin", ranges.alias("time_range")).agg(F.sum("attribution").alias("attribution"), F.count("*").alias("n_features"))


def attribution_sums(attributions: DataFrame) -> DataFrame:
    """Sum of attributions and mean value by variable (the feature's name up to `_t_`) for each row."""
    variable = F.regexp_extract("feature", r"^(.*?)_t_", 1)
    return attributions.groupBy("comp_id", "bin", variable.alias("variable")).agg(F.sum("attribution").alias("attribution"), F.avg("value").alias("value"))


def variable_ranks(sums: DataFrame, by: tuple[str, ...] = ("comp_id",), signed: bool = False) -> DataFrame:
    """Rank of each variable in each composition, or by other columns such as those of a transition, by its mean absolute attribution; ties by name.

    `signed` takes the mean itself, so that variables that bring the transition nearer come last. For signal alone pass the sums of its rows.
    """
    mean = sums.groupBy(*by, "variable").agg(F.avg("attribution" if signed else F.abs("attribution")).alias("strength"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("strength", 9)), "variable")))


def rank_shares(places: DataFrame) -> DataFrame:
    counts = places.groupBy("variable", "rank").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("rank")))


def rank_flows(places: DataFrame) -> DataFrame:
    """How often variables take the first, second and third place together."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("variable")))
    return places.groupBy("comp_id").agg(at(1).alias("first"), at(2).alias("second"), at(3).alias("third")).groupBy("first", "second", "third").agg(F.count("*").alias("n"))


def attribution_slopes(sums: DataFrame) -> DataFrame:
    """Slope of attribution on value for each composition and variable, and the residual's share of the variance."""
    vx, vy, c = F.var_pop("value"), F.var_pop("attribution"), F.covar_pop("value", "attribution")
    return sums.groupBy("comp_id", "variable").agg(F.when(vx > 1e-12, c / vx).alias("slope"), F.when((vx > 1e-12) & (vy > 1e-12), 1 - c * c / vx / vy).alias("unexplained"))


def percentile_slopes(sums: DataFrame, keys: list[str], most_error: float = 1.0) -> DataFrame:
    """`(keys, variable, slope, error_share, good)`: for each composition or transition, the slope of a variable's attribution on the percentile of its value among all rows.

    `error_share` is the fit's standard error, with two degrees of freedom less than rows, over the attribution's deviation; a fit is `good` if that is `most_error` or
    less. A variable whose percentile is 0 in all rows has slope 0; one with a single percentile, or two rows or fewer, has no error and isn't good.
    """
    placed = ranks.percentiles(sums, "value", "p", ("variable",)).where("p is not null")
    n, vx, vy, c = F.count("*"), F.var_pop("p"), F.var_pop("attribution"), F.covar_pop("p", "attribution")
    m = placed.groupBy(*keys, "variable").agg(n.alias("n"), vx.alias("vx"), vy.alias("vy"), c.alias("c"), F.max("p").alias("top"), F.sum(F.col("attribution") * F.col("attribution")).alias("square"))
    flat = F.col("top") == 0
    slope = F.when(flat, 0.0).when(F.col("vx") > 1e-12, F.col("c") / F.col("vx"))
    left = F.when(flat, F.col("square")).when(F.col("vx") > 1e-12, F.greatest(F.col("n") * (F.col("vy") - F.col("c") * F.col("c") / F.col("vx")), F.lit(0.0)))
    share = F.when((F.col("n") > 2) & (F.col("vy") > 1e-12), F.sqrt(left / (F.col("n") - 2)) / F.sqrt("vy"))
    return m.select(*keys, "variable", slope.alias("slope"), share.alias("error_share"), F.coalesce(share <= most_error, F.lit(False)).alias("good"))


def densities(predictions: DataFrame, truth: float, width: float) -> DataFrame:
    """Share per unit of the predictions of signal and background in bins of `width`."""
    counts = predictions.groupBy((F.col("true_s") < truth).alias("signal"), F.floor(F.col("pred_s") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy("signal")) * width))


def precision_recall_area(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under purity over TPR by Simpson's rule, from no warning at all to warnings everywhere.

    Where there is no warning the purity is that of the nearest cut that has one; a purity of 0 counts as 1, as in the surveyed work. A key without signal has null.
    """
    none, whole = F.struct(F.lit(0.0).alias("x"), F.lit(None).cast("double").alias("y")), F.struct(F.lit(1.0).alias("x"), F.col("share").alias("y"))
    ends = counts.groupBy(*by).agg(F.max((F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))).alias("share"))
    curve = _curve(counts, by, F.col("tpr"), F.col("purity"))
    curve = curve.join(ends, list(by)) if by else curve.join(F.broadcast(ends))  # one row each
    points = curve.withColumn("points", F.concat(F.array(none), "points", F.array(whole)))
    known = F.filter(F.transform("points", lambda p: p["y"]), lambda y: y.isNotNull())
    points = points.withColumns({"first": F.get(known, F.lit(0)), "last": F.element_at(known, -1), "n": F.size("points")})
    near = lambda p, i: F.coalesce(p["y"], F.when(i < F.floor(F.col("n") / 2), F.col("first")).otherwise(F.col("last")))
    full = F.transform("points", lambda p, i: F.struct(p["x"].alias("x"), F.when(near(p, i) < 1e-10, 1.0).otherwise(near(p, i)).alias("y")))
    return points.withColumn("points", full).select(*by, simpson(F.col("points")).alias("pr_auc"))


def fpr_at_tpr(counts: DataFrame, tpr: float, by: tuple[str, ...] = ()) -> DataFrame:
    """FPR at the given TPR, interpolated between the last cut below it and the first that reaches it; that of the first or last cut beyond the ends."""
    low, high = F.struct("tpr", "fpr"), F.struct("tpr", "fpr")
    found = counts.where("tpr is not null and fpr is not null").groupBy(*by).agg(
        F.max(F.when(F.col("tpr") < tpr, low)).alias("low"), F.min(F.when(F.col("tpr") >= tpr, high)).alias("high")
    )
    between = F.col("low.fpr") + (F.col("high.fpr") - F.col("low.fpr")) * (tpr - F.col("low.tpr")) / (F.col("high.tpr") - F.col("low.tpr"))
    return found.select(*by, F.coalesce(between, "high.fpr", "low.fpr").alias("fpr"))


def single_variables(features: DataFrame, labels: DataFrame, names: list[str], truth: float, at: list[float]) -> DataFrame:
    """The counts of warnings from each feature alone: a high value warns, so the prediction is its negative. features: comp_id, bin, names; labels: comp_id, bin, label."""
    long = features.unpivot(["comp_id", "bin"], names, "feature", "value").where("value is not null and not isnan(value)")
    rows = long.join(labels, ["comp_id", "bin"]).select("feature", F.col("label").cast("double").alias("true_s"), (-F.col("value")).alias("pred_s"))
    return threshold_counts(rows, truth, at, ("feature",))


def correlated_groups(matrix: DataFrame, places: DataFrame, least: float) -> DataFrame:
    """Ranks by composition after variables whose correlation exceeds `least` either way become one group, named by its first variable; a group has its best rank.

    matrix: a, b, correlation; places: comp_id, variable, rank.
    """
    groups = connected_components(matrix.where(F.abs("correlation") > least), "a", "b").select(F.col("node").alias("variable"), F.col("component").alias("group"))
    named = places.join(groups, "variable", "left").withColumn("group", F.coalesce("group", "variable"))
    best = named.groupBy("comp_id", "group").agg(F.min("rank").alias("best"), F.count("*").alias("n_variables"))
    return best.select("comp_id", "group", "n_variables", F.row_number().over(Window.partitionBy("comp_id").orderBy("best")).alias("rank"))


def least_useful(attributions: DataFrame, matrix: DataFrame, n: int, most_correlated: float, random_prefix: str = "rand_") -> list[str]:
    """Up to `n` features to drop, the least mean absolute attribution first: none that is correlated by more than `most_correlated` with one already
    dropped, and none above the best random feature, where there are such. A row a feature and a pair reach the driver.

    attributions: feature, attribution; matrix: a, b, correlation.
    """
    means = attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("m")).collect()
    strength = {r["feature"]: r["m"] for r in means}
    close = {frozenset((r["a"], r["b"])) for r in matrix.where(F.abs("correlation") > most_correlated).collect()}
    limit = max((m for f, m in strength.items() if f.startswith(random_prefix)), default=float("inf"))
    dropped: list[str] = []
    for feature in sorted((f for f in strength if not f.startswith(random_prefix)), key=lambda f: (round(strength[f], 12), f)):
        if len(dropped) < n and strength[feature] <= limit and not any(frozenset((feature, d)) in close for d in dropped):
            dropped.append(feature)
    return dropped


def calm_rows(features: DataFrame, below: dict[str, float]) -> DataFrame:
    """Rows whose features are all below their thresholds; a missing value is not below."""
    condition = F.lit(True)
    for name, most in below.items():
        condition = condition & (F.col(name) < most)
    return features.where(condition).select("comp_id", "bin")


def weighted_errors(predictions: DataFrame, weight: Column) -> DataFrame:
    """Weighted mean absolute and RMS relative error, |truth - prediction| / truth, over rows with a truth above 0."""
    e = F.abs(F.col("true_s") - F.col("pred_s")) / F.col("true_s")
    return predictions.where("true_s > 0").agg((F.sum(weight * e) / F.sum(weight)).alias("mean"), F.sqrt(F.sum(weight * e * e) / F.sum(weight)).alias("rms"))


def rate_bands(counts: DataFrame, at: list[float]) -> DataFrame:
    """Quantiles over compositions of TPR and FPR at each cut, `tpr_<percent>` and `fpr_<percent>`. counts: of `threshold_counts` by comp_id."""
    made = [F.expr(f"percentile({rate}, {q}d)").alias(f"{rate}_{round(100 * q)}") for rate in ("tpr", "fpr") for q in at]
    return counts.groupBy("i", "cut").agg(*made, F.count("*").alias("n_comps"))
