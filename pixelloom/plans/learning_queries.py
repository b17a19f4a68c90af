"""Registered queries on models and fits, and some further ones on transitions and attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.operators import changes, learning, training, transitions, users
from pixelloom.plans.canvas_queries import rounded
from pixelloom.plans.series_queries import FOUND
from pixelloom.plans.storage import write_shared
from pixelloom.plans.training_queries import BASE, CAP, NAMES, TRUTH, Table
from pixelloom.plans.user_queries import lives
from pixelloom.sources import adapter
from pixelloom.sources.adapter import SQL_PIXELS


def _of(make):
    return lambda spark, sf_dir: make(Table(spark, sf_dir))


def ready(t: Table) -> DataFrame:
    """Features without nulls, target and weight."""
    table = t.table().na.fill(0.0)
    return write_shared(table.withColumns({"target": training.transformed(F.col("label")), "weight": training.row_weights(F.col("label"), 6.0, float(CAP), 0.4)}), "training")


def _boosted(t: Table) -> DataFrame:
    rows = training.split_by_composition(ready(t), 0.2)
    return learning.boosted_predictions(rows.where("not is_test"), rows.where("is_test"), NAMES)


def _scaled(t: Table) -> DataFrame:
    found = learning.standardised(ready(t), NAMES)
    return found.select("comp_id", "bin", *((F.round(F.col("scaled")[i], 5) + F.lit(0.0)).alias(n) for i, n in enumerate(NAMES)))


def _before_after(t: Table) -> DataFrame:
    """Mean value in the eight bins before each transition and from its end on."""
    joined = t.transitions.join(t.rows.select("comp_id", "bin", "val"), "comp_id")
    pre = F.avg(F.when((F.col("bin") < F.col("bin_beg")) & (F.col("bin") >= F.col("bin_beg") - 8), F.col("val")))
    post = F.avg(F.when((F.col("bin") >= F.col("bin_end")) & (F.col("bin") < F.col("bin_end") + 8), F.col("val")))
    return joined.groupBy("comp_id", "trans_idx").agg(pre.alias("pre"), post.alias("post"))


def _sibling_gaps(t: Table) -> DataFrame:
    """Bins between a composition's consecutive transitions."""
    order = Window.partitionBy("comp_id").orderBy("trans_idx")
    return t.transitions.select("comp_id", "trans_idx", (F.col("bin_beg") - F.lag("bin_end").over(order)).alias("gap")).where("gap is not null")


def _binned_attributions(t: Table) -> DataFrame:
    """Mean attribution in bins of the feature's value, for signal and background rows."""
    joined = t.attributions().join(t.labelled(), ["comp_id", "bin"])
    return joined.groupBy("feature", (F.col("label") < 8).alias("signal"), F.floor(F.col("value") / 0.5).cast("int").alias("value_bin")).agg(F.count("*").alias("n"), F.avg("attribution").alias("mean"))


def _cross_fitted(kind: str, part: int):
    def run(t: Table) -> DataFrame:
        rows = ready(t)
        if kind == "classification":
            rows = rows.withColumn("target", (F.col("label") < TRUTH).cast("double"))
        found = learning.cross_fitted(rows, NAMES, kind, folds=2, rounds=6, depth=3)[part]
        return rounded(found, "loss" if part else "prediction", digits=5)

    return run


#: A fixed curve for the inverse alone; true and predicted times are numbers of bins here.
CURVE = learning.Calibration(x_break=6.0, y_break=5.0, x_end=float(CAP), y_end=20.0, least=2.0)
KNOTS = 12


def _calibrated(t: Table) -> DataFrame:
    """Predictions calibrated by the curve that is fitted to them."""
    predictions = write_shared(t.predictions(), "predictions")
    kept = predictions.where(F.col("pred_s") < 12 + 3.5 * F.col("true_s")).agg(F.min("pred_s").alias("a"), F.max("pred_s").alias("b")).first()
    curve = learning.fit_calibration(learning.median_curve(predictions, 12.0, 3.5), float(CAP), max(0.0, kept["a"]), kept["b"], (1.0, 8.0), (1.0, 12.0))
    return learning.calibrated(predictions, curve)


QUERIES = {
    "d15_cross_fitted_regression": _of(_cross_fitted("regression", 0)),
    "d15_cross_fitted_classification": _of(_cross_fitted("classification", 0)),
    "d15_losses_by_round": _of(_cross_fitted("regression", 1)),
    "e1_median_curve": _of(lambda t: rounded(learning.median_curve(t.predictions(), 12.0, 3.5), "x", "y")),
    "e1_calibrated_predictions": _of(lambda t: rounded(_calibrated(t), "pred_s", digits=5)),
    "e1_inverted_predictions": _of(lambda t: rounded(learning.calibrated(t.predictions(), CURVE, KNOTS), "pred_s", digits=5)),
    "d14_components_for_shares": _of(lambda t: rounded(learning.components_for(learning.weighted_components(ready(t), NAMES, len(NAMES)), [0.95, 0.99]), "reached", digits=5)),
    "d14_principal_components": _of(lambda t: rounded(learning.weighted_components(ready(t), NAMES, 4), "explained", digits=5)),
    "d14_standardised": _of(_scaled),
    "d15_boosted_trees": _of(_boosted),
    "e1_calibration_points": _of(lambda t: rounded(learning.calibration_points(t.predictions(), 3.0, 16.0), "x", "y")),
    "e21_binned_attributions": _of(lambda t: rounded(_binned_attributions(t), "mean")),
    "u7_decay_times": lambda s, d: rounded(learning.decay_times(users.survivorship(lives(s, d), [i * 86400.0 for i in range(0, 31, 3)], 86400.0, 30 * 86400.0, [0, 7, 10])), "tau", digits=0),
    "m4_hull_perimeters": lambda s, d: rounded(learning.hull_perimeters(changes.rectangle_pixels(adapter.borders(s, d))), "hull"),
    "x7_before_and_after": _of(lambda t: rounded(_before_after(t), "pre", "post")),
    "x9_sibling_gaps": _of(_sibling_gaps),
    "x17_lasting_runs": _of(lambda t: transitions.runs(t.rows, F.col("val") > 0.4, ["comp_id"], 3).groupBy("comp_id").agg(F.min("beg").alias("first"), F.max("fin").alias("last"))),
}

KNOT_ROWS = ", ".join(f"({i}, {x!r}e0, {y!r}e0)" for i, (x, y) in enumerate(zip(*CURVE.knots(KNOTS), strict=True)))

ORACLES = {
    "e1_median_curve": f"""WITH {BASE}, t AS (SELECT log10(true_s + 100) - 1.5 AS t, log10(pred_s + 100) - 1.5 AS p FROM pred WHERE pred_s < 12 + 3.5 * true_s), m AS (SELECT min(t) AS lo, (max(t) * 1.01 - min(t)) / 44 AS step FROM t),
        b AS (SELECT CAST(least(floor((t - lo) / step), 43) AS INT) AS bin, lo, step, p FROM t, m) SELECT bin, round(lo + (bin + 0.5) * step, 6) AS x, round(quantile_cont(p, 0.5), 6) AS y, count(*) AS n FROM b GROUP BY bin, lo, step""",
    "e1_inverted_predictions": f"""WITH {BASE}, knots(i, x, y) AS (VALUES {KNOT_ROWS}), k AS (SELECT *, lead(x) OVER (ORDER BY i) AS nx, lead(y) OVER (ORDER BY i) AS ny FROM knots), t AS (SELECT *, log10(pred_s + 100) - 1.5 AS v FROM pred),
        z AS (SELECT t.comp_id, t.bin, t.true_s, CASE WHEN v < (SELECT min(x) FROM knots) THEN (SELECT y FROM knots WHERE i = 0) WHEN v >= (SELECT max(x) FROM knots) THEN (SELECT arg_max(y, i) FROM knots)
            ELSE (SELECT arg_max(y + (ny - y) * (v - x) / (nx - x), i) FROM k WHERE x <= v AND nx IS NOT NULL) END AS r FROM t) SELECT comp_id, bin, true_s, round(power(10, r + 1.5) - 100, 5) + 0e0 AS pred_s FROM z""",
    "d14_standardised": f"WITH {BASE}, t AS (SELECT comp_id, bin, {', '.join(f'coalesce({n}, 0) AS {n}' for n in NAMES)} FROM feats) SELECT comp_id, bin, "
    + ", ".join(f"round(({n} - avg({n}) OVER ()) / stddev_samp({n}) OVER (), 5) + 0e0 AS {n}" for n in NAMES) + " FROM t",
    "e1_calibration_points": f"WITH {BASE} SELECT CAST(floor(true_s / 3) AS INT) AS bin, round(avg(true_s), 6) AS x, round(quantile_cont(pred_s, 0.5), 6) AS y, count(*) AS n FROM pred WHERE abs(pred_s - true_s) <= 16 GROUP BY 1",
    "m4_hull_perimeters": f"WITH {SQL_PIXELS} SELECT comp_id, round(2e0 * (x1 - x0 + 1 + y1 - y0 + 1), 6) AS hull FROM borders",
    "x7_before_and_after": f"""WITH {FOUND} SELECT f.comp_id, trans_idx, round(avg(val) FILTER (WHERE bin < bin_beg AND bin >= bin_beg - 8), 6) AS pre, round(avg(val) FILTER (WHERE bin >= bin_end AND bin < bin_end + 8), 6) AS post
        FROM found f JOIN rows_ r ON r.comp_id = f.comp_id GROUP BY 1, 2""",
    "x9_sibling_gaps": f"WITH {FOUND} SELECT * FROM (SELECT comp_id, trans_idx, bin_beg - lag(bin_end) OVER (PARTITION BY comp_id ORDER BY trans_idx) AS gap FROM found) WHERE gap IS NOT NULL",
    "x17_lasting_runs": f"""WITH {FOUND}, g AS (SELECT comp_id, min(bin) AS beg, max(bin) + 1 AS fin FROM (SELECT comp_id, bin, bin - row_number() OVER (PARTITION BY comp_id ORDER BY bin) AS g FROM rows_ WHERE val > 0.4) GROUP BY comp_id, g)
        SELECT comp_id, min(beg) AS first, max(fin) AS last FROM g WHERE fin - beg >= 3 GROUP BY 1""",
}
