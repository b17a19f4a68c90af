"""Registered queries on the training table, predictions and attributions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import evaluation, ranks, training
from pixelloom.plans.canvas_queries import rounded
from pixelloom.plans.series_queries import FOUND, _found, difference_series
from pixelloom.plans.storage import write_shared
from pixelloom.plans.user_queries import lives

CAP, TRUTH = 24, 8.0
CUTS = [4.0, 8.0, 12.0, 16.0, 20.0]
RANGES = training.lag_ranges([1, 1, 2, 4])
NAMES = [f"{n}_t_{a}_{b}" for n in ("val", "ratio") for a, b in RANGES]


class Table:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.rows = write_shared(difference_series(spark, sf_dir), "difference")
        self.transitions = write_shared(_found(self.rows), "transitions")
        self.area = lives(spark, sf_dir).select("comp_id", "area")

    def features(self) -> DataFrame:
        return training.feature_windows(self.rows, ["val", "ratio"], RANGES)

    def labelled(self) -> DataFrame:
        return training.labels(self.rows, self.transitions, CAP)

    def table(self) -> DataFrame:
        return self.features().join(self.labelled(), ["comp_id", "bin"])

    def predictions(self) -> DataFrame:
        """A plain predictor: the more pixels are off, the sooner."""
        joined = self.rows.join(self.labelled(), ["comp_id", "bin"])
        return joined.select("comp_id", "bin", F.col("label").cast("double").alias("true_s"), F.round(CAP * (1 - F.col("val")), 6).alias("pred_s"))

    def attributions(self) -> DataFrame:
        """Attributions of a linear predictor: value less its mean, times a weight by feature."""
        long = self.features().unpivot(["comp_id", "bin"], NAMES, "feature", "value").where("value is not null")
        mean = long.groupBy("feature").agg(F.avg("value").alias("mean"))
        weight = F.length("feature") - 7.5
        return long.join(F.broadcast(mean), "feature").select("comp_id", "bin", "feature", "value", ((F.col("value") - F.col("mean")) * weight).alias("attribution"))


def _of(make):
    return lambda spark, sf_dir: make(Table(spark, sf_dir))


def _ranks_by_transition(t: Table) -> DataFrame:
    """Signed ranks of the signal of each transition: the rows within its reach."""
    signal = evaluation.segments(t.predictions()).where(F.col("true_s") < TRUTH).select("comp_id", "bin", "segment")
    sums = evaluation.attribution_sums(t.attributions()).join(signal, ["comp_id", "bin"])
    return rounded(evaluation.variable_ranks(sums, ("comp_id", "segment"), signed=True), "strength")


RATES = ("tpr", "fpr", "purity", "f1", "accuracy")
EVEN = "cast(substring(comp_id, 2, 9) as int) % 2 = 0"

QUERIES = {
    "d1_feature_windows": _of(lambda t: rounded(t.features(), *NAMES)),
    "d4_labels": _of(lambda t: t.labelled()),
    "d5_stable_rows": _of(lambda t: training.stable_rows(t.rows.select("comp_id", "bin"), t.transitions, t.area, 9, 110)),
    "d7_messy_rows": _of(lambda t: t.rows.where(0.7 * F.col("val") + 0.3 * F.col("ratio") / 10 < 0.3).select("comp_id", "bin")),
    "d9_transformed_labels": _of(lambda t: rounded(t.labelled().withColumn("target", training.transformed(F.col("label"))).withColumn("back", training.restored(F.col("target"))), "target", "back")),
    "d10_row_weights": _of(lambda t: rounded(t.labelled().withColumn("weight", training.row_weights(F.col("label"), 6.0, float(CAP), 0.4)), "weight")),
    "d11_split": _of(lambda t: training.split_by_composition(t.rows.select("comp_id", "bin"), 0.2)),
    "d11_split_by_stored_ids": _of(lambda t: training.split_by_ids(t.rows.select("comp_id", "bin"), t.area.where("area >= 9").select("comp_id"))),
    "d11_down_sampled": _of(lambda t: training.down_sampled(training.split_by_ids(t.rows.select("comp_id", "bin"), t.area.where("area >= 9").select("comp_id")), 400, 90).groupBy("is_test").agg(F.count("*").alias("n"))),
    "d12_random_features": _of(lambda t: rounded(training.with_random_features(t.rows.select("comp_id", "bin"), 2), "uniform_0", "uniform_1", "normal_0", "normal_1")),
    "d13_correlations": _of(lambda t: rounded(training.correlations(t.table().na.fill(0.0), NAMES, "label"), "correlation")),
    "d16_feature_relation": _of(lambda t: rounded(training.feature_relation(t.table(), "val_t_0_0", "label", 0.25), "mean_y", "error_y")),
    "d16_histogram": _of(lambda t: ranks.two_dimensional_histogram(t.table(), "val_t_0_0", "label", 12)),
    "d16_percentile_ranks": _of(lambda t: rounded(ranks.percentile_ranks(t.rows.select("comp_id", "bin", "val"), "val", "percentile"), "percentile")),
    "e18_percentile_slopes": _of(lambda t: rounded(evaluation.percentile_slopes(write_shared(evaluation.attribution_sums(t.attributions()), "attribution-sums"), ["comp_id"]), "slope", "error_share", digits=5)),
    "e2_cuts": lambda s, d: s.createDataFrame([(c,) for c in evaluation.cuts(Table(s, d).predictions(), TRUTH, [0.1, 0.25, 0.5, 0.75, 0.9])], "cut double"),
    "e3_threshold_counts": _of(lambda t: rounded(evaluation.threshold_counts(t.predictions(), TRUTH, CUTS), *RATES)),
    "e4_roc_area": _of(lambda t: rounded(evaluation.roc_area(evaluation.threshold_counts(t.predictions(), TRUTH, CUTS)), "auc")),
    "e4_partial_roc_area": _of(lambda t: rounded(evaluation.roc_area(evaluation.threshold_counts(t.predictions(), TRUTH, CUTS), max_fpr=0.3), "auc")),
    "e5_train_over_test": _of(lambda t: rounded(evaluation.compare_counts(evaluation.threshold_counts(t.predictions().where(EVEN), TRUTH, CUTS), evaluation.threshold_counts(t.predictions().where(f"not ({EVEN})"), TRUTH, CUTS)), *RATES)),
    "e7_truth_by_prediction": _of(lambda t: rounded(evaluation.truth_by_prediction(t.predictions(), 3.0), "share")),
    "e8_relative_errors": _of(lambda t: rounded(evaluation.relative_errors(t.predictions()), "mean", "rms")),
    "e9_segments": _of(lambda t: evaluation.segments(t.predictions()).select("comp_id", "bin", "segment")),
    "e9_eligible": _of(lambda t: evaluation.eligible(t.predictions(), TRUTH, 30, 4)),
    "e10_rates_by_composition": _of(lambda t: rounded(evaluation.threshold_counts(t.predictions(), TRUTH, CUTS, ("comp_id",)), *RATES)),
    "e10_roc_by_composition": _of(lambda t: rounded(evaluation.roc_area(evaluation.threshold_counts(t.predictions(), TRUTH, CUTS, ("comp_id",)), ("comp_id",)), "auc")),
    "e11_false_warnings": _of(lambda t: evaluation.false_warnings(t.predictions(), TRUTH, CUTS, 6)),
    "e12_first_warnings": _of(lambda t: rounded(evaluation.first_warnings(evaluation.segments(t.predictions()), TRUTH, 14.0), "score")),
    "e13_final_runs": _of(lambda t: evaluation.final_run_starts(evaluation.segments(t.predictions()), 16.0, 12.0)),
    "e13_final_run_quantiles": _of(lambda t: rounded(evaluation.final_run_quantiles(evaluation.final_run_starts(evaluation.segments(t.predictions()), 16.0, 12.0), [0.1, 0.3, 0.5, 0.7, 0.9]), "earliest")),
    "e14_attribution_sums": _of(lambda t: rounded(evaluation.attribution_sums(t.attributions()), "attribution", "value")),
    "e15_variable_ranks": _of(lambda t: rounded(evaluation.variable_ranks(evaluation.attribution_sums(t.attributions())), "strength")),
    "e14_attribution_sums_by_range": _of(lambda t: rounded(evaluation.attribution_sums_by_range(t.attributions()), "attribution")),
    "e15_ranks_by_transition": _of(_ranks_by_transition),
    "e15_rank_shares": _of(lambda t: rounded(evaluation.rank_shares(evaluation.variable_ranks(evaluation.attribution_sums(t.attributions()))), "share")),
    "e16_rank_flows": _of(lambda t: evaluation.rank_flows(evaluation.variable_ranks(evaluation.attribution_sums(t.attributions())))),
    "e18_attribution_slopes": _of(lambda t: rounded(evaluation.attribution_slopes(evaluation.attribution_sums(t.attributions())), "slope", "unexplained", digits=5)),
    "e22_densities": _of(lambda t: rounded(evaluation.densities(t.predictions(), TRUTH, 2.0), "density")),
}

LAGS = ", ".join(f"avg({n}) OVER (PARTITION BY comp_id ORDER BY bin ROWS BETWEEN {b} PRECEDING AND {a} PRECEDING) AS {n}_t_{a}_{b}" for n in ("val", "ratio") for a, b in RANGES).replace("AND 0 PRECEDING", "AND CURRENT ROW").replace("BETWEEN 0 PRECEDING", "BETWEEN CURRENT ROW")
BASE = f"""{FOUND}, labelled AS (SELECT r.comp_id, r.bin, val, ratio, coalesce(least((SELECT min(bin_beg) FROM found f WHERE f.comp_id = r.comp_id AND bin_beg >= r.bin) - r.bin, {CAP}), {CAP}) AS label FROM rows_ r),
    feats AS (SELECT comp_id, bin, {LAGS} FROM rows_), pred AS (SELECT comp_id, bin, CAST(label AS DOUBLE) AS true_s, round({CAP} * (1 - val), 6) AS pred_s FROM labelled)"""
LONG = f"""{BASE}, long_ AS (SELECT comp_id, bin, feature, value FROM (UNPIVOT feats ON {', '.join(NAMES)} INTO NAME feature VALUE value)),
    attr AS (SELECT l.*, (value - m) * (length(l.feature) - 7.5) AS attribution FROM long_ l JOIN (SELECT feature, avg(value) AS m FROM long_ GROUP BY 1) USING (feature)),
    sums AS (SELECT comp_id, bin, regexp_extract(feature, '^(.*?)_t_', 1) AS variable, sum(attribution) AS attribution, avg(value) AS value FROM attr GROUP BY 1, 2, 3),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY comp_id ORDER BY round(strength, 9) DESC, variable) AS rank FROM (SELECT comp_id, variable, avg(abs(attribution)) AS strength FROM sums GROUP BY 1, 2))"""
SEG = f"""{BASE}, seg AS (SELECT *, sum(j) OVER (PARTITION BY comp_id ORDER BY bin) AS segment FROM (SELECT *, CASE WHEN abs(true_s + bin - lag(true_s + bin) OVER (PARTITION BY comp_id ORDER BY bin)) > 1e-6 THEN 1 ELSE 0 END AS j FROM pred))"""

FINAL = f"""{SEG}, quiet AS (SELECT comp_id, segment, max(bin) FILTER (WHERE pred_s >= 16) AS quiet FROM seg GROUP BY 1, 2),
    final AS (SELECT comp_id, segment, least(coalesce(arg_min(true_s, bin) FILTER (WHERE bin > coalesce(quiet, -1)), 0), 12e0) AS earliest FROM seg JOIN quiet USING (comp_id, segment) GROUP BY 1, 2)"""


def _counts(by: str = "", where: str = "true", name: str = "counts") -> str:
    keys = f"{by}, " if by else ""
    return f"""{name} AS (SELECT {keys}i, cut, tp, fp, nb - fp AS tn, ps - tp AS fn, tp / nullif(ps, 0) AS tpr, fp / nullif(nb, 0) AS fpr, tp / nullif(tp + fp, 0) AS purity,
        2 * tp / nullif(2 * tp + fp + ps - tp, 0) AS f1, (tp + nb - fp) / nullif(ps + nb, 0) AS accuracy
        FROM (SELECT {keys}i, cut, count(*) FILTER (WHERE pred_s < cut AND true_s < 8) AS tp, count(*) FILTER (WHERE pred_s < cut AND true_s >= 8) AS fp, count(*) FILTER (WHERE true_s < 8) AS ps, count(*) FILTER (WHERE true_s >= 8) AS nb
            FROM (SELECT * FROM pred WHERE {where}), (VALUES (0, 4e0), (1, 8e0), (2, 12e0), (3, 16e0), (4, 20e0)) g(i, cut) GROUP BY ALL))"""


RND = ", ".join(f"round({n}, 6) AS {n}" for n in RATES)


def _simpson(source: str, by: str = "") -> str:
    """Simpson's rule over the points (`by`, k, x, y) of `source`, k counting from 0 along the curve."""
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {k}sum(CASE WHEN n = 2 AND k = 0 THEN b0 * (y + y1) / 2
            WHEN n > 2 AND k % 2 = 0 AND k + 2 <= CASE WHEN n % 2 = 1 THEN n - 1 ELSE n - 2 END
                THEN (b0 + b1) / 6 * (y * (2 - CASE WHEN b0 = 0 OR b1 = 0 THEN 0 ELSE b1 / b0 END) + y1 * (b0 + b1) * CASE WHEN b0 * b1 = 0 THEN 0 ELSE (b0 + b1) / (b0 * b1) END + y2 * (2 - CASE WHEN b1 = 0 THEN 0 ELSE b0 / b1 END))
            ELSE 0 END) + coalesce(sum(CASE WHEN b0 + b1 = 0 THEN 0 ELSE y2 * (2 * b1 * b1 + 3 * b0 * b1) / (6 * (b0 + b1)) END + CASE WHEN b0 = 0 THEN 0 ELSE y1 * (b1 * b1 + 3 * b0 * b1) / (6 * b0) - y * b1 * b1 * b1 / (6 * b0 * (b0 + b1)) END)
            FILTER (WHERE n > 2 AND n % 2 = 0 AND k = n - 3), 0) AS area
        FROM (SELECT *, x1 - x AS b0, x2 - x1 AS b1 FROM (SELECT *, count(*) OVER ({part}) AS n, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2 FROM {source} WINDOW w AS ({part}ORDER BY k)))
        {'GROUP BY ' + by if by else ''}"""


def _auc(by: str = "", limit: float = 1.0) -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    keys = f"(SELECT DISTINCT {by} FROM counts)" if by else "(SELECT 1)"
    match = f"m.{by} = c.{by} AND" if by else ""
    return f"""curve AS (SELECT {k}i, coalesce(tpr, 0) AS y, coalesce(fpr, 0) AS x FROM counts UNION ALL SELECT {k}-1, 0, 0 FROM {keys} UNION ALL SELECT {k}9, 1, 1 FROM {keys}),
        above AS (SELECT *, lead(x) OVER ({part}ORDER BY i) AS nx, lead(y) OVER ({part}ORDER BY i) AS ny FROM curve),
        ends AS (SELECT {k}99 AS i, CASE WHEN nx IS NULL THEN y ELSE y + (ny - y) * ({limit}e0 - x) / (nx - x) END AS y, {limit}e0 AS x FROM above WHERE x <= {limit} AND (nx IS NULL OR nx > {limit})),
        points AS (SELECT *, row_number() OVER ({part}ORDER BY i) - 1 AS k FROM (SELECT {k}i, y, x FROM curve WHERE x <= {limit} UNION ALL SELECT {k}-2, 0, 0 FROM {keys} UNION ALL SELECT {k}i, y, x FROM ends))
        SELECT {k}round(area / {limit}, 6) AS auc FROM ({_simpson('points', by)})"""


ORACLES = {
    "d1_feature_windows": f"WITH {BASE} SELECT comp_id, bin, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)} FROM feats",
    "d4_labels": f"WITH {BASE} SELECT comp_id, bin, label FROM labelled",
    "d5_stable_rows": f"WITH {BASE} SELECT r.comp_id, r.bin FROM rows_ r JOIN (SELECT comp_id FROM borders WHERE (x1 - x0 + 1) * (y1 - y0 + 1) >= 9) b USING (comp_id) WHERE r.bin < 110 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.comp_id = r.comp_id AND r.bin >= bin_beg AND r.bin < bin_end)",
    "d7_messy_rows": f"WITH {BASE} SELECT comp_id, bin FROM rows_ WHERE 0.7e0 * val + 0.3e0 * ratio / 10 < 0.3e0",
    "d9_transformed_labels": f"WITH {BASE} SELECT comp_id, bin, label, round(log10(label + 100) - 1.5, 6) AS target, round(CAST(label AS DOUBLE), 6) AS back FROM labelled",
    "d10_row_weights": f"WITH {BASE} SELECT comp_id, bin, label, round(CASE WHEN label <= 6 THEN 1e0 ELSE (label / 6e0) ** (ln(0.4e0) / ln(4e0)) END, 6) AS weight FROM labelled",
    "d11_split_by_stored_ids": f"WITH {BASE} SELECT r.comp_id, bin, (x1 - x0 + 1) * (y1 - y0 + 1) >= 9 AS is_test FROM rows_ r JOIN borders b ON b.comp_id = r.comp_id",
    "d11_down_sampled": f"WITH {BASE}, t AS (SELECT (x1 - x0 + 1) * (y1 - y0 + 1) >= 9 AS is_test, count(*) AS n FROM rows_ r JOIN borders b ON b.comp_id = r.comp_id GROUP BY 1) SELECT is_test, least(n, CASE WHEN is_test THEN 90 ELSE 400 END) AS n FROM t",
    "d13_correlations": f"WITH {BASE}, t AS (SELECT f.*, label FROM feats f JOIN labelled USING (comp_id, bin)) " + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(CASE WHEN stddev_pop(coalesce({n}, 0)) * stddev_pop(label) > 1e-12 THEN covar_pop(coalesce({n}, 0), label) / (stddev_pop(coalesce({n}, 0)) * stddev_pop(label)) ELSE 0 END, 6) AS correlation FROM t" for n in NAMES),
    "d16_feature_relation": f"""WITH {BASE} SELECT CAST(floor(val_t_0_0 / 0.25) AS INT) AS x_bin, count(*) AS n, round(avg(label), 6) AS mean_y, round(CASE WHEN count(*) > 1 THEN stddev_samp(label) / sqrt(count(*)) END, 6) AS error_y FROM feats JOIN labelled USING (comp_id, bin) GROUP BY 1""",
    "d16_histogram": f"""WITH {BASE}, t AS (SELECT CAST(val_t_0_0 AS DOUBLE) AS x, CAST(label AS DOUBLE) AS y FROM feats JOIN labelled USING (comp_id, bin)), m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM t)
        SELECT CAST(least(floor((x - x0) / (x1 - x0) * 12), 11) AS INT) AS x_bin, CAST(least(floor((y - y0) / (y1 - y0) * 12), 11) AS INT) AS y_bin, count(*) AS n FROM t, m GROUP BY 1, 2""",
    "d16_percentile_ranks": f"WITH {BASE} SELECT comp_id, bin, val, round((rank() OVER (ORDER BY val) + (count(*) OVER (PARTITION BY val) - 1) / 2) / count(*) OVER (), 6) AS percentile FROM rows_",
    "e18_percentile_slopes": f"""WITH {LONG}, l AS (SELECT variable, list(value ORDER BY value) AS vs, count(*) AS n FROM sums GROUP BY 1), h AS (SELECT *, round(p / 100e0 * (n - 1), 9) AS h FROM l, range(101) r(p)),
        e AS (SELECT variable, vs[CAST(floor(h) AS INT) + 1] + (vs[CAST(ceil(h) AS INT) + 1] - vs[CAST(floor(h) AS INT) + 1]) * (h - floor(h)) AS edge FROM h),
        p AS (SELECT s.comp_id, s.bin, s.variable, any_value(attribution) AS attribution, (count(*) FILTER (WHERE edge <= value) - 1) / 100 AS p FROM sums s JOIN e ON e.variable = s.variable GROUP BY 1, 2, 3),
        m AS (SELECT comp_id, variable, count(*) AS n, var_pop(p) AS vx, var_pop(attribution) AS vy, covar_pop(p, attribution) AS c, max(p) AS top, sum(attribution ** 2) AS sq FROM p GROUP BY 1, 2),
        f AS (SELECT *, CASE WHEN top = 0 THEN 0 WHEN vx > 1e-12 THEN c / vx END AS slope, CASE WHEN n > 2 AND vy > 1e-12 THEN sqrt(CASE WHEN top = 0 THEN sq WHEN vx > 1e-12 THEN greatest(n * (vy - c * c / vx), 0) END / (n - 2)) / sqrt(vy) END AS share FROM m)
        SELECT comp_id, variable, round(slope, 5) AS slope, round(share, 5) AS error_share, coalesce(share <= 1, false) AS good FROM f""",
    "e2_cuts": f"WITH {BASE} SELECT DISTINCT round(unnest(q), 6) AS cut FROM (SELECT quantile_cont(pred_s, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM pred GROUP BY true_s < 8)",
    "e3_threshold_counts": f"WITH {BASE}, {_counts()} SELECT i, cut, tp, fp, tn, fn, {RND} FROM counts",
    "e4_roc_area": f"WITH {BASE}, {_counts()}, {_auc()}",
    "e4_partial_roc_area": f"WITH {BASE}, {_counts()}, {_auc(limit=0.3)}",
    "e5_train_over_test": f"""WITH {BASE}, {_counts(where='CAST(comp_id[2:] AS INT) % 2 = 0', name='a')}, {_counts(where='CAST(comp_id[2:] AS INT) % 2 = 1', name='b')}
        SELECT a.i, a.cut, {', '.join(f'round(a.{n} / nullif(b.{n}, 0), 6) AS {n}' for n in RATES)} FROM a JOIN b ON a.i = b.i""",
    "e7_truth_by_prediction": f"""WITH {BASE} SELECT true_bin, pred_bin, n, round(n / sum(n) OVER (PARTITION BY true_bin), 6) AS share FROM (SELECT CAST(floor(log10(true_s + 1) * 3) AS INT) AS true_bin, CAST(floor(log10(pred_s + 1) * 3) AS INT) AS pred_bin, count(*) AS n FROM pred GROUP BY 1, 2)""",
    "e8_relative_errors": f"WITH {BASE} SELECT round(avg(abs(true_s - pred_s) / true_s), 6) AS mean, round(sqrt(avg(((pred_s - true_s) / true_s) ** 2)), 6) AS rms, count(*) AS n FROM pred WHERE true_s > 0",
    "e9_segments": f"WITH {SEG} SELECT comp_id, bin, segment FROM seg",
    "e9_eligible": f"WITH {BASE} SELECT comp_id, count(*) FILTER (WHERE true_s < 8) AS n_signal, count(*) FILTER (WHERE true_s >= 8) AS n_background FROM pred GROUP BY 1 HAVING n_signal >= 4 AND n_background >= 30",
    "e10_rates_by_composition": f"WITH {BASE}, {_counts('comp_id')} SELECT comp_id, i, cut, tp, fp, tn, fn, {RND} FROM counts",
    "e10_roc_by_composition": f"WITH {BASE}, {_counts('comp_id')}, {_auc('comp_id')}",
    "e12_first_warnings": f"WITH {SEG} SELECT comp_id, segment, round(max(true_s) / 8, 6) AS score FROM seg WHERE true_s < 8 AND pred_s < 14 GROUP BY 1, 2",
    "e13_final_runs": f"WITH {FINAL} SELECT * FROM final",
    "e13_final_run_quantiles": f"WITH {FINAL} SELECT unnest([0.1e0, 0.3e0, 0.5e0, 0.7e0, 0.9e0]) AS quantile, round(unnest(q), 6) AS earliest, n FROM (SELECT quantile_cont(earliest, [0.1, 0.3, 0.5, 0.7, 0.9]) AS q, count(*) AS n FROM final)",
    "e14_attribution_sums": f"WITH {LONG} SELECT comp_id, bin, variable, round(attribution, 6) + 0e0 AS attribution, round(value, 6) AS value FROM sums",
    "e15_variable_ranks": f"WITH {LONG} SELECT comp_id, variable, round(strength, 6) AS strength, rank FROM ranks",
    "e14_attribution_sums_by_range": f"WITH {LONG} SELECT comp_id, bin, regexp_extract(feature, '_t_(.*)$', 1) AS time_range, round(sum(attribution), 6) + 0e0 AS attribution, count(*) AS n_features FROM attr GROUP BY 1, 2, 3",
    "e15_ranks_by_transition": f"""WITH {LONG}, {SEG.removeprefix(BASE + ', ')}, m AS (SELECT s.comp_id, segment, variable, avg(attribution) AS strength FROM sums s JOIN seg ON seg.comp_id = s.comp_id AND seg.bin = s.bin WHERE true_s < 8 GROUP BY 1, 2, 3)
        SELECT comp_id, segment, variable, round(strength, 6) + 0e0 AS strength, row_number() OVER (PARTITION BY comp_id, segment ORDER BY round(strength, 9) DESC, variable) AS rank FROM m""",
    "e15_rank_shares": f"WITH {LONG} SELECT variable, rank, n, round(n / sum(n) OVER (PARTITION BY rank), 6) AS share FROM (SELECT variable, rank, count(*) AS n FROM ranks GROUP BY 1, 2)",
    "e16_rank_flows": f"WITH {LONG} SELECT first, second, third, count(*) AS n FROM (SELECT comp_id, max(variable) FILTER (WHERE rank = 1) AS first, max(variable) FILTER (WHERE rank = 2) AS second, max(variable) FILTER (WHERE rank = 3) AS third FROM ranks GROUP BY 1) GROUP BY 1, 2, 3",
    "e18_attribution_slopes": f"""WITH {LONG}, m AS (SELECT comp_id, variable, var_pop(value) AS vx, var_pop(attribution) AS vy, covar_pop(value, attribution) AS c FROM sums GROUP BY 1, 2)
        SELECT comp_id, variable, round(CASE WHEN vx > 1e-12 THEN c / vx END, 5) AS slope, round(CASE WHEN vx > 1e-12 AND vy > 1e-12 THEN 1 - c * c / vx / vy END, 5) AS unexplained FROM m""",
    "e22_densities": f"WITH {BASE} SELECT signal, bin, n, round(n / (sum(n) OVER (PARTITION BY signal) * 2), 6) AS density FROM (SELECT true_s < 8 AS signal, CAST(floor(pred_s / 2) AS INT) AS bin, count(*) AS n FROM pred GROUP BY 1, 2)",
}
