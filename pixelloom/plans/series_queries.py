"""Registered queries on time series, transitions and warnings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.config import TEST_CANVAS
from pixelloom.operators import changes, series, state, transitions
from pixelloom.plans import composition_queries
from pixelloom.plans.canvas_queries import rounded
from pixelloom.plans.state_queries import SQL_STATE, State, SW, WIDTH
from pixelloom.plans.storage import write_shared

ABS, REL = 0.45, 1.3


def count_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active changes of every composition and bin, 0 where there are none."""
    s = State(spark, sf_dir)
    every = state.life_bins(s.pixels, WIDTH).select("comp_id", F.explode(F.sequence(F.lit(1), "n_bins")).alias("bin"))
    counts = changes.change_counts(s.changes, WIDTH).select("comp_id", "bin", "n_changes")
    filled = every.join(counts, ["comp_id", "bin"], "left")
    return filled.select("comp_id", F.lit("changes").alias("variable"), "bin", F.coalesce("n_changes", F.lit(0)).cast("double").alias("val"))


def difference_series(spark: SparkSession, sf_dir: str, s: State | None = None) -> DataFrame:
    """Share of pixels off their reference at each bin's end (`val`), and off the reference of the window ahead (`fwd_val`, 0 where there is none), either with its ratio to the
    mean before; the bin's end `t`, and whether it lies a window into a range of stable borders. s: the state, if it is known both ways already."""
    s = s or State(spark, sf_dir).both_ways()
    joined = s.instant().join(s.ref(), ["comp_id", "x", "y", "bin"]).join(s.forward(), ["comp_id", "x", "y", "bin"], "left")
    off = lambda ref: F.avg(F.coalesce((F.col("inst") != F.col(ref)).cast("double"), F.lit(0.0)))
    share = joined.groupBy("comp_id", "bin").agg(off("ref").alias("val"), off("ref_fwd").alias("fwd_val"))
    ahead = series.ratio_to_mean(share.withColumnsRenamed({"val": "own", "fwd_val": "val"}), SW, ["comp_id"]).withColumnsRenamed({"val": "fwd_val", "ratio": "fwd_ratio", "own": "val"})
    rows = series.ratio_to_mean(ahead, SW, ["comp_id"])
    ranges = composition_queries.stable_ranges(spark, sf_dir).groupBy("comp_id").agg(F.collect_list(F.struct("t0", "t1")).alias("ranges"))
    start = s.pixels.groupBy("comp_id").agg(F.min("t0").alias("t0"))
    rows = rows.join(start.join(ranges, "comp_id"), "comp_id").withColumn("t", F.col("t0") + F.col("bin") * WIDTH)
    settled = F.exists("ranges", lambda r: (F.col("t") >= r["t0"] + SW * WIDTH) & (F.col("t") <= r["t1"]))
    return rows.withColumn("settled", settled).drop("t0", "ranges")


def _counts(make):
    return lambda spark, sf_dir: make(count_series(spark, sf_dir))


def _rows(make):
    return lambda spark, sf_dir: make(write_shared(difference_series(spark, sf_dir), "difference"))


def _found(rows: DataFrame) -> DataFrame:
    return transitions.find_transitions(rows, F.lit(ABS), F.lit(REL), SW, ["comp_id"], int(SW * WIDTH), TEST_CANVAS.greyout)


def _signals(rows: DataFrame) -> DataFrame:
    moved = series.rolling_moments(rows, 10, ["comp_id"])
    return moved.unpivot(["comp_id", "bin"], ["variance", "skewness", "autocorrelation"], "signal", "val")


def _grid(rows: DataFrame) -> DataFrame:
    cuts = [(i, a, r) for i, (a, r) in enumerate((a, r) for a in (0.35, 0.45, 0.55, 0.65) for r in (1.2, 1.5, 2.0))]
    return rows.sparkSession.createDataFrame(cuts, "param int, abs_cut double, rel_cut double")


def _means(rows: DataFrame) -> DataFrame:
    return transitions.stable_means(_signals(rows), transitions.stable_periods(_found(rows), SW))


QUERIES = {
    "w_series_windows": _counts(lambda x: rounded(series.rolling_moments(series.ratio_to_mean(x, SW)), "ratio", "variance", "skewness", "autocorrelation", digits=7)),
    "w1_ratio_to_mean": _counts(lambda x: rounded(series.ratio_to_mean(x, SW), "ratio")),
    "w5_kendall": _counts(lambda x: rounded(series.rolling_kendall(x), "tau")),
    "w6_mean_square": _counts(lambda x: rounded(series.rolling_mean_square(x, SW), "mean_square")),
    "w7_mean_before": _counts(lambda x: rounded(series.mean_before(x, 5), "mean_before")),
    "w8_mean_square_deviation": _counts(lambda x: rounded(series.mean_square_deviation(x, 6), "deviation")),
    "x1_runs": _rows(lambda x: transitions.runs(x, F.col("val") > ABS, ["comp_id"], 2)),
    "x2_transitions": _rows(_found),
    "x3_merged_runs": _rows(lambda x: transitions.merge_close(transitions.runs(x, F.col("val") > ABS, ["comp_id"]), 3, ["comp_id"])),
    "x5_half_maximum": _rows(lambda x: rounded(transitions.half_maximum_times(x, _found(x), ["comp_id"]), "top")),
    "x6_start_times": _rows(lambda x: rounded(transitions.start_times(x, _found(x), ABS, REL, ["comp_id"]), "t_start")),
    "x8_sensitivity": _rows(lambda x: rounded(transitions.sensitivity(x, _grid(x), SW), "share")),
    "x9_transition_counts": _rows(lambda x: transitions.transition_counts(_found(x), x.select("comp_id").distinct())),
    "x10_warning_signals": _rows(lambda x: rounded(_signals(x), "val", digits=7)),
    "x11_stable_means": _rows(lambda x: rounded(_means(x), "stable_mean", digits=7)),
    "x12_signal_classes": _rows(lambda x: transitions.signal_classes(_signals(x), transitions.stable_periods(_found(x), SW), _means(x), 1.2, 0.8)),
    "x13_aligned": _rows(lambda x: rounded(transitions.aligned(x, _found(x), 5, 10), "val")),
    "x14_mean_aligned": _rows(lambda x: rounded(transitions.mean_aligned(transitions.aligned(x, _found(x), 5, 10)), "mean")),
    "x15_warnings": _rows(lambda x: transitions.warnings(x, 1.5, 6, ["comp_id"])),
    "x15_warning_scores": _rows(lambda x: transitions.warning_score(transitions.warnings(x, 1.5, 6, ["comp_id"]), _found(x), 12, 1)),
    "x16_significance_grid": _rows(lambda x: rounded(transitions.significance_grid(x, _found(x), [1.2, 1.5, 2.0], [1, 3, 6], 12), "mean_share")),
}

COUNTS = f"""{SQL_STATE}, series AS (SELECT b.comp_id, 'changes' AS variable, b.bin, CAST(count(c.event_id) AS DOUBLE) AS val FROM bins b LEFT JOIN binned c ON c.comp_id = b.comp_id AND c.bin = b.bin GROUP BY 1, 2, 3)"""
RATIO = "CASE WHEN m = 0 THEN 1.0 ELSE val / m END"
BEFORE = "OVER (PARTITION BY comp_id ORDER BY bin ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"
ROWS = f"""{SQL_STATE}, {composition_queries.STABLE}, share AS (SELECT comp_id, bin, avg(CASE WHEN inst <> ref THEN 1e0 ELSE 0 END) AS val, avg(CASE WHEN inst <> ref_fwd THEN 1e0 ELSE 0 END) AS fwd_val
        FROM instant JOIN ref USING (comp_id, x, y, bin) LEFT JOIN fwd USING (comp_id, x, y, bin) GROUP BY 1, 2),
    rows_ AS (SELECT m.comp_id, bin, val, {RATIO} AS ratio, fwd_val, CASE WHEN fwd_m = 0 THEN 1.0 ELSE fwd_val / fwd_m END AS fwd_ratio, b.t0 + bin * 21600 AS t,
            EXISTS (SELECT 1 FROM settled d WHERE d.comp_id = m.comp_id AND b.t0 + bin * 21600 BETWEEN d.t0 + 8 * 21600 AND d.t1) AS settled
        FROM (SELECT *, coalesce(avg(val) {BEFORE}, val) AS m, coalesce(avg(fwd_val) {BEFORE}, fwd_val) AS fwd_m FROM share) m JOIN borders b ON b.comp_id = m.comp_id)"""


def _runs(where: str) -> str:
    return f"""SELECT comp_id, min(bin) AS beg, max(bin) + 1 AS fin FROM (SELECT comp_id, bin, bin - row_number() OVER (PARTITION BY comp_id ORDER BY bin) AS g FROM rows_ WHERE {where}) GROUP BY comp_id, g"""


def _merged(source: str, gap: int) -> str:
    return f"""SELECT comp_id, trans_idx, min(beg) AS bin_beg, max(fin) AS bin_end FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY comp_id ORDER BY beg, fin) - 1 AS trans_idx FROM (
            SELECT *, CASE WHEN coalesce(beg - max(fin) OVER (PARTITION BY comp_id ORDER BY beg, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {gap}, true) THEN 1 ELSE 0 END AS fresh FROM {source})) GROUP BY 1, 2"""


FOUND = f"""{ROWS}, runs_ AS ({_runs(f'val > {ABS} AND ratio > {REL} AND bin >= 8 AND settled')}), stops AS ({_runs(f'fwd_val < {ABS} OR fwd_ratio < 1 / {REL}')}),
    starts AS (SELECT s.* FROM runs_ s WHERE (SELECT r.t FROM rows_ r WHERE r.comp_id = s.comp_id AND r.bin = least(s.beg + 1, (SELECT max(bin) FROM rows_ q WHERE q.comp_id = s.comp_id))) < 2419200),
    spans AS (SELECT s.comp_id, s.beg, coalesce(greatest((SELECT min(e.beg) FROM stops e WHERE e.comp_id = s.comp_id AND e.beg >= s.beg AND e.beg <= s.beg + 172800), s.fin), least(s.fin, s.beg + 172800)) AS fin FROM starts s),
    found AS ({_merged('spans', 8)})"""
MOMENTS = """round(coalesce(var_samp(val) OVER f, 0), 7) + 0e0 AS variance,
    round(CASE WHEN count(val) OVER f > 2 AND avg(val ** 2) OVER f - (avg(val) OVER f) ** 2 > 1e-9 * (avg(val ** 2) OVER f + 1e-9)
        THEN (avg(val ** 3) OVER f - 3 * avg(val) OVER f * avg(val ** 2) OVER f + 2 * (avg(val) OVER f) ** 3) / (avg(val ** 2) OVER f - (avg(val) OVER f) ** 2) ** 1.5
            * sqrt(count(val) OVER f * (count(val) OVER f - 1.0)) / (count(val) OVER f - 2.0) ELSE 0 END, 7) + 0e0 AS skewness,
    round(coalesce(CASE WHEN stddev_pop(now_) OVER g * stddev_pop(old) OVER g > 1e-9 THEN covar_pop(now_, old) OVER g / (stddev_pop(now_) OVER g * stddev_pop(old) OVER g) END, 0), 7) + 0e0 AS autocorrelation"""


def _window(keys: str) -> str:
    o = f"PARTITION BY {keys} ORDER BY bin ROWS BETWEEN"
    return f"WINDOW f AS ({o} 9 PRECEDING AND CURRENT ROW), g AS ({o} 8 PRECEDING AND CURRENT ROW)"


SIGNALS = f"""{FOUND}, moved AS (SELECT comp_id, bin, {MOMENTS.replace('round(', '(').replace(', 7)', ')')} FROM (SELECT *, lag(val) OVER (PARTITION BY comp_id ORDER BY bin) AS old, CASE WHEN old IS NOT NULL THEN val END AS now_ FROM rows_) {_window('comp_id')}),
    signals AS (SELECT comp_id, bin, signal, val FROM (UNPIVOT moved ON variance, skewness, autocorrelation INTO NAME signal VALUE val)),
    periods AS (SELECT comp_id, trans_idx, beg, fin, beg + (fin - beg) // 2 AS mid FROM (SELECT comp_id, trans_idx, coalesce(lag(bin_end) OVER (PARTITION BY comp_id ORDER BY trans_idx), 9) AS beg, bin_beg AS fin FROM found) WHERE fin > beg),
    means AS (SELECT p.comp_id, p.trans_idx, signal, avg(val) AS stable_mean FROM periods p JOIN signals s ON s.comp_id = p.comp_id AND bin >= beg AND bin < mid GROUP BY 1, 2, 3)"""
ALIGNED = f"""{FOUND}, lined AS (SELECT f.comp_id, trans_idx, r.bin - bin_beg AS rel, val FROM found f JOIN rows_ r ON r.comp_id = f.comp_id AND r.bin BETWEEN bin_beg - 5 AND bin_beg + 10)"""

ORACLES = {
    "w_series_windows": f"""WITH {COUNTS}, r AS (SELECT *, {RATIO} AS ratio FROM (SELECT *, lag(val) OVER (PARTITION BY comp_id ORDER BY bin) AS old, CASE WHEN old IS NOT NULL THEN val END AS now_,
            coalesce(avg(val) OVER (PARTITION BY comp_id ORDER BY bin ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), val) AS m FROM series))
        SELECT comp_id, variable, bin, val, round(ratio, 7) + 0e0 AS ratio, {MOMENTS} FROM r {_window('comp_id')}""",
    "w1_ratio_to_mean": f"""WITH {COUNTS} SELECT comp_id, variable, bin, val, round({RATIO}, 6) AS ratio
        FROM (SELECT *, coalesce(avg(val) OVER (PARTITION BY comp_id ORDER BY bin ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), val) AS m FROM series)""",
    "w5_kendall": f"""WITH {COUNTS}, p AS (SELECT a.comp_id, a.variable, a.bin, a.val, (SELECT count(*) FROM series c WHERE c.comp_id = a.comp_id AND c.bin BETWEEN a.bin - 9 AND a.bin) AS n,
            (SELECT count(DISTINCT val) FROM series c WHERE c.comp_id = a.comp_id AND c.bin BETWEEN a.bin - 9 AND a.bin) AS m,
            (SELECT coalesce(sum(sign(d.val - c.val)), 0) FROM series c JOIN series d ON c.comp_id = d.comp_id AND c.bin < d.bin WHERE c.comp_id = a.comp_id AND c.bin >= a.bin - 9 AND d.bin <= a.bin) AS s FROM series a)
        SELECT comp_id, variable, bin, val, round(CASE WHEN m > 1 THEN 2.0 * s / (n * n * (m - 1e0) / m) ELSE 0 END, 6) AS tau FROM p""",
    "w6_mean_square": f"WITH {COUNTS} SELECT *, round(avg(val * val) OVER (PARTITION BY comp_id ORDER BY bin ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS mean_square FROM series",
    "w7_mean_before": f"WITH {COUNTS} SELECT *, round(avg(val) OVER (PARTITION BY comp_id ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS mean_before FROM series",
    "w8_mean_square_deviation": f"""WITH {COUNTS}, d AS (SELECT *, val - avg(val) OVER (PARTITION BY comp_id ORDER BY bin ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS d FROM series)
        SELECT comp_id, variable, bin, val, round(avg(d * d) OVER (PARTITION BY comp_id ORDER BY bin ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS deviation FROM d""",
    "x1_runs": f"WITH {ROWS} SELECT * FROM ({_runs(f'val > {ABS}')}) WHERE fin - beg >= 2",
    "x2_transitions": f"WITH {FOUND} SELECT * FROM found",
    "x3_merged_runs": f"WITH {ROWS}, spans AS ({_runs(f'val > {ABS}')}) {_merged('spans', 3)}",
    "x5_half_maximum": f"""WITH {FOUND} SELECT comp_id, trans_idx, min(bin) AS bin_half, round(any_value(top), 6) AS top FROM (SELECT f.*, bin, val, max(val) OVER (PARTITION BY f.comp_id, trans_idx) AS top FROM found f JOIN rows_ r ON r.comp_id = f.comp_id AND bin >= bin_beg AND bin < bin_end)
        WHERE val > top / 2 GROUP BY 1, 2""",
    "x6_start_times": f"""WITH {FOUND}, o AS (SELECT *, lag(val) OVER (PARTITION BY comp_id ORDER BY bin) AS ov, lag(ratio) OVER (PARTITION BY comp_id ORDER BY bin) AS orr FROM rows_)
        SELECT f.comp_id, trans_idx, round(greatest(CASE WHEN ov < {ABS} AND val > ov THEN bin - 1 + ({ABS} - ov) / (val - ov) ELSE bin - 1 END, CASE WHEN orr < {REL} AND ratio > orr THEN bin - 1 + ({REL} - orr) / (ratio - orr) ELSE bin - 1 END), 6) AS t_start
        FROM found f JOIN o ON o.comp_id = f.comp_id AND o.bin = f.bin_beg""",
    "x8_sensitivity": f"""WITH {ROWS}, grid AS (SELECT row_number() OVER (ORDER BY a, r) - 1 AS param, a AS abs_cut, r AS rel_cut FROM (VALUES (0.35e0), (0.45e0), (0.55e0), (0.65e0)) x(a), (VALUES (1.2e0), (1.5e0), (2e0)) y(r))
        SELECT param, abs_cut, rel_cut, round((SELECT count(DISTINCT comp_id) FROM rows_ WHERE val > abs_cut AND ratio > rel_cut AND bin >= 8) / (SELECT count(DISTINCT comp_id) FROM rows_), 6) AS share FROM grid""",
    "x9_transition_counts": f"""WITH {FOUND} SELECT (SELECT count(DISTINCT comp_id) FROM rows_) AS n_comps, (SELECT count(*) FROM found) AS n_transitions, (SELECT count(DISTINCT comp_id) FROM found) AS n_with_transition,
        coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM found GROUP BY comp_id)), 0) AS most""",
    "x10_warning_signals": f"WITH {SIGNALS} SELECT comp_id, bin, signal, round(val, 7) + 0e0 AS val FROM signals",
    "x11_stable_means": f"WITH {SIGNALS} SELECT comp_id, trans_idx, signal, round(stable_mean, 7) + 0e0 AS stable_mean FROM means",
    "x12_signal_classes": f"""WITH {SIGNALS} SELECT p.comp_id, p.trans_idx, s.signal, CASE WHEN bool_or(val >= 1.2 * stable_mean) AND bool_or(val <= 0.8 * stable_mean) THEN 'both' WHEN bool_or(val >= 1.2 * stable_mean) THEN 'high'
        WHEN bool_or(val <= 0.8 * stable_mean) THEN 'low' ELSE 'none' END AS kind FROM periods p JOIN signals s ON s.comp_id = p.comp_id AND bin >= mid AND bin < fin JOIN means m ON m.comp_id = p.comp_id AND m.trans_idx = p.trans_idx AND m.signal = s.signal GROUP BY 1, 2, 3""",
    "x13_aligned": f"WITH {ALIGNED} SELECT comp_id, trans_idx, rel, round(val, 6) AS val FROM lined",
    "x14_mean_aligned": f"WITH {ALIGNED} SELECT rel, round(avg(val / top), 6) AS mean, count(*) AS n FROM (SELECT *, max(val) OVER (PARTITION BY comp_id, trans_idx) AS top FROM lined) WHERE top > 0 GROUP BY 1",
}
