"""Registered queries on compositions from a table that grows, and on further figures of transitions, users, colours and images, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.config import DAY, TEST_CANVAS
from pixelloom.operators import attack_defense as ad
from pixelloom.operators import canvas, changes, complexity, compositions, evaluation, nullmodels, state, transitions, users
from pixelloom.plans import canvas_queries, composition_queries
from pixelloom.plans.canvas_queries import rounded
from pixelloom.plans.entropy_queries import images
from pixelloom.plans.series_queries import FOUND, _found, difference_series
from pixelloom.plans.state_queries import SQL_STATE, SW, WIDTH, State
from pixelloom.plans.storage import write_shared
from pixelloom.plans.table_queries import VARIABLES, variables
from pixelloom.plans.training_queries import BASE, CUTS, TRUTH, Table, _counts
from pixelloom.plans.user_queries import ORACLES as USER_ORACLES
from pixelloom.plans.user_queries import WEIGHTS, points
from pixelloom.sources import adapter
from pixelloom.sources.adapter import SQL_BORDERS, SQL_LOG, SQL_MANY_BORDERS, SQL_PIXELS

FIVE = ("off_share", "n_changes", "n_attack", "n_attackonly_users", "n_users")
ORDER = [3, 0, 4, 2]


def many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.rectangle_pixels(adapter.many_borders(spark, sf_dir))


def halves(pixels: DataFrame) -> DataFrame:
    """The pixels with their range in two halves; in odd columns a day is missing between them."""
    mid = (F.col("t0") + F.col("t1")) / 2
    second = pixels.withColumn("t0", F.when(F.col("x") % 2 == 1, mid + DAY).otherwise(mid))
    return pixels.withColumn("t1", mid).unionByName(second.where("t1 > t0"))


def jumping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three borders of each customer's rectangle in turn, an hour apart: the second stays, moves by a pixel, or by fifty; the third is the first again."""
    b = adapter.many_borders(spark, sf_dir)
    k = F.substring("comp_id", 2, 19).cast("int")
    step = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(50)), k % 3 + 1)
    each = b.withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("step", F.when(F.col("seq") == 1, step).otherwise(0))
    third = (F.col("t1") - F.col("t0")) / 3
    rows = each.select(
        "comp_id", "seq", (F.col("x0") + F.col("step")).alias("x0"), (F.col("x1") + F.col("step")).alias("x1"), "y0", "y1",
        (F.col("t0") + third * F.col("seq")).alias("t0"), (F.col("t0") + third * (F.col("seq") + 1) - 3600).alias("t1"),
    )
    across = rows.withColumn("x", F.explode(F.sequence("x0", "x1")))
    return rows.select("comp_id", "seq", "t0", "t1"), across.select("comp_id", "seq", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def five_series(spark: SparkSession, sf_dir: str, s: State) -> DataFrame:
    wide = variables(spark, sf_dir, s).select("comp_id", "bin", *(F.col(c).cast("double").alias(c) for c in FIVE))
    return wide.unpivot(["comp_id", "bin"], list(FIVE), "variable", "val")


def _found_in(spark: SparkSession, sf_dir: str, s: State) -> DataFrame:
    return write_shared(_found(write_shared(difference_series(spark, sf_dir, s), "difference")), "transitions")


def _half_maximum_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = State(spark, sf_dir).both_ways()
    found = transitions.half_maximum_starts(five_series(spark, sf_dir, s), _found_in(spark, sf_dir, s))
    return rounded(found, "mean", "median", "deviation")


def _transition_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = State(spark, sf_dir).both_ways()
    return transitions.transition_images(_found_in(spark, sf_dir, s), s.ref(), s.instant())


def _groups(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = State(spark, sf_dir).both_ways()
        return make(s.changes, s.ref(), s.forward(), WIDTH)

    return run


def _open_canvas(spark: SparkSession) -> DataFrame:
    """The pixels of the test canvas with the opening time of their section."""
    sections = adapter.sections(spark).withColumn("x", F.explode(F.sequence("xmin", "xmax"))).withColumn("y", F.explode(F.sequence("ymin", "ymax")))
    return sections.groupBy("x", "y").agg(F.min("t_open").alias("t_open"))


def _differing(factor: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = State(spark, sf_dir).shared()
        return complexity.differing_blocks(s.instant().withColumnRenamed("inst", "color"), s.ref().withColumnRenamed("ref", "color"), factor)

    return run


QUERIES = {
    "c3_split_at_jumps": lambda s, d: compositions.split_at_jumps(*jumping(s, d)),
    "c4_overlaps_of_many": lambda s, d: rounded(compositions.overlaps(many(s, d)), "overlap"),
    "c8_merged_ranges_of_many": lambda s, d: compositions.merge_ranges(halves(many(s, d))),
    "c11_lives_of_many": lambda s, d: compositions.life(many(s, d), TEST_CANVAS.whiteout),
    "c16_rejected_overlaps_of_many": lambda s, d: compositions.rejected_overlaps(many(s, d), 0.3),
    "c18_pixel_owners_of_many": lambda s, d: compositions.pixel_owners(many(s, d)),
    "c18_free_pixels": lambda s, d: compositions.free_pixels(_open_canvas(s), composition_queries.pixels(s, d), TEST_CANVAS.total),
    "c19_size_distribution_of_many": lambda s, d: compositions.size_distribution(many(s, d)),
    "m2_area_weights_of_many": lambda s, d: rounded(nullmodels.pixel_weights(many(s, d), 0.5), "weight"),
    "m3_perimeter_weights_of_many": lambda s, d: nullmodels.perimeter_weights(many(s, d)),
    "x5_half_maximum_starts": _half_maximum_starts,
    "x7_transition_images": lambda s, d: rounded(_transition_images(s, d), "before_after", "before_amid", "amid_after"),
    "t12_differing_blocks_of_four": _differing(4),
    "t26_lifetime_groups": _groups(ad.lifetime_groups),
    "t26_outgroup_changes": _groups(ad.outgroup_changes),
    "g8_pixel_change_figures": canvas_queries._log(lambda x: rounded(canvas.pixel_change_figures(x, 10, 10), "mean", "median")),
    "g10_colors_in_order": canvas_queries._log(lambda x: canvas.colors_in_order(x, ORDER)),
    "g12_gap_histograms": canvas_queries._log(lambda x: canvas.figure_histogram(canvas.gap_statistics(x), ["mean", "least", "median"], 2.0)),
    "u11_fit_intervals": lambda s, d: rounded(users.fit_intervals(points(s, d)), "slope", "slope_low", "slope_high", "intercept", "intercept_low", "intercept_high", digits=5),
    "e8_weighted_errors": lambda s, d: rounded(evaluation.weighted_errors(Table(s, d).predictions(), 1 / (F.col("true_s") + 1)), "mean", "rms"),
    "e10_rate_bands": lambda s, d: (lambda x: rounded(x, *[c for c in x.columns if "_" in c and c != "n_comps"]))(evaluation.rate_bands(evaluation.threshold_counts(Table(s, d).predictions(), TRUTH, CUTS, ("comp_id",)), [0.25, 0.5, 0.75])),
    "i9_rolling_wavelets": lambda s, d: rounded(complexity.rolling_wavelets(difference_series(s, d).select("comp_id", "bin", "val"), SW), "val", "low", "high"),
    "i16_shift_profiles": lambda s, d: complexity.shift_profiles(images(s, d)),
    "i17_shift_descriptors": lambda s, d: rounded(complexity.shift_descriptors(write_shared(complexity.shift_profiles(images(s, d)), "profiles")), "least", "slope"),
}


def _many(sql: str) -> str:
    assert SQL_BORDERS in sql
    return sql.replace(SQL_BORDERS, SQL_MANY_BORDERS)


K = "CAST(comp_id[2:] AS INT)"
OWN = composition_queries.ORACLES
INNER = f"""{SQL_STATE}, io AS (SELECT b.comp_id, b.bin, b.event_id, b."user", (b.color = r.ref OR coalesce(b.color = f.ref_fwd, false)) AS inner_ FROM binned b JOIN ref r USING (comp_id, x, y, bin) LEFT JOIN fwd f USING (comp_id, x, y, bin))"""

ORACLES = {
    "c3_split_at_jumps": f"""WITH {SQL_MANY_BORDERS}, b AS (SELECT comp_id, {K} % 3 AS kind, x1 - x0 AS w, t0, (t1 - t0) / 3 AS h FROM borders)
        SELECT comp_id, comp_id AS entry, 0 AS seq, t0, t0 + 3 * h - 3600 AS t1 FROM b WHERE kind = 0
        UNION ALL SELECT comp_id, comp_id, i, t0 + h * i, CASE WHEN i < 2 THEN t0 + h * (i + 1) ELSE t0 + 3 * h - 3600 END FROM b, range(3) r(i) WHERE kind = 1 AND w >= 1
        UNION ALL SELECT comp_id || '_part1', comp_id, 0, t0, t0 + 3 * h - 3600 FROM b WHERE kind = 2 OR (kind = 1 AND w < 1)
        UNION ALL SELECT comp_id || '_part2', comp_id, 0, t0 + h, t0 + 2 * h - 3600 FROM b WHERE kind = 2 OR (kind = 1 AND w < 1)""",
    "c4_overlaps_of_many": _many(OWN["c4_overlaps"]),
    "c8_merged_ranges_of_many": f"""WITH {SQL_MANY_BORDERS}, {SQL_PIXELS.replace(SQL_BORDERS + ', ', '')} SELECT comp_id, x, y, t0, (t0 + t1) / 2 AS t1 FROM pixels WHERE x % 2 = 1 UNION ALL SELECT comp_id, x, y, (t0 + t1) / 2 + 86400, t1 FROM pixels WHERE x % 2 = 1 AND t1 > (t0 + t1) / 2 + 86400
        UNION ALL SELECT comp_id, x, y, t0, t1 FROM pixels WHERE x % 2 = 0""",
    "c11_lives_of_many": _many(OWN["c11_lives"]),
    "c16_rejected_overlaps_of_many": _many(OWN["c16_rejected_overlaps"]),
    "c18_pixel_owners_of_many": _many(OWN["c18_pixel_owners"]),
    "c18_free_pixels": f"""WITH {SQL_PIXELS}, cells AS (SELECT x, y, CASE WHEN x <= 4 THEN 0e0 ELSE 432000 END AS t_open FROM range(10) a(x), range(10) b(y)),
        ends AS (SELECT x, y, t_open, t_open AS t FROM cells UNION SELECT x, y, t_open, 2592000e0 FROM cells UNION SELECT x, y, t_open, t FROM cells JOIN (SELECT x, y, t0 AS t FROM pixels UNION SELECT x, y, t1 FROM pixels) USING (x, y) WHERE t > t_open AND t < 2592000),
        s AS (SELECT x, y, t AS a, lead(t) OVER (PARTITION BY x, y ORDER BY t) AS b FROM ends), f AS (SELECT * FROM s WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pixels p WHERE p.x = s.x AND p.y = s.y AND p.t0 <= a AND p.t1 >= b)),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY x, y ORDER BY a) AS grp FROM (SELECT *, CASE WHEN a = lag(b) OVER (PARTITION BY x, y ORDER BY a) THEN 0 ELSE 1 END AS fresh FROM f)) SELECT x, y, min(a) AS t_beg, max(b) AS t_end FROM g GROUP BY x, y, grp""",
    "c19_size_distribution_of_many": _many(OWN["c19_size_distribution"]),
    "m2_area_weights_of_many": _many(f"WITH {WEIGHTS} SELECT x, y, round(weight, 6) AS weight FROM weight"),
    "m3_perimeter_weights_of_many": _many(USER_ORACLES["m3_perimeter_weights"]),
    "x5_half_maximum_starts": f"""WITH {FOUND}, {VARIABLES.replace(SQL_STATE + ', ', '').replace('share AS', 'share_ AS').replace('LEFT JOIN share ', 'LEFT JOIN share_ ')}, long_ AS (SELECT comp_id, bin, variable, CAST(val AS DOUBLE) AS val FROM (SELECT comp_id, bin, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FIVE)} FROM variables) UNPIVOT (val FOR variable IN ({', '.join(FIVE)}))),
        l AS (SELECT *, lag(val) OVER (PARTITION BY comp_id, variable ORDER BY bin) AS old FROM long_), i AS (SELECT l.*, trans_idx, max(val) OVER (PARTITION BY l.comp_id, trans_idx, variable) / 2 AS half FROM l JOIN found f ON f.comp_id = l.comp_id AND bin >= bin_beg - 1 AND bin <= bin_end),
        h AS (SELECT * FROM i WHERE val > half QUALIFY row_number() OVER (PARTITION BY comp_id, trans_idx, variable ORDER BY bin) = 1), a AS (SELECT comp_id, trans_idx, CASE WHEN old <= half THEN bin - 1 + (half - old) / (val - old) ELSE bin - 1 END AS at_ FROM h)
        SELECT comp_id, trans_idx, round(avg(at_), 6) AS mean, round(quantile_cont(at_, 0.5), 6) AS median, round(stddev_pop(at_), 6) AS deviation, count(*) AS n_variables FROM a GROUP BY 1, 2""",
    "x7_transition_images": f"""WITH {FOUND} SELECT f.comp_id, trans_idx, round(avg(CASE WHEN b.ref <> a.ref THEN 1e0 ELSE 0 END), 6) AS before_after, round(avg(CASE WHEN b.ref <> m.inst THEN 1e0 ELSE 0 END), 6) AS before_amid, round(avg(CASE WHEN m.inst <> a.ref THEN 1e0 ELSE 0 END), 6) AS amid_after, count(*) AS n_pixels
        FROM found f JOIN ref b ON b.comp_id = f.comp_id AND b.bin = bin_beg JOIN ref a ON a.comp_id = f.comp_id AND a.x = b.x AND a.y = b.y AND a.bin = bin_end JOIN instant m ON m.comp_id = f.comp_id AND m.x = b.x AND m.y = b.y AND m.bin = (bin_beg + bin_end) // 2 GROUP BY 1, 2""",
    "t26_lifetime_groups": f"""WITH {INNER}, u AS (SELECT comp_id, "user", count(*) FILTER (WHERE inner_) AS i, count(*) FILTER (WHERE NOT inner_) AS o FROM io GROUP BY 1, 2)
        SELECT comp_id, count(*) AS n_users, count(*) FILTER (WHERE o = 0) AS n_in_only, count(*) FILTER (WHERE i = 0) AS n_out_only, count(*) FILTER (WHERE i > 0 AND o > 0) AS n_both FROM u GROUP BY 1""",
    "t26_outgroup_changes": f"WITH {INNER} SELECT comp_id, event_id, bin FROM io WHERE NOT inner_",
    "g8_pixel_change_figures": f"WITH {SQL_LOG}, n AS (SELECT gx.x, gy.y, count(l.event_id) AS n FROM range(10) gx(x) CROSS JOIN range(10) gy(y) LEFT JOIN log l ON l.x = gx.x AND l.y = gy.y GROUP BY 1, 2) SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median FROM n",
    "g10_colors_in_order": f"WITH {SQL_LOG}, c AS (SELECT color, count(*) AS n FROM log GROUP BY 1) SELECT coalesce(c.color, p.color) AS color, coalesce(place, 4 + c.color) AS place, coalesce(n, 0) AS n_changes FROM c FULL JOIN (VALUES (0, 3), (1, 0), (2, 4), (3, 2)) p(place, color) ON p.color = c.color",
    "g12_gap_histograms": f"""{canvas_queries.GAPS}, f AS (SELECT avg(gap) AS mean, min(gap) AS least, quantile_cont(gap, 0.5) AS median FROM gaps GROUP BY "user") SELECT figure, CAST(floor(log10(value) * 2) AS INT) AS bin, count(*) AS n FROM (UNPIVOT f ON mean, least, median INTO NAME figure VALUE value) WHERE value > 0 GROUP BY 1, 2""",
    "e8_weighted_errors": f"WITH {BASE} SELECT round(sum(e / (true_s + 1)) / sum(1 / (true_s + 1)), 6) AS mean, round(sqrt(sum(e * e / (true_s + 1)) / sum(1 / (true_s + 1))), 6) AS rms FROM (SELECT *, abs(pred_s - true_s) / true_s AS e FROM pred WHERE true_s > 0)",
    "e10_rate_bands": f"WITH {BASE}, {_counts('comp_id')} SELECT i, cut, {', '.join(f'round(quantile_cont({r}, {q}), 6) AS {r}_{round(100 * q)}' for r in ('tpr', 'fpr') for q in (0.25, 0.5, 0.75))}, count(*) AS n_comps FROM counts GROUP BY 1, 2",
}
