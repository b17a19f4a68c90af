"""The registered query of all normalised variables of the state and the changes, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import attack_defense as ad
from pixelloom.operators import changes, complexity, normalise, state
from pixelloom.plans.canvas_queries import rounded
from pixelloom.plans.complexity_queries import IMAGES, _modes
from pixelloom.plans.state_queries import SW, WIDTH, State
from pixelloom.plans.storage import write_shared

UNIT = 3600.0
KEY = ["comp_id", "bin"]


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of every composition and bin that the formulas of changes, users, differences and stability need."""
    s = State(spark, sf_dir).both_ways()
    instant, ref, forward = write_shared(s.instant(), "instant"), s.ref(), s.forward()
    stable = write_shared(state.stable_images(s.times), "stable")
    every = state.life_bins(s.pixels, WIDTH).select("comp_id", F.explode(F.sequence(F.lit(1), "n_bins")).alias("bin"))
    area = instant.groupBy(*KEY).agg(F.count("*").alias("area"))
    fought = ad.attack_defense(ad.agreement(s.changes, ref, WIDTH)).drop("n_users")
    steady = state.integrated_stats(state.pixel_stability(s.times), "stability").withColumnsRenamed({c: f"stability_{c}" for c in ("mean", "median", "percentile", "decile_mean")})
    old = instant.select("comp_id", "x", "y", (F.col("bin") + 1).alias("bin"), F.col("inst").alias("color"))
    blocks = complexity.differing_blocks(instant.withColumnRenamed("inst", "color"), old, 2).select(*KEY, F.col("n_diff").alias("n_diff_blocks_2"))
    wide = every
    for part in (area, changes.change_counts(s.changes, WIDTH), ad.new_users(s.changes, WIDTH, SW), fought, state.differing_pixels(stable, instant, ref, forward), steady, blocks):
        wide = wide.join(part, KEY, "left")
    return normalise.filled_forward(wide, ad.window_users(s.changes, WIDTH, SW), "n_users_window").na.fill(0)


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalise.normalised(write_shared(counts(spark, sf_dir), "counts"), WIDTH, SW, UNIT)
    return rounded(found, *found.columns[2:], digits=7)


QUERIES = {"t28_normalised_variables": _normalised}

T, SWT = WIDTH / UNIT, WIDTH * SW / UNIT
#: The surveyed formulas: name, numerator, denominator, value where the denominator is 0.
RATIOS = [
    *((f"instability_norm_{k}", f"(1 - st_{k})", f"{T}", 0) for k in ("mean", "median", "percentile", "decile_mean")),
    ("n_changes_norm", f"(n_changes / {T})", "area", 0), ("frac_pixdiff_stable_vs_swref", "d_stable_ref", "area", 0), ("frac_pixdiff_inst_vs_swref", "d_inst_ref", "area", 0),
    ("frac_pixdiff_inst_vs_swref_forwardlook", "d_inst_fwd", "area", 0), ("frac_pixdiff_inst_vs_inst_norm", f"(d_inst_old / {T})", "area", 0), ("frac_pixdiff_inst_vs_stable_norm", f"(d_inst_stable / {T})", "area", 0),
    ("frac_pixdiff_inst_vs_inst_downscaled2", f"(d_blocks / {T})", "(area / 4)", 0), ("n_users_norm", f"(n_users / {T})", "area", 0), ("n_users_sw_norm", f"(n_users_sw / {SWT})", "area", 0),
    ("frac_users_new_vs_sw", "new_sw", "n_users", 0.5), ("frac_users_new_vs_previoustime", "new_bin", "n_users", 0.5), ("changes_per_user_sw", "n_changes_sw", "n_users_sw", 1),
    ("frac_attack_changes", "(n_changes - n_def)", "n_changes", 0.5), ("frac_defenseonly_users", "(u_def - u_both)", "n_users", 0.5), ("frac_bothattdef_users", "u_both", "n_users", 0.5),
    ("frac_attackonly_users", "(n_users - u_def - u_both)", "n_users", 0.5), ("frac_moderator_changes", "n_mod", "n_changes", 0), ("frac_cooldowncheat_changes", "n_cheat", "n_changes", 0),
    ("frac_redundant_color_changes", "n_rc", "n_changes", 0), ("frac_redundant_coloranduser_changes", "n_rcu", "n_changes", 0),
]
ZEROS = ("area", "n_changes", "n_mod", "n_cheat", "n_rc", "n_rcu", "n_users", "n_users_sw", "new_sw", "new_bin", "n_def", "u_def", "u_both", "d_stable_ref", "d_inst_ref", "d_inst_fwd", "d_inst_old", "d_inst_stable", "d_blocks", "st_mean", "st_median", "st_percentile", "st_decile_mean")

ORACLES = {
    "t28_normalised_variables": f"""WITH {IMAGES}, oldimg AS (SELECT comp_id, bin, x - min(x) OVER i AS x, y - min(y) OVER i AS y, color FROM (SELECT comp_id, bin + 1 AS bin, x, y, inst AS color FROM instant) WINDOW i AS (PARTITION BY comp_id, bin)),
        blocks AS (SELECT a.comp_id, a.bin, count(*) FILTER (WHERE a.color <> b.color) AS d_blocks FROM {_modes(2)} a JOIN {_modes(2, 'oldimg')} b ON a.comp_id = b.comp_id AND a.bin = b.bin AND a.bx = b.bx AND a.by_ = b.by_ GROUP BY 1, 2),
        area AS (SELECT comp_id, bin, count(*) AS area FROM instant GROUP BY 1, 2),
        n AS (SELECT comp_id, bin, count(*) AS n_changes, count(*) FILTER (WHERE moderator) AS n_mod, count(*) FILTER (WHERE cooldown_cheat) AS n_cheat, count(*) FILTER (WHERE redundant_col) AS n_rc, count(*) FILTER (WHERE redundant_colanduser) AS n_rcu, count(DISTINCT "user") AS n_users FROM binned GROUP BY 1, 2),
        fresh AS (SELECT a.comp_id, a.bin, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.comp_id = a.comp_id AND b."user" = a."user" AND b.bin = a.bin - 1)) AS new_bin,
            count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.comp_id = a.comp_id AND b."user" = a."user" AND b.bin BETWEEN a.bin - {SW} AND a.bin - 1)) AS new_sw FROM seen a GROUP BY 1, 2),
        sw AS (SELECT e.comp_id, e.bin, count(DISTINCT s."user") AS n_users_sw FROM bins e JOIN seen s ON s.comp_id = e.comp_id AND s.bin BETWEEN e.bin - {SW - 1} AND e.bin GROUP BY 1, 2),
        u AS (SELECT comp_id, bin, "user", count(*) FILTER (WHERE defense) AS d, count(*) FILTER (WHERE NOT defense) AS a FROM agreed GROUP BY 1, 2, 3),
        att AS (SELECT comp_id, bin, sum(d) AS n_def, count(*) FILTER (WHERE a = 0) AS u_def, count(*) FILTER (WHERE a > 0 AND d > 0) AS u_both FROM u GROUP BY 1, 2),
        px AS (SELECT s.comp_id, s.x, s.y, s.bin, stable1, inst, ref, ref_fwd FROM stable s LEFT JOIN instant USING (comp_id, x, y, bin) LEFT JOIN ref USING (comp_id, x, y, bin) LEFT JOIN fwd USING (comp_id, x, y, bin)),
        diff AS (SELECT a.comp_id, a.bin, count(*) FILTER (WHERE a.stable1 <> a.ref) AS d_stable_ref, count(*) FILTER (WHERE a.inst <> a.ref) AS d_inst_ref, count(*) FILTER (WHERE a.inst <> a.ref_fwd) AS d_inst_fwd,
            count(*) FILTER (WHERE a.inst <> b.inst) AS d_inst_old, count(*) FILTER (WHERE a.inst <> b.stable1) AS d_inst_stable FROM px a LEFT JOIN px b ON a.comp_id = b.comp_id AND a.x = b.x AND a.y = b.y AND a.bin = b.bin + 1 GROUP BY 1, 2),
        o AS (SELECT *, count(*) OVER (PARTITION BY comp_id, bin) AS n, row_number() OVER (PARTITION BY comp_id, bin ORDER BY stability, x, y) - 1 AS i FROM stability), e AS (SELECT *, CASE WHEN n >= 10 THEN n - n // 10 ELSE 0 END AS edge FROM o),
        st AS (SELECT comp_id, bin, avg(stability) AS st_mean, max(stability) FILTER (WHERE i = n // 2) AS st_median, max(stability) FILTER (WHERE i = edge) AS st_percentile, avg(stability) FILTER (WHERE i >= edge) AS st_decile_mean FROM e GROUP BY 1, 2),
        w AS (SELECT b.comp_id, b.bin, {', '.join(f'coalesce({z}, 0) AS {z}' for z in ZEROS)} FROM bins b LEFT JOIN area USING (comp_id, bin) LEFT JOIN n USING (comp_id, bin) LEFT JOIN fresh USING (comp_id, bin) LEFT JOIN sw USING (comp_id, bin)
            LEFT JOIN att USING (comp_id, bin) LEFT JOIN diff USING (comp_id, bin) LEFT JOIN st USING (comp_id, bin) LEFT JOIN blocks USING (comp_id, bin)),
        v AS (SELECT *, sum(n_changes) OVER (PARTITION BY comp_id ORDER BY bin ROWS BETWEEN {SW - 1} PRECEDING AND CURRENT ROW) AS n_changes_sw FROM w)
        SELECT comp_id, bin, {', '.join(f'round(CASE WHEN {b} = 0 THEN {zero}e0 ELSE {a} / {b} END, 7) + 0e0 AS {name}' for name, a, b, zero in RATIOS)} FROM v""",
}
