"""Ratios and normalisations of a composition's counts: one table of formulas, applied as column expressions in one pass."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.functions.columns import safe_ratio


@dataclass(frozen=True)
class Formula:
    """`name` = `over` / `under`, SQL expressions of the counts; `zero` where both are 0, `infinite` where only `under` is. `t` is the bin's time in units, `sw` the window's."""

    name: str
    over: str
    under: str
    zero: float = 0.0
    infinite: float = 0.0


FORMULAS = (
    *(Formula(f"instability_norm_{k}", f"1 - stability_{k}", "t") for k in ("mean", "median", "percentile", "decile_mean")),
    Formula("n_changes_norm", "n_changes / t", "area"),
    Formula("frac_pixdiff_stable_vs_swref", "n_diff_stable_ref", "area"),
    Formula("frac_pixdiff_inst_vs_swref", "n_diff_inst_ref", "area"),
    Formula("frac_pixdiff_inst_vs_swref_forwardlook", "n_diff_inst_fwd", "area"),
    Formula("frac_pixdiff_inst_vs_inst_norm", "n_diff_inst_old / t", "area"),
    Formula("frac_pixdiff_inst_vs_stable_norm", "n_diff_inst_stable / t", "area"),
    Formula("frac_pixdiff_inst_vs_inst_downscaled2", "n_diff_blocks_2 / t", "area / 4"),
    Formula("frac_pixdiff_inst_vs_inst_downscaled4", "n_diff_blocks_4 / t", "area / 16"),
    Formula("n_users_norm", "n_users / t", "area"),
    Formula("n_users_sw_norm", "n_users_window / sw", "area"),
    Formula("frac_users_new_vs_sw", "n_new_vs_window", "n_users", 0.5, 0.5),
    Formula("frac_users_new_vs_previoustime", "n_new_vs_bin", "n_users", 0.5, 0.5),
    Formula("changes_per_user_sw", "n_changes_sw", "n_users_window", 1.0, 1.0),
    Formula("frac_attack_changes", "n_changes - n_defense", "n_changes", 0.5, 0.5),
    Formula("frac_defenseonly_users", "n_defenseonly_users - n_bothattdef_users", "n_users", 0.5, 0.5),  # as the surveyed work has it
    Formula("frac_bothattdef_users", "n_bothattdef_users", "n_users", 0.5, 0.5),
    Formula("frac_attackonly_users", "n_users - n_defenseonly_users - n_bothattdef_users", "n_users", 0.5, 0.5),
    Formula("entropy", "size_compressed", "area", 1.0, 10.0),
    Formula("entropy_stab_im", "size_compressed_stable", "area", 1.0, 10.0),
    Formula("entropy_bmpnorm", "size_compressed", "size_uncompressed"),
    Formula("wavelet_high_to_low", "haar_high", "haar_low", 1.0, 10.0),
    Formula("wavelet_mid_to_low", "haar_mid", "haar_low", 1.0, 10.0),
    Formula("wavelet_high_to_mid", "haar_high", "haar_mid", 1.0, 10.0),
    Formula("wavelet_high_to_low_tm", "wavelet_high", "wavelet_low", 1.0, 10.0),
    Formula("ripley_norm", "ripley", "sqrt(area)", 1.0, 10.0),
    Formula("image_shift_minpos", "shift_at", "sqrt(area)", 1.0, 10.0),
    Formula("frac_moderator_changes", "n_moderator", "n_changes"),
    Formula("frac_cooldowncheat_changes", "n_cheat", "n_changes"),
    Formula("frac_redundant_color_changes", "n_redundant_col", "n_changes"),
    Formula("frac_redundant_coloranduser_changes", "n_redundant_colanduser", "n_changes"),
)


def _needs(formula: Formula) -> set[str]:
    return set(re.findall(r"[a-z_][a-z_0-9]*", f"{formula.over} {formula.under}")) - {"sqrt", "t", "sw"}


def normalised(rows: DataFrame, width: float, window: int, unit: float) -> DataFrame:
    """`(comp_id, bin)` and every variable of FORMULAS whose counts `rows` has; `area` is the active area of the bin, `unit` the seconds in which rates are given.

    The sum of changes over the last `window` bins is made here where `n_changes` is. Rows should have no holes in `bin`, and 0 where nothing happened.
    """
    if "n_changes" in rows.columns:
        order = Window.partitionBy("comp_id").orderBy("bin").rowsBetween(-(window - 1), 0)
        rows = rows.withColumn("n_changes_sw", F.sum("n_changes").over(order))
    timed = rows.withColumns({"t": F.lit(width / unit), "sw": F.lit(width * window / unit)})

    def value(f: Formula) -> Column:
        return safe_ratio(F.expr(f.over).cast("double"), F.expr(f.under).cast("double"), f.zero, f.infinite).alias(f.name)

    return timed.select("comp_id", "bin", *(value(f) for f in FORMULAS if _needs(f) <= set(rows.columns)))


def filled_forward(every: DataFrame, sparse: DataFrame, column: str) -> DataFrame:
    """`every` (comp_id, bin, ...) with `column` of `sparse`, whose rows hold until the next one; 0 before the first."""
    held = every.join(sparse.select("comp_id", "bin", column), ["comp_id", "bin"], "left")
    return held.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(Window.partitionBy("comp_id").orderBy("bin")), F.lit(0)))
