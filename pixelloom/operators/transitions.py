"""Runs, transitions, early-warning signals and warnings of time series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(rows: DataFrame, condition: Column, keys: list[str], least: int = 1) -> DataFrame:
    """`(keys, beg, fin)` of the longest stretches of bins where `condition` holds; `fin` is exclusive."""
    hits = rows.where(condition).select(*keys, "bin")
    grouped = hits.withColumn("g", F.col("bin") - F.row_number().over(Window.partitionBy(*keys).orderBy("bin")))
    found = grouped.groupBy(*keys, "g").agg(F.min("bin").alias("beg"), (F.max("bin") + 1).alias("fin")).drop("g")
    return found.where(F.col("fin") - F.col("beg") >= least)


def merge_close(spans: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """Spans that begin `gap` or less after the largest end so far become one; `trans_idx` counts from 0."""
    order = Window.partitionBy(*keys).orderBy("beg", "fin")
    reach = F.max("fin").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.coalesce(F.col("beg") - reach > gap, F.lit(True)).cast("int"))
    grouped = fresh.withColumn("trans_idx", F.sum("fresh").over(order) - 1)
    return grouped.groupBy(*keys, "trans_idx").agg(F.min("beg").alias("bin_beg"), F.max("fin").alias("bin_end"))


def find_transitions(rows: DataFrame, absolute: Column, relative: Column, window: int, keys: list[str], reach: int, greyout: float = float("inf")) -> DataFrame:
    """Transitions `(keys, trans_idx, bin_beg, bin_end)` of series (keys, bin, t, settled, val, ratio, fwd_val, fwd_ratio); `bin_end` is exclusive.

    A run is of bins from `window` on, in `settled` borders, with `val` above the absolute and `ratio` above the relative cut; it counts unless the bin after its first (or the last of the series)
    ends at `greyout` or later. It is calm where the forward-looking `fwd_val` is below the absolute cut or `fwd_ratio` below the inverse relative one. A
    transition ends where the first calm stretch begins that begins with the run or after it, `reach` bins after at most, but not before the run itself ends; without such a
    stretch it ends with the run, or `reach` bins after its beginning if that is sooner. Those that begin `window` or less after another's end are one with it.

    The surveyed work hands over `reach` as the window's seconds and compares it with numbers of bins, so there it is any later bin.
    """
    late = F.coalesce(F.lead("t").over(Window.partitionBy(*keys).orderBy("bin")), F.col("t")) >= greyout
    above = (F.col("val") > absolute) & (F.col("ratio") > relative) & (F.col("bin") >= window) & F.col("settled")
    grey = rows.select(*keys, F.col("bin").alias("beg"), late.alias("late")).where("late")
    starts = runs(rows, above, keys).join(grey, [*keys, "beg"], "left_anti")
    calm = runs(rows, (F.col("fwd_val") < absolute) | (F.col("fwd_ratio") < 1 / relative), keys)
    # the first calm stretch at or after each run's beginning: both in one order, the next by a window, no range join
    nothing = F.lit(None).cast("int")
    marks = starts.select(*keys, F.col("beg").alias("at"), "beg", "fin", nothing.alias("calm"), F.lit(0).alias("kind")).unionByName(
        calm.select(*keys, F.col("beg").alias("at"), nothing.alias("beg"), nothing.alias("fin"), F.col("beg").alias("calm"), F.lit(1).alias("kind"))
    )
    ahead = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    spans = marks.withColumn("next", F.min("calm").over(ahead)).where("kind = 0")
    end = F.when(F.col("next") <= F.col("beg") + reach, F.greatest("next", "fin")).otherwise(F.least("fin", F.col("beg") + reach))
    return merge_close(spans.select(*keys, "beg", end.alias("fin")), window, keys)


def start_times(rows: DataFrame, transitions: DataFrame, absolute: float, relative: float, keys: list[str]) -> DataFrame:
    """`t_start`: the later of the times at which value and ratio cross their cuts before `bin_beg`, interpolated between bin numbers."""
    order = Window.partitionBy(*keys).orderBy("bin")
    with_old = rows.withColumns({"old_val": F.lag("val").over(order), "old_ratio": F.lag("ratio").over(order)})

    def crossing(old: str, new: str, cut: float) -> Column:
        rising = (F.col(old) < cut) & (F.col(new) > F.col(old))
        return F.when(rising, F.col("bin") - 1 + (cut - F.col(old)) / (F.col(new) - F.col(old))).otherwise((F.col("bin") - 1).cast("double"))

    joined = transitions.join(with_old.withColumnRenamed("bin", "bin_beg").withColumn("bin", F.col("bin_beg")), [*keys, "bin_beg"])
    return joined.select(*keys, "trans_idx", F.greatest(crossing("old_val", "val", absolute), crossing("old_ratio", "ratio", relative)).alias("t_start"))


def half_maximum_times(rows: DataFrame, transitions: DataFrame, keys: list[str]) -> DataFrame:
    """First bin of each transition whose value exceeds half the transition's maximum."""
    inside = transitions.join(rows, keys).where((F.col("bin") >= F.col("bin_beg")) & (F.col("bin") < F.col("bin_end")))
    top = F.max("val").over(Window.partitionBy(*keys, "trans_idx"))
    return inside.withColumn("top", top).where("val > top / 2").groupBy(*keys, "trans_idx").agg(F.min("bin").alias("bin_half"), F.first("top").alias("top"))


def transition_counts(transitions: DataFrame, comps: DataFrame) -> DataFrame:
    """Compositions, transitions, compositions with one, and the most in one."""
    per = transitions.groupBy("comp_id").agg(F.count("*").alias("n"))
    return comps.join(per, "comp_id", "left").agg(
        F.count("*").alias("n_comps"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_transitions"), F.count("n").alias("n_with_transition"), F.coalesce(F.max("n"), F.lit(0)).alias("most")
    )


def sensitivity(rows: DataFrame, grid: DataFrame, window: int) -> DataFrame:
    """Share of compositions with a transition for each pair of cuts in `grid` (param, abs_cut, rel_cut), a table of some rows."""
    keys = ["param", "comp_id"]
    crossed = rows.join(F.broadcast(grid))
    n_comps = rows.select("comp_id").distinct().count()
    above = (F.col("val") > F.col("abs_cut")) & (F.col("ratio") > F.col("rel_cut")) & (F.col("bin") >= window)
    starts = runs(crossed, above, keys)
    found = starts.select(*keys).distinct().groupBy("param").agg(F.count("*").alias("n"))
    return grid.join(found, "param", "left").select("param", "abs_cut", "rel_cut", (F.coalesce("n", F.lit(0)) / n_comps).alias("share"))


def stable_means(signals: DataFrame, periods: DataFrame) -> DataFrame:
    """Mean of each signal over the first half of each stable period (comp_id, trans_idx, beg, fin). signals: comp_id, signal, bin, val."""
    half = periods.withColumn("mid", F.col("beg") + F.floor((F.col("fin") - F.col("beg")) / 2))
    joined = half.join(signals, "comp_id").where((F.col("bin") >= F.col("beg")) & (F.col("bin") < F.col("mid")))
    return joined.groupBy("comp_id", "trans_idx", "signal").agg(F.avg("val").alias("stable_mean"))


def signal_classes(signals: DataFrame, periods: DataFrame, means: DataFrame, high: float, low: float) -> DataFrame:
    """Whether a signal rises above `high` times its stable mean, falls below `low` times it, or both, in the period's second half."""
    half = periods.withColumn("mid", F.col("beg") + F.floor((F.col("fin") - F.col("beg")) / 2))
    joined = half.join(signals, "comp_id").where((F.col("bin") >= F.col("mid")) & (F.col("bin") < F.col("fin"))).join(means, ["comp_id", "trans_idx", "signal"])
    up, down = F.bool_or(F.col("val") >= high * F.col("stable_mean")), F.bool_or(F.col("val") <= low * F.col("stable_mean"))
    kind = F.when(up & down, "both").when(up, "high").when(down, "low").otherwise("none")
    return joined.groupBy("comp_id", "trans_idx", "signal").agg(kind.alias("kind"))


def stable_periods(transitions: DataFrame, window: int) -> DataFrame:
    """From the end of the transition before (or the first full window) to the next one's beginning."""
    order = Window.partitionBy("comp_id").orderBy("trans_idx")
    beg = F.coalesce(F.lag("bin_end").over(order), F.lit(window + 1))
    return transitions.select("comp_id", "trans_idx", beg.alias("beg"), F.col("bin_beg").alias("fin")).where("fin > beg")


def aligned(rows: DataFrame, transitions: DataFrame, before: int, after: int) -> DataFrame:
    """Values by bins relative to the beginning of each transition."""
    at = transitions.select("comp_id", "trans_idx", F.col("bin_beg"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("rel"))
    return at.withColumn("bin", F.col("bin_beg") + F.col("rel")).join(rows, ["comp_id", "bin"]).select("comp_id", "trans_idx", "rel", "val")


def mean_aligned(lined: DataFrame) -> DataFrame:
    """Each transition's values over its own maximum, averaged over transitions."""
    top = F.max("val").over(Window.partitionBy("comp_id", "trans_idx"))
    return lined.withColumn("top", top).where("top > 0").groupBy("rel").agg(F.avg(F.col("val") / F.col("top")).alias("mean"), F.count("*").alias("n"))


def _fire(times: list[float], cooldown: float) -> list[bool]:
    """Which of the sorted times fire if each firing silences those within `cooldown` after it."""
    fired, last = [], float("-inf")
    for t in times:
        fires = t - last >= cooldown
        fired.append(fires)
        last = t if fires else last
    return fired


def warnings(rows: DataFrame, threshold: float, cooldown: int, keys: list[str]) -> DataFrame:
    """`(keys, bin)` of warnings: `ratio` above the threshold, none within `cooldown` bins after another.

    What fires depends on the one before, so each series is walked in order; a series has some thousand bins at most, and only bins above the threshold are
    passed on.
    """
    above = rows.where(F.col("ratio") > threshold).select(*keys, "bin")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        return group[_fire(group["bin"].tolist(), cooldown)]

    return above.groupBy(*keys).applyInPandas(walk, above.schema)


def warning_score(fired: DataFrame, transitions: DataFrame, horizon: int, earliness: int) -> DataFrame:
    """Warnings, and those within (beginning - horizon, beginning - earliness] of a transition, for each composition."""
    good = (F.col("bin") > F.col("bin_beg") - horizon) & (F.col("bin") <= F.col("bin_beg") - earliness)
    hits = fired.join(transitions.select("comp_id", "bin_beg"), "comp_id").where(good).select("comp_id", "bin").distinct().withColumn("good", F.lit(1))
    return fired.join(hits, ["comp_id", "bin"], "left").groupBy("comp_id").agg(F.count("*").alias("n_warnings"), F.sum(F.coalesce("good", F.lit(0))).alias("n_good"))


def significance_grid(rows: DataFrame, transitions: DataFrame, thresholds: list[float], earliness: list[int], cooldown: int) -> DataFrame:
    """Mean share of good warnings over compositions for each threshold and earliness."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    crossed = rows.join(F.broadcast(grid)).where("ratio > threshold").select("comp_id", "threshold", "bin")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        return group[_fire(group["bin"].tolist(), cooldown)]

    fired = crossed.groupBy("comp_id", "threshold").applyInPandas(walk, crossed.schema)
    asked = fired.withColumn("earliness", F.explode(F.array(*map(F.lit, earliness))))
    good = (F.col("bin") > F.col("bin_beg") - cooldown) & (F.col("bin") <= F.col("bin_beg") - F.col("earliness"))
    hits = asked.join(transitions.select("comp_id", "bin_beg"), "comp_id").where(good).select("comp_id", "threshold", "earliness", "bin").distinct().withColumn("good", F.lit(1))
    scored = asked.join(hits, ["comp_id", "threshold", "earliness", "bin"], "left").groupBy("comp_id", "threshold", "earliness").agg(F.avg(F.coalesce("good", F.lit(0))).alias("share"))
    return scored.groupBy("threshold", "earliness").agg(F.avg("share").alias("mean_share"), F.count("*").alias("n_comps"))


def merge_same_periods(transitions: DataFrame, same_after: bool = False) -> DataFrame:
    """Transitions with the same stable period before (and after) as one, from the least beginning to the greatest end.

    transitions: comp_id, pre_beg, pre_end, bin_beg, bin_end, post_beg, post_end. Unless the period after must be the same, its ends are the greatest ones.
    """
    after = ["post_beg", "post_end"]
    keys = ["comp_id", "pre_beg", "pre_end", *(after if same_after else [])]
    rest = [] if same_after else [F.max(c).alias(c) for c in after]
    return transitions.groupBy(*keys).agg(F.min("bin_beg").alias("bin_beg"), F.max("bin_end").alias("bin_end"), *rest)


def with_periods(transitions: DataFrame, window: int, last: DataFrame) -> DataFrame:
    """Add `pre_beg`, `pre_end`, `post_beg`, `post_end`: the `window` bins before each transition and after it, cut at 1 and at the composition's `n_bins`."""
    return transitions.join(last, "comp_id").select(
        "comp_id", "bin_beg", "bin_end", F.greatest(F.col("bin_beg") - window, F.lit(1)).alias("pre_beg"), F.col("bin_beg").alias("pre_end"),
        F.col("bin_end").alias("post_beg"), F.least(F.col("bin_end") + window, "n_bins").alias("post_end"),
    )


def half_maximum_starts(series: DataFrame, transitions: DataFrame) -> DataFrame:
    """Mean, median and standard deviation over several variables of the time, in bins, at which each first exceeds half its maximum in the transition.

    Looked at are the bins from one before the transition to the first after it. The time is interpolated from the bin before where that was at or below the half. series: comp_id, variable, bin, val; transitions: comp_id, trans_idx, bin_beg, bin_end.
    """
    order = Window.partitionBy("comp_id", "variable").orderBy("bin")
    inside = series.withColumn("old", F.lag("val").over(order)).join(transitions, "comp_id").where((F.col("bin") >= F.col("bin_beg") - 1) & (F.col("bin") <= F.col("bin_end")))
    key = ["comp_id", "trans_idx", "variable"]
    half = inside.withColumn("half", F.max("val").over(Window.partitionBy(*key)) / 2).where("val > half")
    first = half.groupBy(*key).agg(F.min_by(F.struct("bin", "val", "old", "half"), "bin").alias("f"))
    rising = F.col("f.old") <= F.col("f.half")
    at = F.when(rising, F.col("f.bin") - 1 + (F.col("f.half") - F.col("f.old")) / (F.col("f.val") - F.col("f.old"))).otherwise(F.col("f.bin") - 1.0)
    return first.withColumn("at", at).groupBy("comp_id", "trans_idx").agg(
        F.avg("at").alias("mean"), F.expr("percentile(at, 0.5)").alias("median"), F.stddev_pop("at").alias("deviation"), F.count("*").alias("n_variables")
    )


def transition_images(transitions: DataFrame, references: DataFrame, instant: DataFrame) -> DataFrame:
    """For each transition, over the pixels of its composition: shares that differ between the references before it and after it, and between the image
    in its middle and either. references: comp_id, x, y, bin, ref; instant: comp_id, x, y, bin, inst."""
    at = transitions.withColumn("middle", F.floor((F.col("bin_beg") + F.col("bin_end")) / 2).cast("int"))
    of = lambda table, value, place, name: table.select("comp_id", "x", "y", F.col("bin").alias(place), F.col(value).alias(name))
    pixel = at.join(of(references, "ref", "bin_beg", "before"), ["comp_id", "bin_beg"])
    pixel = pixel.join(of(references, "ref", "bin_end", "after"), ["comp_id", "x", "y", "bin_end"]).join(of(instant, "inst", "middle", "amid"), ["comp_id", "x", "y", "middle"])
    share = lambda a, b: F.avg((F.col(a) != F.col(b)).cast("double"))
    return pixel.groupBy("comp_id", "trans_idx").agg(
        share("before", "after").alias("before_after"), share("before", "amid").alias("before_amid"), share("amid", "after").alias("amid_after"), F.count("*").alias("n_pixels")
    )
