"""Changes for and against a reference image, and the users behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.operators.changes import count_if, in_bins
from pixelloom.operators.state import PIXEL

BIN = ["comp_id", "bin"]


def agreement(changes: DataFrame, ref: DataFrame, width: float) -> DataFrame:
    """Active changes with `defense`: whether they set the reference colour of their pixel and bin."""
    binned = in_bins(changes, width).where("active")
    return binned.join(ref, [*PIXEL, "bin"]).withColumn("defense", F.col("color") == F.col("ref"))


def attack_defense(agreed: DataFrame) -> DataFrame:
    """Defence changes, and users that only attack, only defend, do both, per composition and bin."""
    users = agreed.groupBy(*BIN, "user").agg(count_if(F.col("defense")).alias("d"), count_if(~F.col("defense")).alias("a"))
    return users.groupBy(*BIN).agg(
        F.sum("d").alias("n_defense"),
        F.sum("a").alias("n_attack"),
        count_if(F.col("d") == 0).alias("n_attackonly_users"),
        count_if(F.col("a") == 0).alias("n_defenseonly_users"),
        count_if((F.col("a") > 0) & (F.col("d") > 0)).alias("n_bothattdef_users"),
        F.count("*").alias("n_users"),
    )


def counts_and_fights(changes: DataFrame, ref: DataFrame, width: float) -> DataFrame:
    """`changes.change_counts` with the figures of `attack_defense` but its `n_users`: changes are grouped by user once for both. Those at a pixel and bin without reference are neither attack nor defence."""
    binned = in_bins(changes, width).where("active").join(ref, [*PIXEL, "bin"], "left").withColumn("defense", F.col("color") == F.col("ref"))
    kinds = {"n_moderator": "moderator", "n_cheat": "cooldown_cheat", "n_redundant_col": "redundant_col", "n_redundant_colanduser": "redundant_colanduser"}
    users = binned.groupBy(*BIN, "user").agg(
        F.count("*").alias("n_changes"), *(count_if(F.col(c)).alias(n) for n, c in kinds.items()), count_if(F.col("defense")).alias("d"), count_if(~F.col("defense")).alias("a")
    )
    return users.groupBy(*BIN).agg(
        *(F.sum(n).alias(n) for n in ("n_changes", *kinds)),
        F.count("user").alias("n_users"),
        F.sum("d").alias("n_defense"),
        F.sum("a").alias("n_attack"),
        count_if((F.col("d") == 0) & (F.col("a") > 0)).alias("n_attackonly_users"),
        count_if((F.col("a") == 0) & (F.col("d") > 0)).alias("n_defenseonly_users"),
        count_if((F.col("a") > 0) & (F.col("d") > 0)).alias("n_bothattdef_users"),
    )


def user_bins(changes: DataFrame, width: float) -> DataFrame:
    return in_bins(changes, width).where("active").select(*BIN, "user").distinct()


def new_users(changes: DataFrame, width: float, window: int) -> DataFrame:
    """Users absent from the bin before, and from the `window` bins before."""
    last = F.lag("bin").over(Window.partitionBy("comp_id", "user").orderBy("bin"))
    gap = user_bins(changes, width).withColumn("gap", F.col("bin") - F.coalesce(last, F.lit(-(1 << 30))))
    return gap.groupBy(*BIN).agg(count_if(F.col("gap") > 1).alias("n_new_vs_bin"), count_if(F.col("gap") > window).alias("n_new_vs_window"))


def window_users(changes: DataFrame, width: float, window: int) -> DataFrame:
    """Distinct users over the last `window` bins, this one included, for each bin in which the number changes.

    A user counts from each bin they come back to until `window` bins after the last they were seen in: +1 and -1 events and a running sum, no sets.
    """
    order = Window.partitionBy("comp_id", "user").orderBy("bin")
    seen = user_bins(changes, width).withColumns({"old": F.lag("bin").over(order), "next": F.lead("bin").over(order)})
    comes = seen.where(F.col("old").isNull() | (F.col("bin") - F.col("old") >= window)).select(*BIN, F.lit(1).alias("d"))
    goes = seen.where(F.col("next").isNull() | (F.col("next") - F.col("bin") >= window)).select("comp_id", (F.col("bin") + window).alias("bin"), F.lit(-1).alias("d"))
    steps = comes.unionByName(goes).groupBy(*BIN).agg(F.sum("d").alias("d"))
    return steps.select(*BIN, F.sum("d").over(Window.partitionBy("comp_id").orderBy("bin")).alias("n_users_window"))


def _inner_outer(changes: DataFrame, ref: DataFrame, forward: DataFrame, width: float) -> DataFrame:
    """Active changes with `inner`: whether they agree with the backward or the forward reference."""
    binned = in_bins(changes, width).where("active").join(ref, [*PIXEL, "bin"]).join(forward, [*PIXEL, "bin"], "left")
    return binned.withColumn("inner", (F.col("color") == F.col("ref")) | F.coalesce(F.col("color") == F.col("ref_fwd"), F.lit(False)))


def in_out_groups(changes: DataFrame, ref: DataFrame, forward: DataFrame, width: float) -> DataFrame:
    """Changes that agree with the backward or the forward reference (in), others (out), and their users."""
    binned = _inner_outer(changes, ref, forward, width)
    users = binned.groupBy(*BIN, "user").agg(count_if(F.col("inner")).alias("i"), count_if(~F.col("inner")).alias("o"))
    return users.groupBy(*BIN).agg(
        F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), count_if(F.col("o") == 0).alias("n_in_users"), count_if(F.col("i") == 0).alias("n_out_users"),
        count_if((F.col("i") > 0) & (F.col("o") > 0)).alias("n_both_users"),
    )


def pixel_attack_share(agreed: DataFrame) -> DataFrame:
    """Attacks over all changes of each pixel and bin."""
    return agreed.groupBy(*PIXEL, "bin").agg(F.avg((~F.col("defense")).cast("double")).alias("attack_share"))


def lifetime_users(agreed: DataFrame) -> DataFrame:
    """Users of a composition's whole life by what they did."""
    users = agreed.groupBy("comp_id", "user").agg(count_if(F.col("defense")).alias("d"), count_if(~F.col("defense")).alias("a"))
    return users.groupBy("comp_id").agg(
        F.count("*").alias("n_users"), count_if(F.col("d") == 0).alias("n_attackonly"), count_if(F.col("a") == 0).alias("n_defenseonly"),
        count_if((F.col("a") > 0) & (F.col("d") > 0)).alias("n_both"),
    )


def changes_per_user_in_window(counts: DataFrame, users: DataFrame, n_bins: DataFrame, window: int) -> DataFrame:
    """Changes over the last `window` bins divided by the distinct users in them. counts: comp_id, bin, n_changes."""
    every = n_bins.withColumn("bin", F.explode(F.sequence(F.lit(1), "n_bins"))).select(*BIN)
    filled = every.join(counts.select(*BIN, "n_changes"), BIN, "left").na.fill(0, ["n_changes"])
    order = Window.partitionBy("comp_id").orderBy("bin")
    summed = filled.withColumn("n", F.sum("n_changes").over(order.rowsBetween(-(window - 1), 0)))
    held = summed.join(users, BIN, "left").withColumn("u", F.last("n_users_window", ignorenulls=True).over(order))
    return held.where("u > 0").select(*BIN, (F.col("n") / F.col("u")).alias("changes_per_user"))


def lifetime_groups(changes: DataFrame, ref: DataFrame, forward: DataFrame, width: float) -> DataFrame:
    """Users of a composition's whole life by whether their changes agree with a backward or forward reference (in) or not (out), and how many there are in all."""
    users = _inner_outer(changes, ref, forward, width).groupBy("comp_id", "user").agg(count_if(F.col("inner")).alias("i"), count_if(~F.col("inner")).alias("o"))
    return users.groupBy("comp_id").agg(
        F.count("*").alias("n_users"), count_if(F.col("o") == 0).alias("n_in_only"), count_if(F.col("i") == 0).alias("n_out_only"), count_if((F.col("i") > 0) & (F.col("o") > 0)).alias("n_both"),
    )


def outgroup_changes(changes: DataFrame, ref: DataFrame, forward: DataFrame, width: float) -> DataFrame:
    """`(comp_id, event_id, bin)` of the changes that agree with neither reference."""
    return _inner_outer(changes, ref, forward, width).where("not inner").select("comp_id", "event_id", "bin")
