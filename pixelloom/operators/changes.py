"""Changes inside compositions, their flags, and counts of them in time bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.functions.columns import bin_number, safe_ratio

TIME = ["seconds", "event_id"]


def rectangle_pixels(borders: DataFrame) -> DataFrame:
    """Every pixel of each rectangle, with the rectangle's time range."""
    across = borders.withColumn("x", F.explode(F.sequence("x0", "x1")))
    return across.select("comp_id", "x", F.explode(F.sequence("y0", "y1")).alias("y"), "t0", "t1")


def changes_in_comps(log: DataFrame, pixels: DataFrame) -> DataFrame:
    """One row for each change and composition that holds its pixel, `active` if strictly inside any of the pixel's time ranges.

    All compositions meet the log in one equi-join on the pixel. A pixel's ranges are gathered first, so the join gives each change once for each
    composition.
    """
    ranges = pixels.groupBy("comp_id", "x", "y").agg(F.collect_list(F.struct("t0", "t1")).alias("ranges"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    joined = log.join(ranges, ["x", "y"])
    inside = F.exists("ranges", lambda r: (F.col("seconds") > r["t0"]) & (F.col("seconds") < r["t1"]))
    return joined.withColumn("active", inside).drop("ranges")


def with_redundancy(changes: DataFrame, pixel: list[str]) -> DataFrame:
    """Add `redundant_col` and `redundant_colanduser`: the colour (and user) of the pixel's previous change. Equal times go by event_id.

    A composition holds all changes of its pixels, so a log by x and y gives the same flags before it meets the compositions as each of them would after.
    """
    order = Window.partitionBy(*pixel).orderBy(*TIME)
    same = F.coalesce(F.col("color") == F.lag("color").over(order), F.lit(False))
    both = same & F.coalesce(F.col("user") == F.lag("user").over(order), F.lit(False))
    return changes.withColumns({"redundant_col": same, "redundant_colanduser": both})


def with_neighbours(log: DataFrame) -> DataFrame:
    """Add `since` and `next`: the times of the pixel's changes before and after each."""
    order = Window.partitionBy("x", "y").orderBy(*TIME)
    return log.withColumns({"since": F.lag("seconds").over(order), "next": F.lead("seconds").over(order)})


def with_cheats(changes: DataFrame, cooldown: float) -> DataFrame:
    """Add `cooldown_cheat`: the user's previous change in the composition that is no moderator's is less than `cooldown` seconds back; moderators' changes always count."""
    earlier = Window.partitionBy("comp_id", "user").orderBy(*TIME).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(~F.col("moderator"), F.col("seconds"))).over(earlier)
    cheat = F.col("moderator") | F.coalesce(F.col("seconds") - last < cooldown, F.lit(False))
    return changes.withColumn("cooldown_cheat", cheat)


def with_flags(changes: DataFrame, cooldown: float) -> DataFrame:
    """Add `redundant_col`, `redundant_colanduser` and `cooldown_cheat` to changes in compositions."""
    return with_cheats(with_redundancy(changes, ["comp_id", "x", "y"]), cooldown)


def in_bins(changes: DataFrame, width: float) -> DataFrame:
    """Changes with their `bin` of the composition's life; those at or before its start or after its end drop out."""
    inside = changes.where((F.col("seconds") > F.col("t0")) & (F.col("seconds") <= F.col("t1")))
    return inside.withColumn("bin", bin_number(F.col("seconds"), F.col("t0"), width))


def count_if(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def change_counts(changes: DataFrame, width: float) -> DataFrame:
    """Active changes of each composition and bin, by kind, and their users."""
    return (
        in_bins(changes, width)
        .where("active")
        .groupBy("comp_id", "bin")
        .agg(
            F.count("*").alias("n_changes"),
            count_if(F.col("moderator")).alias("n_moderator"),
            count_if(F.col("cooldown_cheat")).alias("n_cheat"),
            count_if(F.col("redundant_col")).alias("n_redundant_col"),
            count_if(F.col("redundant_colanduser")).alias("n_redundant_colanduser"),
            F.countDistinct("user").alias("n_users"),
        )
    )


def normalised_counts(counts: DataFrame, area: DataFrame, width: float) -> DataFrame:
    """Counts over area and time, and kinds over all changes: 0 where there are no changes. counts: as of `change_counts`; area: comp_id, area."""
    joined = counts.join(area, "comp_id")
    shares = {f"share_{k}": safe_ratio(F.col(f"n_{k}"), F.col("n_changes"), 0.0, 0.0) for k in ("moderator", "cheat", "redundant_col", "redundant_colanduser")}
    rates = {"changes_rate": F.col("n_changes") / (F.col("area") * width), "changes_per_user": safe_ratio(F.col("n_changes"), F.col("n_users"), 0.0, 0.0)}
    return joined.select("comp_id", "bin", *(c.alias(n) for n, c in (shares | rates).items()))
