"""Whole-canvas figures: totals, colours, heat maps, users, time differences, radii."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.operators.changes import TIME, count_if


def totals(log: DataFrame) -> DataFrame:
    mod = F.col("moderator")
    return log.agg(
        F.count("*").alias("n_changes"),
        F.countDistinct("user").alias("n_users"),
        F.max("seconds").alias("last_time"),
        count_if(mod).alias("n_moderator_changes"),
        F.countDistinct(F.when(mod, F.col("user"))).alias("n_moderator_users"),
    )


def color_use(log: DataFrame) -> DataFrame:
    return log.groupBy("color").agg(F.min("seconds").alias("first_use"), F.max("seconds").alias("last_use"), F.count("*").alias("n_changes"))


def enlargement_times(log: DataFrame, sections: DataFrame) -> DataFrame:
    """First change inside each section but outside the one before it."""
    before = sections.select((F.col("section") + 1).alias("section"), *(F.col(c).alias(f"old_{c}") for c in ("xmin", "xmax", "ymin", "ymax")))
    steps = sections.join(before, "section")
    inside = lambda p: F.col("x").between(F.col(p + "xmin"), F.col(p + "xmax")) & F.col("y").between(F.col(p + "ymin"), F.col(p + "ymax"))
    pixels = log.groupBy("x", "y").agg(F.min("seconds").alias("seconds"))  # at most one row for each pixel meets the sections
    return pixels.join(F.broadcast(steps), inside("") & ~inside("old_")).groupBy("section").agg(F.min("seconds").alias("first_change"))


def bucket(width: float) -> Column:
    return F.floor(F.col("seconds") / width).cast("int")


def changes_per_bin(log: DataFrame, width: float) -> DataFrame:
    mod = F.col("moderator")
    return log.groupBy(bucket(width).alias("bin")).agg(F.count("*").alias("n_all"), count_if(~mod).alias("n_users_only"), count_if(mod).alias("n_moderator"))


def active_users(log: DataFrame, width: float) -> DataFrame:
    return log.groupBy(bucket(width).alias("bin")).agg(F.countDistinct("user").alias("n_users"))


def heat_map(log: DataFrame, width: float | None = None) -> DataFrame:
    """Changes of each pixel: all, moderators', and distinct users; by time bucket if `width` is given."""
    keys = [*([bucket(width).alias("bin")] if width else []), "x", "y"]
    return log.groupBy(*keys).agg(F.count("*").alias("n_changes"), count_if(F.col("moderator")).alias("n_moderator"), F.countDistinct("user").alias("n_users"))


def in_edges(value: Column, edges: list[float]) -> Column:
    """Number of the bin [edges[i], edges[i + 1]) that holds `value`; null outside."""
    found = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        found = F.when((value >= edges[i]) & (value < edges[i + 1]), F.lit(i)).otherwise(found)
    return found


def pixel_change_distribution(log: DataFrame, width: int, height: int, edges: list[float]) -> DataFrame:
    """Pixels by number of changes in bins of any width, divided by the width; pixels without a change count."""
    spark = log.sparkSession
    grid = spark.range(width).select(F.col("id").cast("int").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    n = grid.join(log.groupBy("x", "y").count(), ["x", "y"], "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    counts = n.groupBy(in_edges(F.col("n"), edges).alias("bin")).agg(F.count("*").alias("n_pixels")).where("bin is not null")
    span = F.element_at(F.array(*(F.lit(float(b - a)) for a, b in zip(edges, edges[1:], strict=False))), F.col("bin") + 1)
    return counts.withColumn("density", F.col("n_pixels") / span)


def changes_per_user(log: DataFrame) -> DataFrame:
    return log.where(~F.col("moderator")).groupBy("user").agg(F.count("*").alias("n_changes"))


def user_change_distribution(log: DataFrame) -> DataFrame:
    return changes_per_user(log).groupBy("n_changes").agg(F.count("*").alias("n_users"))


def user_change_summary(log: DataFrame) -> DataFrame:
    return changes_per_user(log).agg(F.avg("n_changes").alias("mean"), F.expr("percentile(n_changes, 0.5)").alias("median"), F.max("n_changes").alias("most"))


def top_users(log: DataFrame, n: int) -> DataFrame:
    return changes_per_user(log).orderBy(F.desc("n_changes"), "user").limit(n)


def user_gaps(log: DataFrame) -> DataFrame:
    """Seconds between consecutive changes of a user, moderators left out."""
    order = Window.partitionBy("user").orderBy(*TIME)
    gaps = log.where(~F.col("moderator")).withColumn("gap", F.col("seconds") - F.lag("seconds").over(order))
    return gaps.where("gap is not null")


def gap_histogram(log: DataFrame, width: float) -> DataFrame:
    return user_gaps(log).groupBy(F.floor(F.col("gap") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def gap_counts(log: DataFrame, limits: list[float]) -> DataFrame:
    """How many gaps are below each limit."""
    gaps = user_gaps(log)
    return gaps.agg(F.count("*").alias("n_gaps"), *(count_if(F.col("gap") < limit).alias(f"below_{i}") for i, limit in enumerate(limits)))


def gap_statistics(log: DataFrame) -> DataFrame:
    """Mean, least, median and deviation of each user's gaps."""
    return user_gaps(log).groupBy("user").agg(
        F.avg("gap").alias("mean"), F.min("gap").alias("least"), F.expr("percentile(gap, 0.5)").alias("median"), F.stddev_pop("gap").alias("deviation")
    )


def cheaters(log: DataFrame, limit: float) -> DataFrame:
    """Users with gaps below `limit`, and how many."""
    return user_gaps(log).groupBy("user").agg(count_if(F.col("gap") < limit).alias("n_cheats")).where("n_cheats > 0")


def gap_over_time(log: DataFrame, time_width: float, gap_width: float) -> DataFrame:
    """Gaps by time and length, and their share of the time's column."""
    counts = user_gaps(log).groupBy(bucket(time_width).alias("bin"), F.floor(F.col("gap") / gap_width).cast("int").alias("gap_bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bin")))


def user_radius(log: DataFrame) -> DataFrame:
    """Mean distance of a user's changes to their centre, for two changes or more."""
    centres = log.groupBy("user").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n_changes")).where("n_changes > 1")
    distance = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    return log.join(centres, "user").groupBy("user").agg(F.avg(distance).alias("radius"), F.first("n_changes").alias("n_changes"))


def user_pair_radius(log: DataFrame) -> DataFrame:
    """Sum of a user's pair distances over n (n - 1), n >= 2.

    Pairs are of distinct pixels weighted by their counts, so a user's cost is bounded by the pixels they touched, not by their changes.
    """
    spots = log.groupBy("user", "x", "y").agg(F.count("*").alias("w"))
    n = log.groupBy("user").agg(F.count("*").alias("n_changes")).where("n_changes > 1")
    other = spots.select("user", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("w").alias("w2"))
    later = (F.col("x") < F.col("x2")) | ((F.col("x") == F.col("x2")) & (F.col("y") < F.col("y2")))
    distance = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    sums = spots.join(other, "user").where(later).groupBy("user").agg(F.sum(distance * F.col("w") * F.col("w2")).alias("s"))
    return n.join(sums, "user", "left").select("user", "n_changes", (F.coalesce("s", F.lit(0.0)) / (F.col("n_changes") * (F.col("n_changes") - 1))).alias("radius"))


def radius_by_changes(log: DataFrame, radius_width: float) -> DataFrame:
    """Users by radius and by order of magnitude of their changes."""
    found = user_radius(log)
    return found.groupBy(F.floor(F.col("radius") / radius_width).cast("int").alias("radius_bin"), F.floor(F.log2("n_changes")).cast("int").alias("changes_bin")).agg(F.count("*").alias("n_users"))


def pixel_change_figures(log: DataFrame, width: int, height: int) -> DataFrame:
    """Mean and median number of changes of a pixel, those without one included."""
    grid = log.sparkSession.range(width).select(F.col("id").cast("int").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    n = grid.join(log.groupBy("x", "y").count(), ["x", "y"], "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    counts = n.groupBy("n").agg(F.count("*").alias("k"))
    return counts.agg((F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("mean"), F.expr("percentile(n, 0.5, k)").alias("median"))


def colors_in_order(log: DataFrame, order: list[int]) -> DataFrame:
    """Changes of each colour, with its place in the display order; colours without a change count 0, and others than those of the order come last, by number."""
    places = log.sparkSession.createDataFrame(list(enumerate(order)), "place int, color int")
    counts = log.groupBy("color").agg(F.count("*").alias("n_changes"))
    joined = places.join(counts, "color", "full")
    return joined.select("color", F.coalesce("place", F.lit(len(order)) + F.col("color")).alias("place"), F.coalesce("n_changes", F.lit(0)).alias("n_changes"))


def figure_histogram(rows: DataFrame, names: list[str], per_decade: float) -> DataFrame:
    """Rows by figure and log bin of its value, for figures above 0."""
    long = rows.unpivot([], names, "figure", "value").where("value > 0")
    return long.groupBy("figure", F.floor(F.log10("value") * per_decade).cast("int").alias("bin")).agg(F.count("*").alias("n"))
