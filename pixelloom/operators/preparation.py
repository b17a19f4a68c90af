"""Cleaning of an edit log: order, duplicates, hidden moderators, canvas bounds, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.operators.changes import TIME


def sorted_log(log: DataFrame) -> DataFrame:
    """The log in order of time, ties by event_id: a range partitioning, no single task."""
    return log.orderBy(*TIME)


def deduplicated(log: DataFrame, keep: str = "first") -> DataFrame:
    """Without repeats of a user's change of the same pixel to the same colour in the same millisecond; moderators' changes all stay.

    keep `first` leaves the smallest event_id of each set, `none` leaves none of a set of several.
    """
    key = [F.round(F.col("seconds") * 1000).cast("long"), F.col("x"), F.col("y"), F.col("user"), F.col("color")]
    here = Window.partitionBy(*key)
    users = log.where(~F.col("moderator"))
    if keep == "first":
        kept = users.withColumn("i", F.row_number().over(here.orderBy("event_id"))).where("i = 1").drop("i")
    else:
        kept = users.withColumn("n", F.count("*").over(here)).where("n = 1").drop("n")
    return kept.unionByName(log.where("moderator"))


def with_hidden_moderators(log: DataFrame) -> DataFrame:
    """Add `hidden_moderator`: any change of a user who has at least one moderator's change."""
    moderators = log.where("moderator").select("user").distinct().withColumn("hidden_moderator", F.lit(True))
    return log.join(moderators, "user", "left").na.fill(False, ["hidden_moderator"])


def on_open_canvas(log: DataFrame, sections: DataFrame) -> DataFrame:
    """Changes of pixels that some section holds which is open by then. Sections are a handful of rows."""
    inside = (
        (F.col("seconds") >= F.col("t_open")) & F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    )
    return log.join(F.broadcast(sections), inside, "left_semi")


def log_checks(log: DataFrame) -> DataFrame:
    """Distinct moderator events, and pairs of repeated changes that are left."""
    key = [F.round(F.col("seconds") * 1000).cast("long").alias("ms"), "x", "y", "user", "color"]
    repeats = log.where(~F.col("moderator")).groupBy(*key).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_repeats"))
    events = log.agg(F.countDistinct(F.when(F.col("moderator"), F.col("event_id"))).alias("n_moderator_events"), F.count("*").alias("n_changes"))
    return events.join(F.broadcast(repeats))  # one row each


def user_changes(log: DataFrame, user: int) -> DataFrame:
    return log.where(F.col("user") == user).orderBy(*TIME)
