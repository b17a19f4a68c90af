"""Null models: the log with positions and colours drawn anew, by hashes, so that results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.config import Canvas
from pixelloom.functions.columns import hash_unit, palette_size


def uniform(log: DataFrame, canvas: Canvas, seed: int = 0) -> DataFrame:
    """Positions uniform on the sections open at the time, colours uniform in the palette in force."""
    box = {name: F.lit(getattr(canvas.sections[0], name)) for name in ("xmin", "xmax", "ymin", "ymax")}
    for s in canvas.sections[1:]:
        box = {name: F.when(F.col("seconds") >= s.t_open, F.lit(getattr(s, name))).otherwise(c) for name, c in box.items()}
    draw = lambda k: hash_unit(F.col("event_id"), seed=seed * 10 + k)
    return log.withColumns(
        {
            "x": (box["xmin"] + F.floor(draw(1) * (box["xmax"] - box["xmin"] + 1))).cast("int"),
            "y": (box["ymin"] + F.floor(draw(2) * (box["ymax"] - box["ymin"] + 1))).cast("int"),
            "color": F.floor(draw(3) * palette_size(F.col("seconds"), canvas.palette_steps)).cast("int"),
        }
    )


def pixel_weights(pixels: DataFrame, exponent: float) -> DataFrame:
    """`(x, y, weight)`: area to the `exponent` of the smallest composition that holds a pixel."""
    area = pixels.groupBy("comp_id").agg(F.countDistinct("x", "y").alias("area"))
    return pixels.join(area.hint("merge"), "comp_id").groupBy("x", "y").agg(F.pow(F.min("area").cast("double"), F.lit(exponent)).alias("weight"))


def perimeter_weights(pixels: DataFrame) -> DataFrame:
    """`(x, y, weight)`: number of perimeter pixels, those with fewer than four neighbours, of the smallest such composition."""
    own = pixels.select("comp_id", "x", "y").distinct()
    moves = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    near = own.withColumn("m", moves).select("comp_id", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"))
    inner = own.join(near.groupBy("comp_id", "x", "y").agg(F.count("*").alias("n")).hint("merge"), ["comp_id", "x", "y"], "left")  # a lone pixel has no neighbour
    edge = inner.where("n is null or n < 4").groupBy("comp_id").agg(F.count("*").alias("perimeter"))
    return own.join(edge.hint("merge"), "comp_id").groupBy("x", "y").agg(F.min("perimeter").cast("double").alias("weight"))


def cumulative(weights: DataFrame) -> DataFrame:
    """`(x, y, lo, hi)`: the pixel's part of the unit interval. The canvas's pixels are ordered by column; columns get offsets, so no task holds them all."""
    columns = weights.groupBy("x").agg(F.sum("weight").alias("w"))
    order = Window.orderBy("x")
    total = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = columns.select("x", (F.sum("w").over(order) - F.col("w")).alias("base"), total.alias("total"))  # one row for each column
    inside = F.sum("weight").over(Window.partitionBy("x").orderBy("y"))
    placed = weights.withColumn("inside", inside).join(F.broadcast(offsets), "x")
    end = lambda w: F.when((F.col("base") + w) / F.col("total") > 1 - 1e-9, 1.0).otherwise((F.col("base") + w) / F.col("total"))  # noqa: E731  rounding leaves no gap at 1
    return placed.select("x", "y", end(F.col("inside") - F.col("weight")).alias("lo"), end(F.col("inside")).alias("hi"))


def weighted(log: DataFrame, weights: DataFrame, seed: int = 0, slots: int = 1000) -> DataFrame:
    """Positions drawn by weight: a range join of a hash with the cumulative weights, made an equi-join by slots of the unit interval."""
    parts = cumulative(weights)
    spread = parts.withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") * slots), F.floor(F.col("hi") * slots))))
    drawn = log.drop("x", "y").withColumn("u", hash_unit(F.col("event_id"), seed=seed)).withColumn("slot", F.floor(F.col("u") * slots))
    return drawn.join(spread, "slot").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).drop("u", "slot", "lo", "hi")


def combined_weights(a: DataFrame, b: DataFrame, how: str = "max") -> DataFrame:
    """Two layers of weights as one: max, sum or mean."""
    both = a.withColumnRenamed("weight", "wa").join(b.withColumnRenamed("weight", "wb"), ["x", "y"], "full").na.fill(0.0, ["wa", "wb"])
    made = {"max": F.greatest("wa", "wb"), "sum": F.col("wa") + F.col("wb"), "mean": (F.col("wa") + F.col("wb")) / 2}[how]
    return both.select("x", "y", made.alias("weight"))


def loyal(log: DataFrame, pixels: DataFrame, seed: int = 0) -> DataFrame:
    """Each user's changes after the first that hits a composition go to random pixels of it (the smallest id, if it hits several); others stay."""
    own = pixels.select("comp_id", "x", "y").distinct()
    hits = log.join(own, ["x", "y"]).groupBy("user").agg(F.min(F.struct("seconds", "event_id", "comp_id")).alias("first"))
    order = Window.partitionBy("comp_id").orderBy("x", "y")
    numbered = own.select("comp_id", F.col("x").alias("nx"), F.col("y").alias("ny"), (F.row_number().over(order) - 1).alias("i"))
    area = own.groupBy("comp_id").agg(F.count("*").alias("area"))
    moved = log.join(hits, "user", "left").withColumn("later", F.coalesce(F.struct("seconds", "event_id") > F.struct("first.seconds", "first.event_id"), F.lit(False)))
    chosen = moved.withColumn("comp_id", F.when(F.col("later"), F.col("first.comp_id"))).join(area, "comp_id", "left")
    picked = chosen.withColumn("i", F.floor(hash_unit(F.col("event_id"), seed=seed) * F.col("area")).cast("int")).join(numbered, ["comp_id", "i"], "left")
    return picked.select("event_id", "seconds", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"), "user", "color", "moderator", "comp_id")
