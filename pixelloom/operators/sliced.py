"""Null models whose weights change with time: positions drawn from the compositions that are alive when a change is made.

The canvas's time is cut where any pixel changes owners. Pixels with the same owners in all layers form a class and have the same weight, so a slice's
weights are a table of classes, not of pixels. A class's members are numbered once for each version, the time over which they stay the same. A change finds
its slice, then a class by weight, then one of the class's members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.functions.columns import hash_unit
from pixelloom.plans.storage import write_shared

#: Parts of a slice's unit interval, and of the whole time, by which range joins become equi-joins.
SLOTS, TIME_PARTS = 64, 1024


def time_slices(owners: DataFrame) -> DataFrame:
    """`(slice, t_beg, t_end)` between consecutive times at which any pixel changes owners, numbered from 0. A row for each distinct time of the atlas."""
    times = owners.select(F.explode(F.array("t_beg", "t_end")).alias("t_beg")).distinct()
    order = Window.orderBy("t_beg")
    numbered = times.withColumns({"slice": F.row_number().over(order) - 1, "t_end": F.lead("t_beg").over(order)})
    return numbered.where("t_end is not null").select("slice", "t_beg", "t_end")


def pixel_classes(owners: DataFrame, slices: DataFrame, layers: int) -> DataFrame:
    """`(x, y, owners, s_beg, s_end)`: the owners of each pixel by layer (null where there are fewer) over slices from `s_beg` up to `s_end`, exclusive.

    owners: t_beg, t_end, x, y, layer (from 1), comp_id.
    """
    at = [F.max(F.when(F.col("layer") == k, F.col("comp_id"))) for k in range(1, layers + 1)]
    each = owners.groupBy("x", "y", "t_beg", "t_end").agg(F.array(*at).alias("owners"))
    begins = slices.select("t_beg", F.col("slice").alias("s_beg"))
    ends = slices.select("t_end", (F.col("slice") + 1).alias("s_end"))
    return each.join(begins, "t_beg").join(ends, "t_end").select("x", "y", "owners", "s_beg", "s_end")


def layer_areas(classes: DataFrame, layers: int) -> DataFrame:
    """`(slice, layer, comp_id, area)`: how many pixels each composition owns in each layer in each slice: gains and losses summed along the slices, then one row a slice."""
    owned = F.explode(F.array(*(F.struct(F.lit(k).alias("layer"), F.get("owners", F.lit(k - 1)).alias("comp_id")) for k in range(1, layers + 1))))
    rows = classes.select(owned.alias("o"), "s_beg", "s_end").select("o.*", "s_beg", "s_end").where("comp_id is not null")
    marks = rows.select("layer", "comp_id", F.col("s_beg").alias("slice"), F.lit(1).alias("n")).unionByName(rows.select("layer", "comp_id", F.col("s_end").alias("slice"), F.lit(-1).alias("n")))
    line = Window.partitionBy("layer", "comp_id").orderBy("slice")
    steps = marks.groupBy("layer", "comp_id", "slice").agg(F.sum("n").alias("n")).withColumns({"area": F.sum("n").over(line), "next": F.lead("slice").over(line)})
    return steps.where("area > 0").select("layer", "comp_id", "area", F.explode(F.sequence("slice", F.col("next") - 1)).alias("slice"))


def class_versions(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(owners, v_beg, v_end, n)` of each version of a class, and `(owners, v_beg, i, x, y)` of its members, numbered from 0.

    A version runs between two consecutive slices at which the class gains or loses a member. A class is bounded by its smallest composition.
    """
    ends = classes.select("owners", F.explode(F.array("s_beg", "s_end")).alias("v_beg")).distinct()
    each = ends.withColumn("v_end", F.lead("v_beg").over(Window.partitionBy("owners").orderBy("v_beg"))).where("v_end is not null")
    held = classes.join(each.hint("merge"), "owners").where((F.col("s_beg") <= F.col("v_beg")) & (F.col("s_end") >= F.col("v_end")))
    members = held.select("owners", "v_beg", "v_end", (F.row_number().over(Window.partitionBy("owners", "v_beg").orderBy("x", "y")) - 1).alias("i"), "x", "y")
    members = write_shared(members, "class-members")
    return members.groupBy("owners", "v_beg", "v_end").agg(F.count("*").alias("n")), members.drop("v_end")


def _combined(weights: Column, owned: Column, how: str) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    if how == "max":
        return F.array_max(weights)
    return total if how == "sum" else total / F.greatest(F.size(owned), F.lit(1))


def class_weights(classes: DataFrame, versions: DataFrame, layers: int, exponent: float, how: str, unowned: float = 0.0) -> DataFrame:
    """`(slice, owners, v_beg, n, weight)`: what a pixel of each class weighs in each slice in which the class has members.

    A layer's weight is the number of pixels that its owner has in that layer and slice, to the `exponent`; `unowned` where it has no owner. Layers are
    combined by `max`, `sum`, or the `mean` over those with an owner.
    """
    if how not in ("max", "sum", "mean"):
        raise ValueError(f"layers can't be combined by {how}")
    alive = versions.withColumn("slice", F.explode(F.sequence("v_beg", F.col("v_end") - 1))).drop("v_end")
    areas = layer_areas(classes, layers)
    for k in range(1, layers + 1):
        own = areas.where(F.col("layer") == k).select("slice", F.col("comp_id").alias(f"c{k}"), F.pow(F.col("area").cast("double"), F.lit(exponent)).alias(f"w{k}"))
        alive = alive.withColumn(f"c{k}", F.get("owners", F.lit(k - 1))).join(own.hint("merge"), ["slice", f"c{k}"], "left")
    weights = F.array(*(F.coalesce(f"w{k}", F.lit(unowned)) for k in range(1, layers + 1)))
    return alive.select("slice", "owners", "v_beg", "n", _combined(weights, F.filter("owners", lambda c: c.isNotNull()), how).alias("weight"))


class SlicedWeights:
    """The tables that draws start from, written once: slices, classes' members, and weights with their parts of each slice's unit interval.

    owners: of `compositions.pixel_owners`, cut to the opening of the canvas.
    """

    def __init__(self, owners: DataFrame, layers: int = 2, exponent: float = 1.0, how: str = "max", unowned: float = 0.0) -> None:
        owners = write_shared(owners, "owners")
        self.slices = write_shared(time_slices(owners), "slices")
        classes = write_shared(pixel_classes(owners, self.slices, layers), "classes")
        versions, self.members = class_versions(classes)
        self.weights = write_shared(class_weights(classes, versions, layers, exponent, how, unowned).where("weight > 0"), "class-weights")

    def pixel_weights(self) -> DataFrame:
        """`(t_beg, t_end, x, y, weight)`: a row for each pixel that weighs anything in each slice."""
        return self.weights.join(self.members.hint("merge"), ["owners", "v_beg"]).join(F.broadcast(self.slices), "slice").select("t_beg", "t_end", "x", "y", "weight")  # a row for each time of the atlas

    def parts(self) -> DataFrame:
        """`(slice, owners, v_beg, n, lo, hi)`: each class's part of its slice's unit interval, in the order of its owners."""
        order = Window.partitionBy("slice").orderBy("owners", "v_beg")
        mass = F.col("weight") * F.col("n")
        run, total = F.sum(mass).over(order), F.sum(mass).over(Window.partitionBy("slice"))
        last = F.lead("slice").over(order).isNull()  # rounding leaves no gap at 1
        return self.weights.withColumns({"hi": F.when(last, 1.0).otherwise(run / total), "lo": (run - mass) / total}).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))

    def draw(self, log: DataFrame, seed: int = 0) -> DataFrame:
        """`log` with positions drawn from the weights of the slice in which each change falls, and `owners` of the pixel drawn.

        Slices hold their beginning, not their end. A change in no slice, or in one where nothing weighs, stays where it is, with null `owners`.
        """
        span = self.slices.agg(F.min("t_beg").alias("a"), F.max("t_end").alias("b")).first()
        width = ((span["b"] - span["a"]) or 1.0) / TIME_PARTS if span["a"] is not None else 1.0
        part = lambda t: F.floor((t - F.lit(span["a"] or 0.0)) / width)
        spread = self.slices.withColumn("part", F.explode(F.sequence(part(F.col("t_beg")), part(F.col("t_end")))))
        timed = log.withColumn("part", part(F.col("seconds"))).join(spread.withColumnsRenamed({"t_beg": "s0", "t_end": "s1"}), "part")
        timed = timed.where((F.col("seconds") >= F.col("s0")) & (F.col("seconds") < F.col("s1")))
        event = F.col("event_id")
        drawn = timed.select("event_id", "slice", hash_unit(event, seed=2 * seed).alias("u"), hash_unit(event, seed=2 * seed + 1).alias("v"))
        slot = lambda c: F.least(F.floor(F.col(c) * SLOTS), F.lit(SLOTS - 1))
        intervals = self.parts().withColumn("slot", F.explode(F.sequence(slot("lo"), slot("hi")))).select("slice", "slot", "owners", "v_beg", "n", "lo", "hi")
        picked = drawn.withColumn("slot", slot("u")).join(intervals, ["slice", "slot"]).where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        picked = picked.select("event_id", "owners", "v_beg", F.floor(F.col("v") * F.col("n")).cast("int").alias("i"))
        placed = picked.join(self.members, ["owners", "v_beg", "i"]).select("event_id", "owners", F.col("x").alias("nx"), F.col("y").alias("ny"))
        moved = log.join(placed, "event_id", "left")
        kept = [F.coalesce(f"n{c}", c).alias(c) if c in ("x", "y") else F.col(c) for c in log.columns]
        return moved.select(*kept, "owners")
