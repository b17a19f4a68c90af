"""Compositions: borders, pixels, time ranges, overlaps.

Tables of pixels and compositions are made by exploding small ones, whose size Spark takes for theirs; so their joins ask for a merge, or the driver would broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.config import Section
from pixelloom.functions.columns import bin_number


def extend_ranges(borders: DataFrame, before: float, after: float, total: float) -> DataFrame:
    """The first range of each composition begins earlier and its last ends later, within [0, total]."""
    order = Window.partitionBy("comp_id").orderBy("t0", "t1")
    first, last = F.row_number().over(order) == 1, F.row_number().over(Window.partitionBy("comp_id").orderBy(F.desc("t1"), F.desc("t0"))) == 1
    marked = borders.withColumns({"_first": first, "_last": last})
    t0 = F.when(F.col("_first"), F.greatest(F.col("t0") - before, F.lit(0.0))).otherwise(F.col("t0"))
    t1 = F.when(F.col("_last"), F.least(F.col("t1") + after, F.lit(total))).otherwise(F.col("t1"))
    return marked.withColumns({"t0": t0, "t1": t1}).drop("_first", "_last")


def overlaps(pixels: DataFrame) -> DataFrame:
    """Pairs of compositions with common pixels, their number, and the smaller of its shares of both areas.

    An equi-join on the pixel; pairs without a common pixel never meet.
    """
    own = pixels.select("comp_id", "x", "y").distinct()
    area = own.groupBy("comp_id").agg(F.count("*").alias("area"))
    other = own.withColumnRenamed("comp_id", "other_id")
    common = own.join(other.hint("merge"), ["x", "y"]).where("comp_id < other_id").groupBy("comp_id", "other_id").agg(F.count("*").alias("n_common"))
    both = common.join(area.hint("merge"), "comp_id").join(area.select(F.col("comp_id").alias("other_id"), F.col("area").alias("other_area")).hint("merge"), "other_id")
    return both.select("comp_id", "other_id", "n_common", F.least(F.col("n_common") / F.col("area"), F.col("n_common") / F.col("other_area")).alias("overlap"))


def snap_rectangles(borders: DataFrame, tolerance: int = 2, least_side: int = 10) -> DataFrame:
    """Four-point paths whose points lie within `tolerance` of the corners of their box, with sides above `least_side`, become that box. `path array<struct<x,y>>`."""
    xs, ys = F.transform("path", lambda p: p["x"]), F.transform("path", lambda p: p["y"])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    near = lambda v, a, b: (F.abs(v - a) <= tolerance) | (F.abs(v - b) <= tolerance)
    fits = (F.size("path") == 4) & (x1 - x0 > least_side) & (y1 - y0 > least_side) & F.forall("path", lambda p: near(p["x"], x0, x1) & near(p["y"], y0, y1))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = F.array(corner(x0, y0), corner(x0, y1), corner(x1, y1), corner(x1, y0))
    return borders.withColumns({"is_rectangle": fits, "path": F.when(fits, box).otherwise(F.col("path"))})


def clamp(borders: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """Paths clamped to the canvas, with bounding box, width and height."""
    lo_x, hi_x = min(s.xmin for s in sections), max(s.xmax for s in sections)
    lo_y, hi_y = min(s.ymin for s in sections), max(s.ymax for s in sections)
    inside = F.transform(
        "path", lambda p: F.struct(F.greatest(F.least(p["x"], F.lit(hi_x)), F.lit(lo_x)).alias("x"), F.greatest(F.least(p["y"], F.lit(hi_y)), F.lit(lo_y)).alias("y"))
    )
    box = borders.withColumn("path", inside)
    xs, ys = F.transform("path", lambda p: p["x"]), F.transform("path", lambda p: p["y"])
    return box.withColumns({"xmin": F.array_min(xs), "xmax": F.array_max(xs), "ymin": F.array_min(ys), "ymax": F.array_max(ys)}).withColumns(
        {"width": F.col("xmax") - F.col("xmin") + 1, "height": F.col("ymax") - F.col("ymin") + 1}
    )


def _line(x: int, y: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Pixels of Bresenham's line as (y, x), both ends included."""
    dx, dy, sx, sy = abs(x1 - x), -abs(y1 - y), (1 if x < x1 else -1), (1 if y < y1 else -1)
    error, found = dx + dy, [(y, x)]
    while (x, y) != (x1, y1):
        twice = 2 * error
        if twice >= dy:
            error, x = error + dy, x + sx
        if twice <= dx:
            error, y = error + dx, y + sy
        found.append((y, x))
    return found


def polygon_runs(xs: list[int], ys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(y, x0, x1)` of the runs of pixels inside or on the border of a polygon, by rows, none touching another: even-odd scan lines, and Bresenham lines for the border.

    An edge meets the scan lines from its lower end up to, but not with, its upper one. Runs of one line are merged on a single axis on which lines lie apart.
    """
    ax, ay = np.asarray(xs, np.int64), np.asarray(ys, np.int64)
    if not len(ax):
        return (np.empty(0, np.int64),) * 3
    bx, by = np.roll(ax, -1), np.roll(ay, -1)
    border = np.array([p for edge in zip(ax.tolist(), ay.tolist(), bx.tolist(), by.tolist(), strict=True) for p in _line(*edge)], np.int64)
    height = np.abs(by - ay)
    edge = np.repeat(np.arange(len(ax)), height)
    y = np.minimum(ay, by)[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(height) - height, height)
    cut = ax[edge] + (y - ay[edge]) * (bx[edge] - ax[edge]) / (by[edge] - ay[edge])
    order = np.lexsort((cut, y))
    y, cut = y[order], cut[order]
    first, last = np.ceil(cut[::2]).astype(np.int64), np.floor(cut[1::2]).astype(np.int64)  # each line is cut an even number of times
    inside = first <= last
    left, wide = int(ax.min()), int(ax.max() - ax.min()) + 3
    line = np.concatenate([border[:, 0], y[::2][inside]]) * wide - left
    a, b = line + np.concatenate([border[:, 1], first[inside]]), line + np.concatenate([border[:, 1], last[inside]])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    reach = np.maximum.accumulate(b)
    fresh = np.concatenate([[True], a[1:] > reach[:-1] + 1])
    a, b = a[fresh], reach[np.concatenate([fresh[1:], [True]])]
    y = a // wide
    return y, a - y * wide + left, b - y * wide + left


def polygon_pixels(borders: DataFrame) -> DataFrame:
    """`(comp_id, x, y, t0, t1)`: pixels inside or on each border. Each border is filled on its own, where it lies, as runs of pixels; Spark makes the pixels of the runs."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                y, x0, x1 = polygon_runs([p["x"] for p in row.path], [p["y"] for p in row.path])
                yield pd.DataFrame({"comp_id": row.comp_id, "x0": x0, "x1": x1, "y": y, "t0": row.t0, "t1": row.t1})

    runs = borders.select("comp_id", "path", "t0", "t1").mapInPandas(fill, "comp_id string, x0 int, x1 int, y int, t0 double, t1 double")
    return runs.select("comp_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "t0", "t1")


def merge_ranges(pixels: DataFrame) -> DataFrame:
    """Ranges of a pixel that touch (relative 1e-10, absolute 1e-5) or overlap become one; disjoint ones stay."""
    order = Window.partitionBy("comp_id", "x", "y").orderBy("t0", "t1")
    reach = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("t0") - reach > 1e-5 + 1e-10 * F.abs(reach), F.lit(True)).cast("int")
    grouped = pixels.withColumn("fresh", apart).withColumn("g", F.sum("fresh").over(order))
    return grouped.groupBy("comp_id", "x", "y", "g").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("g")


def section_of_pixels(pixels: DataFrame, sections: DataFrame) -> DataFrame:
    """Add `section` and `t_open`: the first section that holds the pixel. Sections are a handful of rows."""
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    first = pixels.select("x", "y").distinct().join(F.broadcast(sections), inside).groupBy("x", "y").agg(F.min(F.struct("section", "t_open")).alias("s"))
    return pixels.join(first, ["x", "y"]).select(*pixels.columns, F.col("s.section").alias("section"), F.col("s.t_open").alias("t_open"))


def cut_to_open(pixels: DataFrame) -> DataFrame:
    """Ranges begin when the pixel's section opens; those wholly before drop out."""
    return pixels.withColumn("t0", F.greatest("t0", "t_open")).where("t1 > t0")


def life(pixels: DataFrame, whiteout: float) -> DataFrame:
    return pixels.groupBy("comp_id").agg(F.min("t0").alias("tmin"), F.least(F.max("t1"), F.lit(whiteout)).alias("tmax"), F.countDistinct("x", "y").alias("area"))


def location_jumps(pixels: DataFrame) -> DataFrame:
    """Whether no pixel of a composition is on for exactly the time in which the composition is: the union of its ranges, those that touch being one.

    Ranges are equal within a relative 1e-10 and an absolute 1e-5.
    """
    ranges = F.array_sort(F.collect_list(F.struct("t0", "t1")))
    nowhere = F.lit(0)
    active = merge_ranges(pixels.select("comp_id", "t0", "t1").distinct().withColumns({"x": nowhere, "y": nowhere}))
    whole = active.groupBy("comp_id").agg(ranges.alias("whole"))
    each = merge_ranges(pixels).groupBy("comp_id", "x", "y").agg(ranges.alias("own"))
    near = lambda a, b: F.abs(a - b) <= 1e-5 + 1e-10 * F.abs(b)
    alike = F.zip_with("own", "whole", lambda a, b: near(a["t0"], b["t0"]) & near(a["t1"], b["t1"]))
    same = (F.size("own") == F.size("whole")) & F.forall(alike, lambda ok: F.coalesce(ok, F.lit(False)))
    return each.join(whole.hint("merge"), "comp_id").groupBy("comp_id").agg((~F.bool_or(same)).alias("jumps"))


def active_area(pixels: DataFrame, width: float) -> DataFrame:
    """Pixels of each composition that are on at any time of each bin of its life."""
    start = pixels.groupBy("comp_id").agg(F.min("t0").alias("start"))
    on = pixels.join(start.hint("merge"), "comp_id")
    first = F.floor((F.col("t0") - F.col("start")) / width).cast("int") + 1
    bins = F.sequence(first, F.greatest(bin_number(F.col("t1"), F.col("start"), width), first))
    return on.select("comp_id", "x", "y", F.explode(bins).alias("bin")).groupBy("comp_id", "bin").agg(F.countDistinct("x", "y").alias("active_area"))


def duplicates(pixels: DataFrame, least: float = 0.99) -> DataFrame:
    """`(comp_id, same_as)`: compositions with the same time ranges as an earlier id's and more than `least` of the pixels in common."""
    ranges = pixels.groupBy("comp_id").agg(F.xxhash64(F.array_sort(F.collect_set(F.struct("t0", "t1")))).alias("times"))
    close = overlaps(pixels).where(F.col("overlap") > least)
    paired = close.join(ranges.hint("merge"), "comp_id").join(ranges.select(F.col("comp_id").alias("other_id"), F.col("times").alias("other_times")).hint("merge"), "other_id")
    return paired.where("times = other_times").groupBy(F.col("other_id").alias("comp_id")).agg(F.min("comp_id").alias("same_as"))


def rejected_overlaps(pixels: DataFrame, least: float) -> DataFrame:
    """`(comp_id, t0, t1)`: times in which a border of a composition shares more than `least` of its pixels, and of the other's, with a border of another one.

    A border is the pixels of a composition that have the same time range; borders are compared in their common time only. The one that begins later is rejected; of two
    that begin together the shorter, and of equal ones that of the larger id. Borders meet in an equi-join on the pixel.
    """
    border = ["comp_id", "t0", "t1"]
    own = pixels.select(*border, "x", "y").distinct()
    area = own.groupBy(*border).agg(F.count("*").alias("area"))
    other = {c: f"other_{c}" for c in border}
    met = own.join(own.withColumnsRenamed(other).hint("merge"), ["x", "y"]).where((F.col("comp_id") < F.col("other_comp_id")) & (F.greatest("t0", "other_t0") < F.least("t1", "other_t1")))
    common = met.groupBy(*border, *other.values()).agg(F.count("*").alias("n"))
    both = common.join(area.hint("merge"), border).join(area.withColumnsRenamed({**other, "area": "other_area"}).hint("merge"), list(other.values()))
    close = both.where(F.col("n") / F.greatest("area", "other_area") > least)
    together = F.abs(F.col("t0") - F.col("other_t0")) <= 1e-8 + 1e-5 * F.abs("other_t0")
    keeps = (F.col("t0") < F.col("other_t0")) | (together & (F.col("t1") >= F.col("other_t1")))
    loser = F.when(keeps, F.col("other_comp_id")).otherwise(F.col("comp_id"))
    return close.select(loser.alias("comp_id"), F.greatest("t0", "other_t0").alias("t0"), F.least("t1", "other_t1").alias("t1")).distinct()


def placement(pixels: DataFrame, sections: DataFrame, margin: int = 3) -> DataFrame:
    """Whether a composition lies at the border, in a corner, or in the centre of each canvas state, each within `margin`."""
    box = pixels.groupBy("comp_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side_x = (F.col("x0") - F.col("xmin") < margin) | (F.col("xmax") - F.col("x1") < margin)
    side_y = (F.col("y0") - F.col("ymin") < margin) | (F.col("ymax") - F.col("y1") < margin)
    mid_x, mid_y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    centre = (F.col("x0") < mid_x + margin) & (F.col("x1") > mid_x - margin) & (F.col("y0") < mid_y + margin) & (F.col("y1") > mid_y - margin)
    return box.join(F.broadcast(sections)).select("comp_id", "section", (side_x | side_y).alias("at_border"), (side_x & side_y).alias("in_corner"), centre.alias("in_centre"))


def pixel_owners(pixels: DataFrame, layers: int = 2) -> DataFrame:
    """`(t_beg, t_end, x, y, layer, comp_id)`: the smallest compositions that hold a pixel in each elementary time slice.

    Slices are each pixel's own, between the ends of its ranges, so nothing is compared across pixels.
    """
    area = pixels.groupBy("comp_id").agg(F.countDistinct("x", "y").alias("area"))
    ends = pixels.select("x", "y", F.explode(F.array("t0", "t1")).alias("t_beg")).distinct()
    slices = ends.withColumn("t_end", F.lead("t_beg").over(Window.partitionBy("x", "y").orderBy("t_beg"))).where("t_end is not null")
    held = slices.join(pixels.hint("merge"), ["x", "y"]).where("t0 <= t_beg and t1 >= t_end").join(area.hint("merge"), "comp_id")
    order = Window.partitionBy("x", "y", "t_beg").orderBy("area", "comp_id")
    return held.withColumn("layer", F.row_number().over(order)).where(F.col("layer") <= layers).select("t_beg", "t_end", "x", "y", "layer", "comp_id")


def size_distribution(pixels: DataFrame, per_decade: int = 5) -> DataFrame:
    area = pixels.groupBy("comp_id").agg(F.countDistinct("x", "y").alias("area"))
    return area.groupBy(F.floor(F.log10("area") * per_decade).cast("int").alias("bin")).agg(F.count("*").alias("n_comps"))


def stable_border_ranges(borders: DataFrame, pixels: DataFrame, least: float = 0.9) -> DataFrame:
    """`(comp_id, piece, t0, t1)`: time ranges without a hole over which a composition's border changes by little.

    A border (comp_id, seq, t0, t1) prolongs the range of the one before it if it begins where that one ends (within a relative 1e-5) and more than `least` of the pixels of
    either (comp_id, seq, x, y) are in both; otherwise it begins a new range. Times should begin with the opening of the canvas already.
    """
    area = pixels.groupBy("comp_id", "seq").agg(F.count("*").alias("area"))
    common = pixels.join(pixels.select("comp_id", (F.col("seq") + 1).alias("seq"), "x", "y").hint("merge"), ["comp_id", "seq", "x", "y"]).groupBy("comp_id", "seq").agg(F.count("*").alias("common"))
    order = Window.partitionBy("comp_id").orderBy("seq")
    each = borders.select("comp_id", "seq", "t0", "t1").join(area.hint("merge"), ["comp_id", "seq"]).join(common.hint("merge"), ["comp_id", "seq"], "left")
    each = each.withColumns({"old_end": F.lag("t1").over(order), "old_area": F.lag("area").over(order)})
    touches = F.abs(F.col("t0") - F.col("old_end")) <= 1e-8 + 1e-5 * F.abs("old_end")
    alike = F.col("common") / F.greatest("area", "old_area") > least
    moved = (~F.coalesce(touches & alike, F.lit(False))).cast("int")
    grouped = each.withColumn("moved", moved).withColumn("piece", F.sum("moved").over(order) - 1)
    return grouped.groupBy("comp_id", "piece").agg(F.min("t0").alias("t0"), F.max_by("t1", "seq").alias("t1"))


def split_at_jumps(borders: DataFrame, pixels: DataFrame) -> DataFrame:
    """`(comp_id, entry, seq, t0, t1)`: an atlas entry's borders as compositions that don't jump.

    A border joins the latest part whose last border has a pixel in common with it, or begins a new part. In a part, a border with the same pixels as the one before prolongs it,
    and a hole in time before any other is closed by the one before. Parts of an entry with several are named `<entry>_part<N>`.

    borders: comp_id, seq, t0, t1; pixels: comp_id, seq, x, y. Common pixels are found by a join; the walk in order sees an entry's borders only, some tens of rows.
    """
    same = F.xxhash64(F.array_sort(F.collect_set(F.struct("x", "y"))))
    shape = pixels.groupBy("comp_id", "seq").agg(same.alias("shape"))
    earlier = pixels.select("comp_id", F.col("seq").alias("old"), "x", "y")
    met = pixels.join(earlier.hint("merge"), ["comp_id", "x", "y"]).where("old < seq").groupBy("comp_id", "seq").agg(F.collect_set("old").alias("met"))
    rows = borders.select("comp_id", "seq", "t0", "t1").join(shape.hint("merge"), ["comp_id", "seq"]).join(met.hint("merge"), ["comp_id", "seq"], "left")

    each = rows.groupBy("comp_id").agg(F.array_sort(F.collect_list(F.struct("seq", "t0", "t1", "shape", "met"))).alias("rows"))

    def walk(entry: str, rows: list[dict]) -> Iterator[tuple]:
        parts: list[list[dict]] = []
        for row in rows:
            near = set(row["met"] or ())
            home = next((part for part in reversed(parts) if part[-1]["seq"] in near), None)
            if home is None:
                parts.append([row])
            else:
                home.append(row)
        for n, part in enumerate(parts, 1):
            kept = part[:1]
            for row in part[1:]:
                if row["shape"] == kept[-1]["shape"]:
                    kept[-1]["t1"] = row["t1"]
                else:
                    kept[-1]["t1"] = max(kept[-1]["t1"], row["t0"])
                    kept.append(row)
            name = entry + (f"_part{n}" if len(parts) > 1 else "")
            yield from ((name, entry, i, row["t0"], row["t1"]) for i, row in enumerate(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("comp_id", pa.string()), ("entry", pa.string()), ("seq", pa.int32()), ("t0", pa.float64()), ("t1", pa.float64())])
        for batch in batches:
            out = [r for entry in batch.to_pylist() for r in walk(entry["comp_id"], entry["rows"])]
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in out], kinds)

    return each.mapInArrow(run, "comp_id string, entry string, seq int, t0 double, t1 double")


def free_pixels(canvas: DataFrame, pixels: DataFrame, total: float) -> DataFrame:
    """`(x, y, t_beg, t_end)`: when a pixel of the canvas (x, y, t_open) is open and in no composition, up to `total`."""
    open_ = canvas.select("x", "y", F.col("t_open").alias("t0"), F.col("t_open").alias("t1"), "t_open")
    marks = open_.unionByName(pixels.join(canvas, ["x", "y"]).select("x", "y", "t0", "t1", "t_open"))
    marks = marks.unionByName(canvas.select("x", "y", F.lit(total).alias("t0"), F.lit(total).alias("t1"), "t_open"))
    order = Window.partitionBy("x", "y").orderBy("t0", "t1")
    reach = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = marks.withColumns({"t_beg": F.greatest(reach, "t_open"), "t_end": F.least("t0", F.lit(total))})
    return gaps.where("t_end > t_beg").select("x", "y", "t_beg", "t_end")
