"""Complexity of the images of compositions. An image is the rows (comp_id, bin, x, y, color) of one composition and bin.

What counts and sums express stays in DataFrames; compressors and transforms run as small kernels on one packed image, grouped by composition and bin, never by
composition alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.functions.columns import hash_unit

IMAGE = ["comp_id", "bin"]


def _cells(images: DataFrame, factor: int) -> DataFrame:
    corner = Window.partitionBy(*IMAGE)
    x0, y0 = F.min("x").over(corner), F.min("y").over(corner)
    return images.select(*IMAGE, F.floor((F.col("x") - x0) / factor).cast("int").alias("bx"), F.floor((F.col("y") - y0) / factor).cast("int").alias("by"), "color")


def block_modes(images: DataFrame, factor: int) -> DataFrame:
    """The most frequent colour of each block of `factor` pixels, also of cut-off blocks at the edge; ties: the lowest colour."""
    counts = _cells(images, factor).groupBy(*IMAGE, "bx", "by", "color").agg(F.count("*").alias("n"))
    return counts.groupBy(*IMAGE, "bx", "by").agg(F.max_by("color", F.struct("n", -F.col("color"))).alias("color"))


def differing_blocks(images: DataFrame, references: DataFrame, factor: int) -> DataFrame:
    """Blocks whose modes differ between two images."""
    other = block_modes(references, factor).withColumnRenamed("color", "other")
    joined = block_modes(images, factor).join(other, [*IMAGE, "bx", "by"])
    return joined.groupBy(*IMAGE).agg(F.sum((F.col("color") != F.col("other")).cast("long")).alias("n_diff"), F.count("*").alias("n_blocks"))


def multiscale_complexity(images: DataFrame, factors: list[int]) -> DataFrame:
    """Sum over scales of squared scale times the colours' entropy at that scale, over the number of pixels."""
    area = images.groupBy(*IMAGE).agg(F.count("*").alias("area"))
    parts = None
    for factor in factors:
        counts = block_modes(images, factor).groupBy(*IMAGE, "color").agg(F.count("*").alias("n"))
        p = F.col("n") / F.sum("n").over(Window.partitionBy(*IMAGE))
        part = counts.withColumn("p", p).groupBy(*IMAGE).agg((float(factor**2) * F.sum(-F.col("p") * F.log("p"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*IMAGE).agg(F.sum("part").alias("s")).join(area, IMAGE).select(*IMAGE, (F.col("s") / F.col("area")).alias("complexity"))


def _lines(images: DataFrame, along: str, across: str) -> DataFrame:
    letter = F.chr(F.col("color") + 65)
    return images.groupBy(*IMAGE, F.col(across).alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(along, letter.alias("c")))), lambda s: s["c"]), "").alias("line"))


def levenshtein_complexity(images: DataFrame) -> DataFrame:
    """Mean edit distance of neighbouring rows times that of neighbouring columns (the mean of their outer product)."""
    order = Window.partitionBy(*IMAGE).orderBy("at")
    out = None
    for name, along, across in (("rows", "x", "y"), ("columns", "y", "x")):
        lines = _lines(images, along, across).withColumn("old", F.lag("line").over(order)).where("old is not null")
        mean = lines.groupBy(*IMAGE).agg(F.avg(F.levenshtein("line", "old")).alias(name))
        out = mean if out is None else out.join(mean, IMAGE)
    return out.withColumn("complexity", F.col("rows") * F.col("columns"))


def color_shares(images: DataFrame) -> DataFrame:
    """Share of each colour in each image, and its rank; ties: the lowest colour."""
    counts = images.groupBy(*IMAGE, "color").agg(F.count("*").alias("n"))
    here = Window.partitionBy(*IMAGE)
    return counts.select(*IMAGE, "color", (F.col("n") / F.sum("n").over(here)).alias("share"), F.row_number().over(here.orderBy(F.desc("n"), "color")).alias("rank"))


def touched_boxes(images: DataFrame, sizes: list[int]) -> DataFrame:
    """Boxes of each size that hold each colour."""
    parts = [_cells(images, size).groupBy(*IMAGE, "color").agg(F.countDistinct("bx", "by").alias("n_boxes")).withColumn("size", F.lit(size)) for size in sizes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def touched_boxes_by_corners(images: DataFrame, share: float = 0.1, most: int = 10, least: int = 3, averaged: int = 3) -> DataFrame:
    """`(comp_id, bin, color, size, n_boxes)`: boxes that hold each colour, for sizes from 1 to a share of the shorter side, rounded, but `least` at least and `most` at most.

    For the `averaged` largest sizes the number is the mean over four grids, each of which begins at another corner of the image. A pixel meets a grid by
    arithmetic, so it makes a row for each size and grid, ten and four at most.
    """
    here = Window.partitionBy(*IMAGE)
    at = images.withColumns({c: F.col(c) - F.min(c).over(here) for c in ("x", "y")})
    at = at.withColumns({"w": F.max("x").over(here) + 1, "h": F.max("y").over(here) + 1})
    top = F.least(F.greatest(F.bround(share * F.least("w", "h")).cast("int"), F.lit(least)), F.lit(most))
    sized = at.withColumn("top", top).withColumn("size", F.explode(F.sequence(F.lit(1), "top")))
    grids = F.when(F.col("size") > F.col("top") - averaged, F.array(*(F.lit(g) for g in range(4)))).otherwise(F.array(F.lit(0)))
    cut = lambda side: F.ceil(F.col(side) / F.col("size")) * F.col("size") - F.col(side)  # noqa: E731  what the grid reaches beyond the image
    shifted = sized.withColumn("grid", F.explode(grids))
    bx = F.floor((F.col("x") + F.when(F.col("grid").isin(1, 3), cut("w")).otherwise(0)) / F.col("size"))
    by = F.floor((F.col("y") + F.when(F.col("grid").isin(1, 2), cut("h")).otherwise(0)) / F.col("size"))
    counts = shifted.groupBy(*IMAGE, "color", "size", "grid").agg(F.countDistinct(bx, by).alias("n"))
    return counts.groupBy(*IMAGE, "color", "size").agg(F.avg("n").alias("n_boxes"))


def fractal_dimensions(boxes: DataFrame) -> DataFrame:
    """Minus the slope of log10 of the boxes on log10 of their size, for each colour."""
    x, y = F.log10("size"), F.log10("n_boxes")
    return boxes.groupBy(*IMAGE, "color").agg((-F.covar_pop(x, y) / F.var_pop(x)).alias("dimension"))


def fractal_summary(dimensions: DataFrame, shares: DataFrame) -> DataFrame:
    """Median of the dimensions above 0, and their mean weighted by colour share."""
    joined = dimensions.join(shares.select(*IMAGE, "color", "share"), [*IMAGE, "color"])
    above = F.when(F.col("dimension") > 1e-9, F.col("dimension"))
    return joined.withColumn("above", above).groupBy(*IMAGE).agg(F.expr("percentile(above, 0.5)").alias("median"), F.sum(F.col("dimension") * F.col("share")).alias("weighted"))


def ripley(points: DataFrame, distances: list[float], most: int = 100) -> DataFrame:
    """Ordered pairs within each distance over n^2, and the mean pair distance, of at most `most` changes of each bin.

    The changes with the smallest hashes are taken, so a bin's pairs are bounded; null with fewer than two. points: comp_id, bin, event_id, x, y.
    """
    order = Window.partitionBy(*IMAGE).orderBy(F.xxhash64("event_id"), "event_id")
    some = points.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most).select(*IMAGE, "i", "x", "y")
    other = some.select(*IMAGE, F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    pairs = some.join(other, IMAGE).where("i < j").withColumn("d", d)
    n = some.groupBy(*IMAGE).agg(F.count("*").alias("n"))
    sums = pairs.groupBy(*IMAGE).agg(*(F.sum((F.col("d") <= r).cast("long")).alias(f"n{k}") for k, r in enumerate(distances)), F.avg("d").alias("mean_distance"))
    return n.join(sums, IMAGE, "left").select(*IMAGE, "n", *((2 * F.col(f"n{k}") / (F.col("n") * F.col("n"))).alias(f"k_{k}") for k in range(len(distances))), "mean_distance")


def random_ripley(pixels: DataFrame, distances: list[float], points: int = 100, trials: int = 10) -> DataFrame:
    """`(comp_id, area, ref_k, ref_mean)`: what independent uniform points on a composition's pixels give: the pairs within each distance over all pairs, times the area, and the
    mean pair distance, each as a mean over trials.

    Points are drawn by hashes, with repetition, from the composition's numbered pixels. A trial is a row of a hundred points; its pairs never leave the kernel.
    """
    own = pixels.select("comp_id", "x", "y").distinct()
    numbered = own.withColumn("i", F.row_number().over(Window.partitionBy("comp_id").orderBy("x", "y")) - 1)
    area = own.groupBy("comp_id").agg(F.count("*").alias("area"))
    drawn = area.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    drawn = drawn.withColumn("i", F.floor(hash_unit(F.col("comp_id"), F.col("trial"), F.col("point"), seed=15) * F.col("area")).cast("int"))
    held = drawn.join(numbered, ["comp_id", "i"]).groupBy("comp_id", "area", "trial").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))

    @F.pandas_udf("k array<double>, mean double")
    def pairs(xs: pd.Series, ys: pd.Series, size: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, n in zip(xs, ys, size, strict=True):
            a, b = np.triu_indices(len(x), 1)
            d = np.hypot(np.subtract(x[a], x[b], dtype=float), np.subtract(y[a], y[b], dtype=float))
            out.append([[float((d <= r).mean() * n) for r in distances], float(d.mean())])
        return pd.DataFrame(out, columns=["k", "mean"])

    each = held.select("comp_id", "area", pairs("xs", "ys", "area").alias("p"))
    means = F.array(*(F.avg(F.col("p.k")[i]) for i in range(len(distances))))
    return each.groupBy("comp_id", "area").agg(means.alias("ref_k"), F.avg("p.mean").alias("ref_mean"))


def normalised_ripley(found: DataFrame, reference: DataFrame, n_distances: int) -> DataFrame:
    """`(comp_id, bin, ripley_k..., ripley_norm_k..., distance, distance_norm)` from `ripley` and `random_ripley`: pairs within each distance over all pairs, times the area, and
    over what uniform points give. All null with fewer than two changes; a norm is null where uniform points give 0."""
    joined = found.join(reference, "comp_id")
    several = F.col("n") > 1
    k = [F.when(several, F.col(f"k_{i}") * F.col("n") / F.when(several, F.col("n") - 1) * F.col("area")) for i in range(n_distances)]
    over = lambda a, b: F.when(b > 0, a / F.when(b > 0, b))
    norms = [over(c, F.col("ref_k")[i]) for i, c in enumerate(k)]
    return joined.select(
        *IMAGE, *(c.alias(f"ripley_{i}") for i, c in enumerate(k)), *(c.alias(f"ripley_norm_{i}") for i, c in enumerate(norms)),
        F.when(several, F.col("mean_distance")).alias("distance"), F.when(several, over(F.col("mean_distance"), F.col("ref_mean"))).alias("distance_norm"),
    )


def pack(group: pd.DataFrame) -> np.ndarray:
    """The rows of an image as a 2-D array; cells without a row hold 255."""
    x, y = group["x"].to_numpy() - group["x"].min(), group["y"].to_numpy() - group["y"].min()
    image = np.full((y.max() + 1, x.max() + 1), 255, np.uint8)
    image[y, x] = group["color"].to_numpy()
    return image


def shift_correlation(now: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Share of pixels of equal colour for every cyclic shift of the old image, by Fourier transforms of each colour's mask."""
    total = np.zeros(now.shape)
    for color in np.unique(np.concatenate([now.ravel(), old.ravel()])):
        total += np.fft.ifft2(np.fft.fft2(now == color) * np.conj(np.fft.fft2(old == color))).real
    return total / now.size


def image_shifts(images: DataFrame) -> DataFrame:
    """For each image and the one before: agreement unshifted, the best shift's agreement, and how far that shift is."""
    before = images.select("comp_id", (F.col("bin") + 1).alias("bin"), "x", "y", F.col("color").alias("old"))
    pairs = images.join(before, [*IMAGE, "x", "y"])

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        now, old = pack(group), pack(group.assign(color=group["old"]))
        found = np.round(shift_correlation(now, old), 9)
        best = np.unravel_index(np.argmax(found), found.shape)
        away = [min(b, n - b) for b, n in zip(best, found.shape, strict=True)]
        return pd.DataFrame([[group["comp_id"].iloc[0], group["bin"].iloc[0], found[0, 0], found[best], float(np.hypot(*away))]])

    return pairs.groupBy(*IMAGE).applyInPandas(kernel, "comp_id string, bin int, unshifted double, best double, distance double")


#: Low-pass decomposition filter of the Daubechies wavelet with four vanishing moments.
DB4 = (
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
)


def db4_energies(values: np.ndarray) -> tuple[float, float]:
    """Energies of the low and high half of one db4 step, the ends mirrored."""
    low = np.array(DB4)
    high = low[::-1] * np.where(np.arange(8) % 2, 1, -1)
    wide = np.pad(values, 7, mode="symmetric")
    return tuple(float((np.convolve(wide, f, "valid")[1::2] ** 2).sum()) for f in (low, high))


def rolling_wavelets(series: DataFrame, window: int) -> DataFrame:
    """`low` and `high` of `db4_energies` over the last `window` values of each series (comp_id, bin, val); fewer at the beginning are taken as they are."""
    order = Window.partitionBy("comp_id").orderBy("bin").rowsBetween(-(window - 1), 0)
    held = series.withColumn("values", F.collect_list("val").over(order))

    @F.pandas_udf("low double, high double")
    def energies(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([db4_energies(np.asarray(v, float)) for v in values], columns=["low", "high"])

    return held.withColumn("e", energies("values")).select("comp_id", "bin", "val", "e.low", "e.high")


def shift_profiles(images: DataFrame) -> DataFrame:
    """`(comp_id, bin, distance, n_shifts, agreement)`: mean share of equal pixels between each image and the one before over all shifts of a rounded distance, 0 unshifted."""
    before = images.select("comp_id", (F.col("bin") + 1).alias("bin"), "x", "y", F.col("color").alias("old"))

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        now, old = pack(group), pack(group.assign(color=group["old"]))
        found = shift_correlation(now, old)
        away = [np.minimum(np.arange(n), n - np.arange(n)) for n in found.shape]
        distance = np.rint(np.hypot(away[0][:, None], away[1][None, :])).astype(int)
        n = np.bincount(distance.ravel())
        mean = np.bincount(distance.ravel(), found.ravel()) / np.maximum(n, 1)
        kept = np.flatnonzero(n)
        return pd.DataFrame({"comp_id": group["comp_id"].iloc[0], "bin": group["bin"].iloc[0], "distance": kept, "n_shifts": n[kept], "agreement": np.round(mean[kept], 9)})

    return images.join(before, [*IMAGE, "x", "y"]).groupBy(*IMAGE).applyInPandas(kernel, "comp_id string, bin int, distance int, n_shifts int, agreement double")


def shift_descriptors(profiles: DataFrame) -> DataFrame:
    """Least agreement beyond distance 0, the distance that has it (the smaller of two), and the slope of agreement over distance with double weight for the farther half."""
    here = Window.partitionBy(*IMAGE)
    rows = profiles.where("distance > 0").withColumn("half", F.max("distance").over(here) / 2)
    w = F.when(F.col("distance") > F.col("half"), 2.0).otherwise(1.0)
    d, a = F.col("distance").cast("double"), F.col("agreement")
    m = rows.groupBy(*IMAGE).agg(
        F.min("agreement").alias("least"), F.min_by("distance", F.struct("agreement", "distance")).alias("at"),
        F.sum(w).alias("w"), F.sum(w * d).alias("wd"), F.sum(w * a).alias("wa"), F.sum(w * d * d).alias("wdd"), F.sum(w * d * a).alias("wda"),
    )
    spread = F.col("wdd") - F.col("wd") * F.col("wd") / F.col("w")
    return m.select(*IMAGE, "least", "at", F.when(spread > 1e-9, (F.col("wda") - F.col("wd") * F.col("wa") / F.col("w")) / spread).alias("slope"))
