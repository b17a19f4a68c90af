"""Compressed sizes of images, their calibration by random images, and compressibility by decimation.

A size is the number of phrases of a dictionary parse or the bytes of DEFLATE, of an image by rows or along a Hilbert curve. Images are rows
(comp_id, bin, x, y, color); a kernel gets one packed image at a time, many in an Arrow batch.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IMAGE = ["comp_id", "bin"]
#: Fill of cells that an image lacks: inside its box, and where a Hilbert curve needs a square.
NO_PIXEL, PADDING = 255, 0


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in their order, by doubling of prefixes: n log n comparisons of whole numbers in each of at most log n rounds."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = fresh
        step *= 2
        if n == 0 or fresh[-1] == n - 1 or step >= n:
            return order


def _common(s: bytes, early: int, late: int) -> int:
    """How far the stretches at two places agree."""
    done, step, n = 0, 16, len(s) - late
    while done < n:
        m = min(step, n - done)
        if s[early + done : early + done + m] == s[late + done : late + done + m]:
            done, step = done + m, 2 * step
        elif m == 1:
            break
        else:  # the difference is in here: halve
            step = m // 2
            n = done + m - 1 if m > 1 else n
    return done


def lz77_lengths(symbols: bytes) -> list[int]:
    """Lengths of the factors of the parse in which each is the longest stretch that also begins earlier (it may reach into itself), or one new symbol.

    The longest earlier stretch is next to a place in the suffix array: at the nearest suffix on either side that begins earlier. So each
    factor looks at two places, and all factors together at twice the text.
    """
    order = suffix_array(np.frombuffer(symbols, np.uint8)).tolist()
    left, right, held = [-1] * len(order), [-1] * len(order), []
    for place in order:
        while held and held[-1] > place:
            right[held.pop()] = place
        left[place] = held[-1] if held else -1
        held.append(place)
    lengths, at = [], 0
    while at < len(symbols):
        found = max(_common(symbols, left[at], at) if left[at] >= 0 else 0, _common(symbols, right[at], at) if right[at] >= 0 else 0)
        lengths.append(max(1, found))
        at += lengths[-1]
    return lengths


def lz77_factors(symbols: bytes) -> int:
    return len(lz77_lengths(symbols))


def lz77_bits(symbols: bytes) -> float:
    """Sum over factors of the bits that name the place it repeats and its length."""
    lengths = np.array(lz77_lengths(symbols), float)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    return float(np.log2(np.maximum(begins, 1)).sum() + np.log2(lengths).sum())


def lz78_phrases(symbols: bytes) -> int:
    """Phrases of the incremental parse: each is the longest known one plus a symbol."""
    ids: dict[tuple[int, int], int] = {}
    node, count = 0, 0
    for symbol in symbols:
        key = (node, symbol)
        if key in ids:
            node = ids[key]
        else:
            count += 1
            ids[key] = count
            node = 0
    return count + (node != 0)


def hilbert_order(width: int, height: int) -> np.ndarray:
    """Places of a width x height image's cells (row by row) in the order of a Hilbert curve over the next power of two."""
    side = 1
    while side < max(width, height):
        side *= 2
    y, x = np.divmod(np.arange(width * height), width)
    d, s = np.zeros(len(x), np.int64), side // 2
    while s:
        rx, ry = ((x & s) > 0).astype(np.int64), ((y & s) > 0).astype(np.int64)
        d += s * s * ((3 * rx) ^ ry)
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, side - 1 - x, x), np.where(flip, side - 1 - y, y)
        x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
        s //= 2
    return np.argsort(d, kind="stable")


def flat(image: np.ndarray, flattening: str) -> bytes:
    """An image's symbols by `rows`, or along a `hilbert` curve over the next square of a power of two, padded with colour 0."""
    if flattening == "rows":
        return image.tobytes()
    side = 1 << max(0, int(max(image.shape) - 1)).bit_length()
    square = np.full((side, side), PADDING, np.uint8)
    square[: image.shape[0], : image.shape[1]] = image
    return square.ravel()[hilbert_order(side, side)].tobytes()


def compressed_size(image: np.ndarray, flattening: str = "rows", compression: str = "lz77") -> int:
    """Factors (`lz77`), phrases (`lz78`) or bytes (`deflate`) of an image."""
    symbols = flat(image, flattening)
    if compression == "deflate":
        return len(zlib.compress(symbols))
    return (lz77_factors if compression == "lz77" else lz78_phrases)(symbols)


def packed(x: np.ndarray, y: np.ndarray, color: np.ndarray) -> np.ndarray:
    image = np.full((y.max() - y.min() + 1, x.max() - x.min() + 1), NO_PIXEL, np.uint8)
    image[y - y.min(), x - x.min()] = color
    return image


def _arrays(pixels: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """One row for each image: its pixels by rows as three arrays."""
    held = pixels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x", "color"))).alias("cells"), *more)
    part = lambda c: F.transform("cells", lambda cell: cell[c])
    return held.withColumns({c: part(c) for c in ("x", "y", "color")}).drop("cells")


def image_entropies(images: DataFrame, flattening: str = "rows", compression: str = "lz77") -> DataFrame:
    """`(comp_id, bin, area, size, entropy)`: compressed size, and that over the number of pixels."""

    @F.pandas_udf("int")
    def size(x: pd.Series, y: pd.Series, color: pd.Series) -> pd.Series:
        return pd.Series([compressed_size(packed(np.asarray(a), np.asarray(b), np.asarray(c)), flattening, compression) for a, b, c in zip(x, y, color, strict=True)])

    sized = _arrays(images, IMAGE).select(*IMAGE, F.size("x").alias("area"), size("x", "y", "color").alias("size"))
    return sized.withColumn("entropy", F.col("size") / F.col("area"))


def needed_squares(images: DataFrame) -> DataFrame:
    """`(side, palette)` of the squares on either side of each image's area; images: area, palette."""
    root = F.floor(F.sqrt(F.col("area").cast("double")))
    return images.select("palette", F.explode(F.array(root, root + 1)).alias("side")).where("side > 0").distinct()


def entropy_bounds(squares: DataFrame, trials: int = 10, flattening: str = "rows", compression: str = "lz77") -> DataFrame:
    """`(palette, area, entropy_min, entropy_max)` of each square (side, palette).

    The least entropy is one symbol for the whole image, 1 / area. The greatest is the mean over `trials` images of independent uniform colours, whose
    draws depend on side, palette and trial only. A trial is a row of its own, so that the large squares' trials run side by side.
    """

    @F.pandas_udf("double")
    def entropy(side: pd.Series, palette: pd.Series, trial: pd.Series) -> pd.Series:
        out = []
        for n, k, t in zip(side, palette, trial, strict=True):
            image = np.random.default_rng([int(n), int(k), int(t)]).integers(0, k, (n, n), dtype=np.uint8)
            out.append(compressed_size(image, flattening, compression) / (n * n))
        return pd.Series(out)

    drawn = squares.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).repartition("side", "palette", "trial")
    found = drawn.groupBy("palette", (F.col("side") * F.col("side")).cast("long").alias("area")).agg(F.avg(entropy("side", "palette", "trial")).alias("entropy_max"))
    return found.select("palette", "area", (1 / F.col("area")).alias("entropy_min"), "entropy_max")


def between(asked: DataFrame, bounds: DataFrame) -> DataFrame:
    """Distinct `(palette, area)` of `asked` with both bounds, on straight lines between the nearest smaller and larger calibrated areas; null beyond the calibrated ones.

    A two-sided as-of join over distinct areas: calibrated and asked areas in one order, the last calibrated one before and the first after by windows.
    """
    wanted = asked.select("palette", F.col("area").cast("long").alias("area")).distinct()
    known = F.when(F.col("entropy_max").isNotNull(), F.struct("area", "entropy_min", "entropy_max"))
    both = bounds.select("palette", "area", "entropy_min", "entropy_max", F.lit(False).alias("asked")).unionByName(wanted.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("palette").orderBy("area")
    low = F.last(known, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    high = F.first(known, ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    met = both.withColumn("low", low).withColumn("high", high).where("asked")
    share = F.when(F.col("high.area") > F.col("low.area"), (F.col("area") - F.col("low.area")) / (F.col("high.area") - F.col("low.area"))).otherwise(F.lit(0.0))
    line = lambda c: (F.col(f"low.{c}") + share * (F.col(f"high.{c}") - F.col(f"low.{c}"))).alias(c)
    return met.select("palette", "area", line("entropy_min"), line("entropy_max"))


def normalized_entropies(entropies: DataFrame, bounds: DataFrame) -> DataFrame:
    """`entropies` (palette, area, entropy) with `normalized`: 0 at the least and 1 at the greatest entropy of its area and palette; null where those are equal or unknown."""
    met = entropies.join(between(entropies, bounds), ["palette", "area"], "left")
    spread = F.col("entropy_max") - F.col("entropy_min")
    return met.withColumn("normalized", F.when(spread > 0, (F.col("entropy") - F.col("entropy_min")) / spread))


def decimations(images: DataFrame) -> DataFrame:
    """Every image's decimations `(comp_id, bin, delta, start, x, y, color)`: of both axes each `delta`-th cell from `start` < `delta` on, `delta` up to half the rows.

    A pixel is in a decimation by `delta` only if both its coordinates leave the same remainder, and then in one, so the table has about the logarithm
    of the height times the pixels, not the sum of all deltas.
    """
    box = Window.partitionBy(*IMAGE)
    corner = images.withColumns({"x": F.col("x") - F.min("x").over(box), "y": F.col("y") - F.min("y").over(box)})
    corner = corner.withColumn("most", F.floor((F.max("y").over(box) + 1) / 2).cast("int")).where("most > 0")
    deltas = F.filter(F.sequence(F.lit(1), F.col("most")), lambda d: (F.col("x") - F.col("y")) % d == 0)
    spread = corner.withColumn("delta", F.explode(deltas)).withColumn("start", F.col("x") % F.col("delta"))
    at = lambda c: F.floor(F.col(c) / F.col("delta")).cast("int").alias(c)
    return spread.select(*IMAGE, "delta", "start", at("x"), at("y"), "color")


def compressibility(images: DataFrame, flattening: str = "hilbert", compression: str = "lz77") -> DataFrame:
    """`(comp_id, bin, delta, q)`: 1 - mean size of the decimations / mean size of the same pixels shuffled. Near 0 for noise, higher for order at that distance.

    Shuffles go by hashes of the pixels' places, so they don't depend on partitioning.
    """
    keys = [*IMAGE, "delta", "start"]
    parts = decimations(images)
    shuffled = F.array_sort(F.collect_list(F.struct(F.xxhash64(*keys, "x", "y", F.lit("shuffle")).alias("h"), "y", "x", "color"))).alias("shuffled")
    held = _arrays(parts, keys, shuffled).withColumn("shuffled", F.transform("shuffled", lambda s: s["color"]))

    @F.pandas_udf("own int, mixed int")
    def sizes(x: pd.Series, y: pd.Series, color: pd.Series, mixed: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, d in zip(x, y, color, mixed, strict=True):
            a, b = np.asarray(a), np.asarray(b)
            out.append([compressed_size(packed(a, b, np.asarray(v)), flattening, compression) for v in (c, d)])
        return pd.DataFrame(out, columns=["own", "mixed"])

    sized = held.select(*keys, sizes("x", "y", "color", "shuffled").alias("s"))
    return sized.groupBy(*IMAGE, "delta").agg((1 - F.avg("s.own") / F.avg("s.mixed")).alias("q"))


def entropy_rates(symbols: bytes, random: bytes) -> tuple[float, float, float, float]:
    """Entropy rates by LZ77 factors, the bits of LZ77 factors, LZ78 phrases and DEFLATE, each over that of a random binary sequence of the same length."""
    n = len(symbols)
    lz77 = lambda c: (c * np.log2(c) + 2 * c * np.log2(n / c)) / n
    lz78 = lambda c, alphabet: c * (np.log2(alphabet) + np.log2(c)) / n
    pairs = [
        (lz77(lz77_factors(symbols)), lz77(lz77_factors(random))),
        (lz77_bits(symbols), lz77_bits(random)),
        (lz78(lz78_phrases(symbols), len(set(symbols))), lz78(lz78_phrases(random), len(set(symbols)))),
        (len(zlib.compress(symbols, 9)), len(zlib.compress(random, 9))),
    ]
    return tuple(float(a / b) if b else 0.0 for a, b in pairs)


def image_entropy_rates(images: DataFrame) -> DataFrame:
    """The entropy rates of each image along a Hilbert curve (`rate_...`) and by rows (`rows_...`). The random sequence depends on the length only."""
    kinds = ["lz77", "lz77_bits", "lz78", "deflate"]
    columns = ["n_lz77", *(f"{order}_{k}" for order in ("rate", "rows") for k in kinds)]

    @F.pandas_udf("n_lz77 int, " + ", ".join(f"{c} double" for c in columns[1:]))
    def rates(x: pd.Series, y: pd.Series, color: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c in zip(x, y, color, strict=True):
            image = packed(np.asarray(a), np.asarray(b), np.asarray(c))
            curve, row = image.ravel()[hilbert_order(image.shape[1], image.shape[0])].tobytes(), image.tobytes()
            coin = np.random.default_rng(len(curve)).integers(0, 2, len(curve), dtype=np.uint8).tobytes()
            out.append([lz77_factors(curve), *entropy_rates(curve, coin), *entropy_rates(row, coin)])
        return pd.DataFrame(out, columns=columns)

    return _arrays(images, IMAGE).select(*IMAGE, rates("x", "y", "color").alias("r")).select(*IMAGE, "r.*")


def haar_levels(shape: tuple[int, int], mid: float = 0.1, large: float = 0.4) -> tuple[int, int, int] | None:
    """Levels of high, mid and low frequency of an image, counted from 0, or none if it is too small.

    High is level 1. The others are those, from 1 to the highest that the shorter side allows, whose centre 1.5 * 2^level is nearest to their share
    of the shorter side; one that coincides with another moves up by one where there is room.
    """
    most = int(min(shape)).bit_length() - 1
    if most < 1:
        return None
    nearest = lambda target: min(range(1, most + 1), key=lambda level: abs(1.5 * 2**level - target))
    at_mid, at_low = nearest(mid * min(shape)), nearest(large * min(shape))
    if most > 1:
        if at_mid == 1:
            at_mid = 2
        if at_low in (1, at_mid):
            at_low = min(at_low + 1, most)
    return 1, at_mid, at_low


def haar_energies(image: np.ndarray) -> tuple[float, float, float]:
    """Sums of squared details of a 2-D Haar transform at the levels of high, mid and low frequency; odd edges are repeated; zeros if the image is too small.

    Levels count from 0, so level 1 is the second step of the transform, as in the surveyed work.
    """
    levels = haar_levels(image.shape)
    if levels is None:
        return 0.0, 0.0, 0.0
    sums, a = [], image.astype(float)
    for _ in range(max(levels) + 1):
        a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), mode="edge")
        p, q, r, s = a[::2, ::2], a[::2, 1::2], a[1::2, ::2], a[1::2, 1::2]
        sums.append(float(((p - q + r - s) ** 2 + (p + q - r - s) ** 2 + (p - q - r + s) ** 2).sum() / 4))
        a = (p + q + r + s) / 2
    return tuple(sums[level] for level in levels)


def image_kernels(images: DataFrame) -> DataFrame:
    """Sizes by rows and along a Hilbert curve (DEFLATE bytes, LZ77 factors, LZ78 phrases) and Haar energies of each image."""
    columns = ["n_raw", "n_deflate", "n_deflate_hilbert", "n_lz77", "n_lz77_hilbert", "n_lz78", "n_lz78_hilbert", "haar_high", "haar_mid", "haar_low"]

    @F.pandas_udf(", ".join(f"{c} {'double' if c.startswith('haar') else 'int'}" for c in columns))
    def kernel(x: pd.Series, y: pd.Series, color: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c in zip(x, y, color, strict=True):
            image = packed(np.asarray(a), np.asarray(b), np.asarray(c))
            sizes = [compressed_size(image, order, kind) for kind in ("deflate", "lz77", "lz78") for order in ("rows", "hilbert")]
            out.append([image.size, *sizes, *haar_energies(image)])
        return pd.DataFrame(out, columns=columns)

    return _arrays(images, IMAGE).select(*IMAGE, kernel("x", "y", "color").alias("k")).select(*IMAGE, "k.*")
