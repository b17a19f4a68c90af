"""Registered queries on compressed sizes, their calibration and compressibility at a distance. Parses and compressors have no SQL; tests hold them against slow ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.config import TEST_CANVAS
from pixelloom.functions.columns import palette_size
from pixelloom.operators import changes, entropy, state
from pixelloom.plans.canvas_queries import rounded
from pixelloom.plans.state_queries import WIDTH, State, opened
from pixelloom.plans.storage import write_shared
from pixelloom.sources import adapter


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shared(State(spark, sf_dir).instant().withColumnRenamed("inst", "color"), "images")


def whole_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image of the whole canvas at the end of each bin."""
    bounds = adapter.sections(spark).agg(*(F.min(c).alias(c) for c in ("xmin", "ymin")), *(F.max(c).alias(c) for c in ("xmax", "ymax")))
    box = bounds.select(F.lit("canvas").alias("comp_id"), F.col("xmin").alias("x0"), F.col("ymin").alias("y0"), F.col("xmax").alias("x1"), F.col("ymax").alias("y1"), F.lit(0.0).alias("t0"), F.lit(TEST_CANVAS.total).alias("t1"))
    stays = state.intervals(adapter.pixel_log(spark, sf_dir), changes.rectangle_pixels(box), TEST_CANVAS.white, opened(TEST_CANVAS))
    return write_shared(state.instant_images(stays, WIDTH).withColumnRenamed("inst", "color"), "canvas-images")


def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's entropy with the number of colours that could be set at its time."""
    begins = changes.rectangle_pixels(adapter.borders(spark, sf_dir)).groupBy("comp_id").agg(F.min("t0").alias("t0"))
    palette = palette_size(F.col("t0") + F.col("bin") * WIDTH, TEST_CANVAS.palette_steps).alias("palette")
    found = entropy.image_entropies(images(spark, sf_dir)).join(begins, "comp_id")
    return write_shared(found.select("comp_id", "bin", "area", "size", "entropy", palette), "entropies")


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.entropy_bounds(entropy.needed_squares(entropies(spark, sf_dir)))


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entropies(spark, sf_dir)
    bounds = write_shared(entropy.entropy_bounds(entropy.needed_squares(found)), "entropy-bounds")
    return rounded(entropy.normalized_entropies(found, bounds), "entropy", "entropy_min", "entropy_max", "normalized")


RATES = [f"{order}_{kind}" for order in ("rate", "rows") for kind in ("lz77", "lz77_bits", "lz78", "deflate")]

QUERIES = {
    "i1_i8_image_kernels": lambda s, d: entropy.image_kernels(images(s, d)),
    "i2_entropy_bounds": lambda s, d: rounded(_bounds(s, d), "entropy_min", "entropy_max"),
    "i3_normalized_entropies": _normalized,
    "i4_compressibility": lambda s, d: rounded(entropy.compressibility(whole_canvas(s, d)), "q"),
    "i14_entropy_rates": lambda s, d: rounded(entropy.image_entropy_rates(images(s, d)), *RATES),
}

ORACLES: dict[str, str] = {}
