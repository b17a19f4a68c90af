"""Registered queries on null models whose weights change with time, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import compositions
from pixelloom.operators.sliced import SlicedWeights
from pixelloom.plans import composition_queries
from pixelloom.plans.canvas_queries import rounded
from pixelloom.plans.more_queries import many
from pixelloom.sources import adapter
from pixelloom.sources.adapter import SQL_MANY_BORDERS, SQL_PIXELS, SQL_BORDERS

EXPONENT = 0.5


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of the test canvas's pixels, since their section opened."""
    pixels = compositions.section_of_pixels(composition_queries.pixels(spark, sf_dir), adapter.sections(spark))
    return compositions.pixel_owners(compositions.cut_to_open(pixels).select("comp_id", "x", "y", "t0", "t1"))


def _weights(how: str, source=owners):
    return lambda s, d: rounded(SlicedWeights(source(s, d), exponent=EXPONENT, how=how).pixel_weights(), "weight")


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SlicedWeights(owners(spark, sf_dir), exponent=EXPONENT).draw(adapter.pixel_log(spark, sf_dir))
    return found.withColumn("owners", F.array_join("owners", ","))


QUERIES = {
    "m2_slice_weights": _weights("max"),
    "m2_slice_weights_of_many": _weights("max", lambda s, d: compositions.pixel_owners(many(s, d))),
    "m2_sliced_null_model": _drawn,
    "m5_layered_mean_weights": _weights("mean"),
    "m5_layered_sum_weights": _weights("sum"),
}


def _sql(pixels: str, how: str) -> str:
    return f"""WITH {pixels}, areas AS (SELECT comp_id, count(DISTINCT (x, y)) AS area FROM cut_ GROUP BY 1), ends AS (SELECT DISTINCT t FROM (SELECT t0 AS t FROM cut_ UNION ALL SELECT t1 FROM cut_)),
        slices AS (SELECT * FROM (SELECT t AS t_beg, lead(t) OVER (ORDER BY t) AS t_end FROM ends) WHERE t_end IS NOT NULL),
        held AS (SELECT t_beg, t_end, x, y, c.comp_id, row_number() OVER (PARTITION BY t_beg, x, y ORDER BY area, c.comp_id) AS layer FROM slices JOIN cut_ c ON c.t0 <= t_beg AND c.t1 >= t_end JOIN areas a ON a.comp_id = c.comp_id),
        owned AS (SELECT *, sqrt(count(*) OVER (PARTITION BY t_beg, layer, comp_id)) AS w FROM held WHERE layer <= 2)
        SELECT t_beg, t_end, x, y, round({how}, 6) AS weight FROM owned GROUP BY 1, 2, 3, 4"""


OPEN = f"{SQL_PIXELS}, cut_ AS (SELECT comp_id, x, y, greatest(t0, CASE WHEN x <= 4 THEN 0 ELSE 432000 END) AS t0, t1 FROM pixels)"
MANY = f"{SQL_PIXELS.replace(SQL_BORDERS, SQL_MANY_BORDERS)}, cut_ AS (SELECT comp_id, x, y, t0, t1 FROM pixels)"

ORACLES = {
    "m2_slice_weights": _sql(OPEN, "max(w)"),
    "m2_slice_weights_of_many": _sql(MANY, "max(w)"),
    "m5_layered_mean_weights": _sql(OPEN, "sum(w) / count(*)"),
    "m5_layered_sum_weights": _sql(OPEN, "sum(w)"),
}
