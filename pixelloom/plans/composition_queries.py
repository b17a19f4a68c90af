"""Registered queries on compositions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.config import DAY, TEST_CANVAS
from pixelloom.operators import changes, compositions, users
from pixelloom.plans.canvas_queries import rounded
from pixelloom.sources import adapter, atlas
from pixelloom.sources.adapter import SQL_PIXELS, SQL_SECTIONS


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.rectangle_pixels(adapter.borders(spark, sf_dir))


def split_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels with their range in two halves; in odd columns a day is missing between them."""
    p = pixels(spark, sf_dir)
    mid = (F.col("t0") + F.col("t1")) / 2
    second = p.withColumn("t0", F.when(F.col("x") % 2 == 1, mid + DAY).otherwise(mid))
    return p.withColumn("t1", mid).unionByName(second)


def moving_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders in two halves of their time; of three compositions one moves by a pixel in between, and one is gone for a day."""
    b = adapter.borders(spark, sf_dir)
    mid, n = (F.col("t0") + F.col("t1")) / 2, F.substring("comp_id", 2, 9).cast("int")
    step, hole = F.when(n % 3 == 0, 1).otherwise(0), F.when(n % 3 == 1, DAY).otherwise(0.0)
    later = b.withColumns({"t0": mid + hole, "x0": F.col("x0") + step, "x1": F.col("x1") + step, "seq": F.lit(1)})
    return b.withColumns({"t1": mid, "seq": F.lit(0)}).unionByName(later)


def stable_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = moving_borders(spark, sf_dir)
    return compositions.stable_border_ranges(b, changes.rectangle_pixels(b.withColumn("comp_id", F.struct("comp_id", "seq"))).select("comp_id.comp_id", "comp_id.seq", "x", "y"))


def jumping_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of two halves; of three compositions one moves by four columns in between, one by a column, and one stays but in odd columns misses a day."""
    b = adapter.borders(spark, sf_dir)
    mid, n = (F.col("t0") + F.col("t1")) / 2, F.substring("comp_id", 2, 9).cast("int")
    step = F.when(n % 3 == 0, 4).when(n % 3 == 1, 1).otherwise(0)
    first = changes.rectangle_pixels(b.withColumn("t1", mid))
    second = changes.rectangle_pixels(b.withColumns({"t0": mid, "x0": F.col("x0") + step, "x1": F.col("x1") + step}))
    return first.unionByName(second.withColumn("t0", F.when((n % 3 == 2) & (F.col("x") % 2 == 1), F.col("t0") + DAY).otherwise(F.col("t0"))))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`nation` as entries of an atlas: two borders, one with a list of ranges; the first entry has a tag only."""
    b = adapter.borders(spark, sf_dir)
    point = lambda x, y: F.array(F.col(x), F.col(y))
    box = F.array(point("x0", "y0"), point("x0", "y1"), point("x1", "y1"), point("x1", "y0"))
    n = F.substring("comp_id", 2, 9).cast("int")
    keys = F.when(n == 0, F.array(F.lit("T:0-1"))).otherwise(F.array(F.concat((n + 1).cast("string"), F.lit("-"), (n + 4).cast("string")), F.concat((n + 6).cast("string"), F.lit(", T, "), (n + 9).cast("string"))))
    paths = F.when(n == 0, F.array(box)).otherwise(F.array(box, box))
    name = F.when(n % 3 == 0, "Flag of ").otherwise("Twitch streamer ")
    links = F.when(n % 2 == 0, F.create_map(F.lit("subreddit"), F.array("comp_id")))
    return b.select(F.col("comp_id").alias("id"), F.concat(name, "comp_id").alias("name"), F.lit("an alliance").alias("description"), links.alias("links"), F.map_from_arrays(keys, paths).alias("path"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders as four points, tenfold, some a little off."""
    b = adapter.borders(spark, sf_dir)
    off = F.substring("comp_id", 2, 9).cast("int") % 4
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    c = {k: F.col(k) * 10 for k in ("x0", "y0", "x1", "y1")}
    return b.select("comp_id", F.array(point(c["x0"] + off, c["y0"]), point(c["x0"], c["y1"]), point(c["x1"], c["y1"]), point(c["x1"], c["y0"] + off)).alias("path"))


def _of(make):
    return lambda spark, sf_dir: make(pixels(spark, sf_dir))


def _with_sections(make):
    return lambda spark, sf_dir: make(pixels(spark, sf_dir), adapter.sections(spark))


def _halves(make):
    return lambda spark, sf_dir: make(split_pixels(spark, sf_dir))


QUERIES = {
    "c1_borders": lambda s, d: atlas.borders_of(nested(s, d), 1800.0, 30 * DAY).select("comp_id", "seq", "t0", "t1"),
    "c2_extended_ranges": lambda s, d: compositions.extend_ranges(adapter.borders(s, d), DAY / 2, DAY / 6, 30 * DAY).select("comp_id", "t0", "t1"),
    "c4_overlaps": _of(lambda p: rounded(compositions.overlaps(p), "overlap")),
    "c5_snapped_rectangles": lambda s, d: compositions.snap_rectangles(boxes(s, d)).select("comp_id", "is_rectangle", F.get("path", F.lit(0))["x"].alias("x"), F.get("path", F.lit(0))["y"].alias("y")),
    "c6_clamped_boxes": lambda s, d: compositions.clamp(boxes(s, d), TEST_CANVAS.sections).drop("path"),
    "c7_polygon_pixels": lambda s, d: compositions.polygon_pixels(boxes(s, d).withColumns({"t0": F.lit(0.0), "t1": F.lit(DAY)})),
    "c8_merged_ranges": _halves(compositions.merge_ranges),
    "c9_cut_to_open": _with_sections(lambda p, s: compositions.cut_to_open(compositions.section_of_pixels(p, s)).select("comp_id", "x", "y", "t0", "t1")),
    "c10_sections": _with_sections(lambda p, s: compositions.section_of_pixels(p, s).groupBy("comp_id").agg(F.min("section").alias("section"), F.min("t_open").alias("t_open"))),
    "c11_lives": _of(lambda p: compositions.life(p, TEST_CANVAS.whiteout)),
    "c12_stable_border_ranges": lambda s, d: stable_ranges(s, d),
    "c13_location_jumps": lambda s, d: compositions.location_jumps(jumping_pixels(s, d)),
    "c14_active_area": _halves(lambda p: compositions.active_area(p, TEST_CANVAS.bin_width)),
    "c15_duplicates": _of(lambda p: compositions.duplicates(p.unionByName(p.where("comp_id < 'c15'").withColumn("comp_id", F.concat("comp_id", F.lit("_copy")))))),
    "c16_rejected_overlaps": _of(lambda p: compositions.rejected_overlaps(p, 0.3)),
    "c16_rejected_overlaps_of_borders": lambda s, d: compositions.rejected_overlaps(jumping_pixels(s, d), 0.3),
    "c17_placement": _with_sections(lambda p, s: compositions.placement(p, s, 1)),
    "c18_pixel_owners": _of(compositions.pixel_owners),
    "c19_size_distribution": _of(compositions.size_distribution),
    "c20_community_flags": lambda s, d: users.community_flags(nested(s, d)),
}

HALVES = f"""{SQL_PIXELS}, halves AS (SELECT comp_id, x, y, t0, (t0 + t1) / 2 AS t1 FROM pixels UNION ALL SELECT comp_id, x, y, (t0 + t1) / 2 + CASE WHEN x % 2 = 1 THEN 86400 ELSE 0 END, t1 FROM pixels)"""
OVER = """areas AS (SELECT comp_id, count(DISTINCT (x, y)) AS area FROM p GROUP BY 1), common AS (SELECT a.comp_id, b.comp_id AS other_id, count(*) AS n FROM p a JOIN p b ON a.x = b.x AND a.y = b.y AND a.comp_id < b.comp_id GROUP BY 1, 2),
    over_ AS (SELECT c.comp_id, other_id, n AS n_common, least(n / a.area, n / b.area) AS overlap FROM common c JOIN areas a ON a.comp_id = c.comp_id JOIN areas b ON b.comp_id = other_id)"""
N = "CAST(comp_id[2:] AS INT)"
STABLE = f"""moving AS (SELECT comp_id, 0 AS seq, x0, x1, y0, y1, t0, (t0 + t1) / 2 AS t1 FROM borders
        UNION ALL SELECT comp_id, 1, x0 + step, x1 + step, y0, y1, (t0 + t1) / 2 + hole, t1 FROM (SELECT *, CASE WHEN {N} % 3 = 0 THEN 1 ELSE 0 END AS step, CASE WHEN {N} % 3 = 1 THEN 86400 ELSE 0 END AS hole FROM borders)),
    stepped AS (SELECT m.*, CASE WHEN o.comp_id IS NOT NULL AND abs(m.t0 - o.t1) <= 1e-8 + 1e-5 * o.t1
        AND greatest(least(m.x1, o.x1) - greatest(m.x0, o.x0) + 1, 0) * greatest(least(m.y1, o.y1) - greatest(m.y0, o.y0) + 1, 0) / greatest((m.x1 - m.x0 + 1) * (m.y1 - m.y0 + 1), (o.x1 - o.x0 + 1) * (o.y1 - o.y0 + 1)) > 0.9 THEN 0 ELSE 1 END AS fresh
        FROM moving m LEFT JOIN moving o ON o.comp_id = m.comp_id AND o.seq = m.seq - 1),
    settled AS (SELECT comp_id, piece, min(t0) AS t0, max(t1) AS t1 FROM (SELECT *, sum(fresh) OVER (PARTITION BY comp_id ORDER BY seq) - 1 AS piece FROM stepped) GROUP BY 1, 2)"""
JUMPING = f"""{SQL_PIXELS}, jumping AS (SELECT comp_id, x, y, t0, (t0 + t1) / 2 AS t1 FROM pixels
    UNION ALL SELECT comp_id, x + CASE {N} % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 0 END, y, (t0 + t1) / 2 + CASE WHEN {N} % 3 = 2 AND x % 2 = 1 THEN 86400 ELSE 0 END, t1 FROM pixels)"""


def _islands(source: str, keys: str) -> str:
    """Ranges of `source` by `keys`, those that touch as one, as a sorted list."""
    return f"""(SELECT {keys}, list((t0, t1) ORDER BY t0) AS ranges FROM (SELECT {keys}, min(t0) AS t0, max(t1) AS t1 FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY t0, t1) AS g
        FROM (SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY {keys} ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source})) GROUP BY {keys}, g) GROUP BY {keys})"""


def _rejects(source: str, least: float) -> str:
    """Rejected times by borders: the pixels of a composition with one time range."""
    return f"""pairs_ AS (SELECT a.comp_id, b.comp_id AS other_id, a.t0, a.t1, b.t0 AS o0, b.t1 AS o1, count(*) AS n FROM {source} a JOIN {source} b ON a.x = b.x AND a.y = b.y AND a.comp_id < b.comp_id AND greatest(a.t0, b.t0) < least(a.t1, b.t1) GROUP BY ALL),
        sizes AS (SELECT comp_id, t0, t1, count(*) AS area FROM {source} GROUP BY ALL),
        rejects AS (SELECT DISTINCT CASE WHEN p.t0 < o0 OR (p.t0 = o0 AND p.t1 >= o1) THEN other_id ELSE p.comp_id END AS comp_id, greatest(p.t0, o0) AS t0, least(p.t1, o1) AS t1
            FROM pairs_ p JOIN sizes a ON a.comp_id = p.comp_id AND a.t0 = p.t0 AND a.t1 = p.t1 JOIN sizes b ON b.comp_id = other_id AND b.t0 = o0 AND b.t1 = o1 WHERE least(n / a.area, n / b.area) > {least})"""


ORACLES = {
    "c1_borders": f"""WITH {SQL_PIXELS}, n AS (SELECT comp_id, {N} AS n FROM borders), r AS (SELECT comp_id, 0e0 AS t0, 2592000e0 AS t1 FROM n WHERE n = 0
            UNION ALL SELECT comp_id, n * 1800e0, (n + 4) * 1800e0 FROM n WHERE n > 0 UNION ALL SELECT comp_id, (n + 5) * 1800e0, (n + 6) * 1800e0 FROM n WHERE n > 0 UNION ALL SELECT comp_id, (n + 8) * 1800e0, (n + 9) * 1800e0 FROM n WHERE n > 0)
        SELECT comp_id, row_number() OVER (PARTITION BY comp_id ORDER BY t0) - 1 AS seq, t0, t1 FROM r""",
    "c2_extended_ranges": f"WITH {SQL_PIXELS} SELECT comp_id, greatest(t0 - 43200, 0) AS t0, least(t1 + 14400, 2592000) AS t1 FROM borders",
    "c4_overlaps": f"WITH {SQL_PIXELS}, p AS (SELECT DISTINCT comp_id, x, y FROM pixels), {OVER} SELECT comp_id, other_id, n_common, round(overlap, 6) AS overlap FROM over_",
    "c5_snapped_rectangles": f"""WITH {SQL_PIXELS}, o AS (SELECT *, {N} % 4 AS off_ FROM borders) SELECT comp_id, off_ <= 2 AND (x1 - x0) * 10 > 10 AND (y1 - y0) * 10 > 10 AS is_rectangle,
        CASE WHEN off_ <= 2 AND (x1 - x0) * 10 > 10 AND (y1 - y0) * 10 > 10 THEN x0 * 10 ELSE x0 * 10 + off_ END AS x, y0 * 10 AS y FROM o""",
    "c6_clamped_boxes": f"""WITH {SQL_PIXELS}, b AS (SELECT comp_id, least(x0 * 10, 9) AS xmin, greatest(least(x1 * 10, 9), least(x0 * 10 + {N} % 4, 9)) AS xmax, least(y0 * 10, 9) AS ymin, greatest(least(y1 * 10, 9), least(y0 * 10 + {N} % 4, 9)) AS ymax FROM borders)
        SELECT *, xmax - xmin + 1 AS width, ymax - ymin + 1 AS height FROM b""",
    "c8_merged_ranges": f"WITH {HALVES} SELECT comp_id, x, y, t0, t1 FROM halves WHERE x % 2 = 1 UNION ALL SELECT comp_id, x, y, min(t0), max(t1) FROM halves WHERE x % 2 = 0 GROUP BY 1, 2, 3",
    "c9_cut_to_open": f"WITH {SQL_PIXELS} SELECT comp_id, x, y, greatest(t0, CASE WHEN x <= 4 THEN 0 ELSE 432000 END) AS t0, t1 FROM pixels",
    "c10_sections": f"WITH {SQL_PIXELS} SELECT comp_id, min(CASE WHEN x <= 4 THEN 0 ELSE 1 END) AS section, min(CASE WHEN x <= 4 THEN 0e0 ELSE 432000 END) AS t_open FROM pixels GROUP BY 1",
    "c11_lives": f"WITH {SQL_PIXELS} SELECT comp_id, min(t0) AS tmin, least(max(t1), 2505600) AS tmax, count(DISTINCT (x, y)) AS area FROM pixels GROUP BY 1",
    "c12_stable_border_ranges": f"WITH {SQL_PIXELS}, {STABLE} SELECT * FROM settled",
    "c13_location_jumps": f"""WITH {JUMPING}, whole AS {_islands('(SELECT DISTINCT comp_id, t0, t1 FROM jumping)', 'comp_id')}, each_ AS {_islands('jumping', 'comp_id, x, y')}
        SELECT e.comp_id, NOT bool_or(e.ranges = w.ranges) AS jumps FROM each_ e JOIN whole w ON w.comp_id = e.comp_id GROUP BY 1""",
    "c14_active_area": f"""WITH {HALVES}, b AS (SELECT comp_id, t0 AS a, unnest(range(1, CAST(ceil((t1 - t0) / 21600) AS INT) + 1)) AS bin FROM borders)
        SELECT b.comp_id, bin, count(DISTINCT (x, y)) AS active_area FROM b JOIN halves h ON h.comp_id = b.comp_id AND h.t0 < a + bin * 21600 AND h.t1 > a + (bin - 1) * 21600 GROUP BY 1, 2""",
    "c15_duplicates": "SELECT 'c' || n_nationkey || '_copy' AS comp_id, 'c' || n_nationkey AS same_as FROM nation WHERE 'c' || n_nationkey < 'c15'",
    "c16_rejected_overlaps": f"WITH {SQL_PIXELS}, {_rejects('pixels', 0.3)} SELECT * FROM rejects",
    "c16_rejected_overlaps_of_borders": f"WITH {JUMPING}, {_rejects('jumping', 0.3)} SELECT * FROM rejects",
    "c17_placement": f"""WITH {SQL_PIXELS}, {SQL_SECTIONS}, f AS (SELECT comp_id, section, (x0 < xmin + 1 OR x1 > xmax - 1) AS sx, (y0 < ymin + 1 OR y1 > ymax - 1) AS sy,
            (x0 < (xmin + xmax) / 2 + 1 AND x1 > (xmin + xmax) / 2 - 1 AND y0 < (ymin + ymax) / 2 + 1 AND y1 > (ymin + ymax) / 2 - 1) AS in_centre FROM borders, sections)
        SELECT comp_id, section, sx OR sy AS at_border, sx AND sy AS in_corner, in_centre FROM f""",
    "c18_pixel_owners": f"""WITH {SQL_PIXELS}, areas AS (SELECT comp_id, count(*) AS area FROM pixels GROUP BY 1), e AS (SELECT DISTINCT x, y, t FROM (SELECT x, y, t0 AS t FROM pixels UNION ALL SELECT x, y, t1 FROM pixels)),
        s AS (SELECT x, y, t AS t_beg, lead(t) OVER (PARTITION BY x, y ORDER BY t) AS t_end FROM e), h AS (SELECT s.*, p.comp_id, row_number() OVER (PARTITION BY s.x, s.y, t_beg ORDER BY area, p.comp_id) AS layer
            FROM s JOIN pixels p ON p.x = s.x AND p.y = s.y AND p.t0 <= t_beg AND p.t1 >= t_end JOIN areas a ON a.comp_id = p.comp_id WHERE t_end IS NOT NULL) SELECT * FROM h WHERE layer <= 2""",
    "c19_size_distribution": f"WITH {SQL_PIXELS} SELECT CAST(floor(log10(area) * 5) AS INT) AS bin, count(*) AS n_comps FROM (SELECT comp_id, count(*) AS area FROM pixels GROUP BY 1) GROUP BY 1",
    "c20_community_flags": f"WITH {SQL_PIXELS} SELECT comp_id AS id, {N} % 3 <> 0 AS streamer, {N} % 3 = 0 AS flag, true AS alliance, {N} % 2 = 0 AS subreddit FROM borders",
}
