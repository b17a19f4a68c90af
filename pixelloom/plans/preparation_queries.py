"""Registered queries on raw lines and the cleaning of the log, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.config import TEST_CANVAS
from pixelloom.functions.columns import original_stamp, palette_size, red_green_blue, safe_ratio
from pixelloom.operators import preparation
from pixelloom.plans.canvas_queries import rounded
from pixelloom.plans.storage import write_shared
from pixelloom.sources import adapter, raw_logs
from pixelloom.sources.adapter import SQL_LOG, SQL_SECTIONS

ORIGIN = "2024-01-01 00:00:00"
#: A colour for each number of the test canvas.
HEXES = ("#FF4500", "#00A368", "#2450A4", "#FFD635", "#FFFFFF")


def raw_lines(spark: SparkSession, sf_dir: str, color_last: bool = False) -> DataFrame:
    """`events` written as raw text lines: points, and moderators' rectangles or (colour last) circles."""
    log = adapter.pixel_log(spark, sf_dir)
    stamp = F.date_format(F.timestamp_micros(adapter.micros_of(F.col("seconds")) + adapter.ORIGIN_MICROS), "yyyy-MM-dd HH:mm:ss.SSS")
    hex_ = F.element_at(F.array(*map(F.lit, HEXES)), F.col("color") + 1)
    point = F.concat_ws(",", "x", "y")
    shape = F.format_string("{X: %d, Y: %d, R: 2}", "x", "y") if color_last else F.concat_ws(",", "x", "y", F.col("x") + 1, F.col("y") + 2)
    coords = F.concat(F.lit('"'), F.when(F.col("moderator"), shape).otherwise(point), F.lit('"'))
    parts = [coords, hex_] if color_last else [hex_, coords]
    line = F.concat_ws(",", F.concat(stamp, F.lit(" UTC")), F.concat(F.lit("u"), F.col("user"), F.lit("==")), *parts)
    return log.select("event_id", line.alias("line"))


def _events(spark: SparkSession, sf_dir: str, color_last: bool = False) -> DataFrame:
    return raw_logs.expand_shapes(raw_logs.parse_lines(raw_lines(spark, sf_dir, color_last), ORIGIN, color_last))


def _condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = write_shared(_events(spark, sf_dir), "events")  # parsed once for both dictionaries and the log
    return raw_logs.condense(events, raw_logs.dense_colors(events), raw_logs.dense_users(events))


def _to_millis(seconds: Column) -> Column:
    """Rounded to milliseconds as binary numbers are; `F.round` with digits rounds their shortest decimals, which differ at halves."""
    return F.round(seconds * 1000) / 1000


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = adapter.pixel_log(spark, sf_dir)
    again = log.where("event_id % 7 = 0").withColumns({"event_id": F.col("event_id") + 1_000_000_000, "seconds": F.col("seconds") + 1e-5})
    return log.unionByName(again).withColumn("seconds", _to_millis(F.col("seconds")))


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` in the oldest layout, with nulls, full duplicates and bad times."""
    log = adapter.pixel_log(spark, sf_dir)
    stamp = F.date_format(F.timestamp_micros(adapter.micros_of(F.col("seconds")) + adapter.ORIGIN_MICROS), "yyyy-MM-dd HH:mm:ss.SSS")
    ts = F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(F.concat(stamp, F.lit(" UTC")))
    color = F.when(F.col("event_id") % 13 != 0, F.col("color"))
    rows = log.select(ts.alias("ts"), F.concat(F.lit("h"), F.col("user")).alias("user_hash"), F.col("x").alias("x_coordinate"), F.col("y").alias("y_coordinate"), color.alias("color"))
    return rows.unionByName(rows.where(F.col("x_coordinate") == 3))


def _log(make):
    return lambda spark, sf_dir: make(adapter.pixel_log(spark, sf_dir))


QUERIES = {
    "s1_raw_lines": lambda s, d: _events(s, d).select("event_id", "seconds", "user_hash", "hex", "x", "y", "moderator"),
    "s2_raw_lines_color_last": lambda s, d: _events(s, d, True).select("event_id", "seconds", "user_hash", "hex", "x", "y", "moderator"),
    "s4_condensed_log": _condensed,
    "s5_before_whiteout": _log(lambda x: x.where(F.col("seconds") < TEST_CANVAS.whiteout)),
    "p1_p2_times": _log(lambda x: x.select("event_id", original_stamp(F.floor(adapter.micros_of(F.col("seconds")) / 1000) / 1000, ORIGIN).alias("stamp"))),
    "p5_dense_colors": lambda s, d: raw_logs.dense_colors(_events(s, d)),
    "p6_dense_users": lambda s, d: raw_logs.dense_users(_events(s, d)),
    "p8_sorted_log": _log(lambda x: preparation.sorted_log(x).select("event_id", "seconds")),
    "p9_deduplicated": lambda s, d: preparation.deduplicated(_repeated(s, d)),
    "p9_without_repeated": lambda s, d: preparation.deduplicated(_repeated(s, d), "none"),
    "p10_hidden_moderators": _log(preparation.with_hidden_moderators),
    "p11_old_log": lambda s, d: rounded(raw_logs.clean_old_log(_old(s, d), "2024-01-02 00:00:00", "2024-01-20 12:00:00"), "seconds", digits=3),
    "p12_open_canvas": lambda s, d: preparation.on_open_canvas(adapter.pixel_log(s, d), adapter.sections(s)),
    "p13_log_checks": lambda s, d: preparation.log_checks(_repeated(s, d)),
    "p13_user_changes": _log(lambda x: preparation.user_changes(x, 7)),
    "p14_colors": _log(lambda x: x.select("event_id", F.element_at(F.array(*map(F.lit, HEXES)), F.col("color") + 1).alias("hex")).withColumn("rgb", red_green_blue(F.col("hex"))).select("event_id", "hex", "rgb.r", "rgb.g", "rgb.b")),
    "p15_palette": _log(lambda x: x.select("event_id", palette_size(F.col("seconds"), TEST_CANVAS.palette_steps).alias("n_colors"))),
    "p16_safe_ratio": _log(lambda x: x.groupBy("user").agg(F.sum(F.col("moderator").cast("long")).alias("a"), F.sum((F.col("x") == 0).cast("long")).alias("b")).select(
        "user", F.round(safe_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))),
}

HEX = "['#FF4500', '#00A368', '#2450A4', '#FFD635', '#FFFFFF']"
RAW = f"""{SQL_LOG}, raw AS (SELECT event_id, floor(seconds * 1000 + 1e-4) / 1000 AS seconds, 'u' || "user" || '==' AS user_hash, {HEX}[color + 1] AS hex, x, y, moderator FROM log)"""
RECT = f"""{RAW}, events AS (SELECT event_id, seconds, user_hash, hex, x + dx AS x, y + dy AS y, moderator
    FROM raw, range(2) a(dx), range(3) b(dy) WHERE moderator OR (dx = 0 AND dy = 0))"""
REPEATED = f"""{SQL_LOG}, twice AS (SELECT event_id, round(seconds, 3) AS seconds, x, y, "user", color, moderator FROM log
    UNION ALL SELECT event_id + 1000000000, round(seconds + 1e-5, 3), x, y, "user", color, moderator FROM log WHERE event_id % 7 = 0)"""
MS = 'CAST(round(seconds * 1000) AS BIGINT), x, y, "user", color'

ORACLES = {
    "s1_raw_lines": f"WITH {RECT} SELECT * FROM events",
    "s2_raw_lines_color_last": f"""WITH {RAW} SELECT event_id, seconds, user_hash, hex, x + dx AS x, y + dy AS y, moderator FROM raw, range(-2, 3) a(dx), range(-2, 3) b(dy)
        WHERE CASE WHEN moderator THEN dx * dx + dy * dy < 3.999 ELSE dx = 0 AND dy = 0 END""",
    "s4_condensed_log": f"""WITH {RECT}, c AS (SELECT hex, row_number() OVER (ORDER BY min((seconds, event_id))) - 1 AS color FROM events GROUP BY hex),
        u AS (SELECT user_hash, row_number() OVER (ORDER BY min((seconds, event_id))) - 1 AS "user" FROM events GROUP BY user_hash)
        SELECT event_id, seconds, x, y, "user", color, moderator FROM events JOIN c USING (hex) JOIN u USING (user_hash)""",
    "s5_before_whiteout": f"WITH {SQL_LOG} SELECT * FROM log WHERE seconds < 2505600",
    "p1_p2_times": """SELECT event_id, regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%g'), '0+$', ''), '\\.$', '') || ' UTC' AS stamp FROM events""",
    "p5_dense_colors": f"WITH {RECT} SELECT hex, row_number() OVER (ORDER BY min((seconds, event_id))) - 1 AS color FROM events GROUP BY hex",
    "p6_dense_users": f"WITH {RECT} SELECT user_hash, row_number() OVER (ORDER BY min((seconds, event_id))) - 1 AS \"user\" FROM events GROUP BY user_hash",
    "p8_sorted_log": f"WITH {SQL_LOG} SELECT event_id, seconds FROM log ORDER BY seconds, event_id",
    "p9_deduplicated": f"WITH {REPEATED} SELECT * FROM twice WHERE moderator UNION ALL SELECT * FROM twice WHERE NOT moderator QUALIFY row_number() OVER (PARTITION BY {MS} ORDER BY event_id) = 1",
    "p9_without_repeated": f"WITH {REPEATED} SELECT * FROM twice WHERE moderator UNION ALL SELECT * FROM twice WHERE NOT moderator QUALIFY count(*) OVER (PARTITION BY {MS}) = 1",
    "p10_hidden_moderators": f"""WITH {SQL_LOG} SELECT *, "user" IN (SELECT "user" FROM log WHERE moderator) AS hidden_moderator FROM log""",
    "p11_old_log": """WITH e AS (SELECT DISTINCT date_trunc('millisecond', ts) AS stamp, 'h' || user_id AS user_hash, CAST(json_extract_string(props, '$.k') AS INT) AS k,
            CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS color FROM events
            WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND ts >= TIMESTAMP '2024-01-02' AND date_trunc('millisecond', ts) <= TIMESTAMP '2024-01-20 12:00:00')
        SELECT round((epoch_us(stamp) - min(epoch_us(stamp)) OVER ()) / 1e6, 3) AS seconds, user_hash, k % 10 AS x, k // 10 AS y, color FROM e""",
    "p12_open_canvas": f"WITH {SQL_LOG}, {SQL_SECTIONS} SELECT * FROM log l WHERE EXISTS (SELECT 1 FROM sections s WHERE l.seconds >= s.t_open AND l.x BETWEEN s.xmin AND s.xmax AND l.y BETWEEN s.ymin AND s.ymax)",
    "p13_log_checks": f"""WITH {REPEATED} SELECT (SELECT count(DISTINCT event_id) FROM twice WHERE moderator) AS n_moderator_events, (SELECT count(*) FROM twice) AS n_changes,
        (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM twice WHERE NOT moderator GROUP BY {MS})) AS n_repeats""",
    "p13_user_changes": f"""WITH {SQL_LOG} SELECT * FROM log WHERE "user" = 7 ORDER BY seconds, event_id""",
    "p14_colors": f"""WITH {SQL_LOG} SELECT event_id, hex, CAST('0x' || hex[2:3] AS INT) AS r, CAST('0x' || hex[4:5] AS INT) AS g, CAST('0x' || hex[6:7] AS INT) AS b FROM (SELECT event_id, {HEX}[color + 1] AS hex FROM log)""",
    "p15_palette": f"WITH {SQL_LOG} SELECT event_id, CASE WHEN seconds >= 1728000 THEN 5 WHEN seconds >= 864000 THEN 4 ELSE 3 END AS n_colors FROM log",
    "p16_safe_ratio": f"""WITH {SQL_LOG} SELECT "user", round(CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN b = 0 THEN 10.0 ELSE a / b END, 6) AS ratio
        FROM (SELECT "user", count(*) FILTER (WHERE moderator) AS a, count(*) FILTER (WHERE x = 0) AS b FROM log GROUP BY 1)""",
}
