"""Registered queries on changes and the whole canvas, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.config import TEST_CANVAS
from pixelloom.operators import canvas, changes
from pixelloom.sources import adapter
from pixelloom.sources.adapter import SQL_CHANGES, SQL_LOG, SQL_SECTIONS

WIDTH = TEST_CANVAS.bin_width


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes inside compositions, with flags."""
    log = changes.with_redundancy(adapter.pixel_log(spark, sf_dir), ["x", "y"])
    return changes.with_cheats(changes.changes_in_comps(log, changes.rectangle_pixels(adapter.borders(spark, sf_dir))), TEST_CANVAS.cooldown)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.change_counts(flagged(spark, sf_dir), WIDTH)


def _log(make):
    return lambda spark, sf_dir: make(adapter.pixel_log(spark, sf_dir))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})  # no negative zero


GAPS = f"""WITH {SQL_LOG}, gaps AS (
    SELECT * FROM (SELECT *, seconds - lag(seconds) OVER (PARTITION BY "user" ORDER BY seconds, event_id) AS gap FROM log WHERE NOT moderator) WHERE gap IS NOT NULL)"""
RADIUS = f"""WITH {SQL_LOG}, centre AS (SELECT "user", avg(x) AS cx, avg(y) AS cy, count(*) AS n_changes FROM log GROUP BY 1 HAVING count(*) > 1),
    radius AS (SELECT l."user", avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS radius, any_value(n_changes) AS n_changes FROM log l JOIN centre c ON l."user" = c."user" GROUP BY 1)"""

QUERIES = {
    "t13_change_counts": flagship,
    "j1_changes_in_comps": lambda s, d: flagged(s, d).select("comp_id", "event_id", "x", "y", "active"),
    "f1_f3_change_flags": lambda s, d: flagged(s, d).select("comp_id", "event_id", "redundant_col", "redundant_colanduser", "cooldown_cheat"),
    "j3_changes_in_slice": lambda s, d: flagged(s, d).where("active and seconds > 864000 and seconds <= 950400").select("comp_id", "event_id", "seconds"),
    "g1_totals": _log(canvas.totals),
    "g2_color_use": _log(canvas.color_use),
    "g3_enlargements": lambda s, d: canvas.enlargement_times(adapter.pixel_log(s, d), adapter.sections(s)),
    "g4_changes_per_bin": _log(lambda x: canvas.changes_per_bin(x, WIDTH)),
    "g5_active_users": _log(lambda x: canvas.active_users(x, 10800)),
    "g6_heat_map": _log(canvas.heat_map),
    "g7_heat_map_in_time": _log(lambda x: canvas.heat_map(x, 86400)),
    "g8_pixel_change_distribution": _log(lambda x: rounded(canvas.pixel_change_distribution(x, 10, 10, [0, 1, 50, 90, 100, 110, 200, 1e9]), "density", digits=9)),
    "g9_user_change_distribution": _log(canvas.user_change_distribution),
    "g9_user_change_summary": _log(lambda x: rounded(canvas.user_change_summary(x), "mean", "median")),
    "g9_top_users": _log(lambda x: canvas.top_users(x, 20)),
    "g11_gap_histogram": _log(lambda x: canvas.gap_histogram(x, 3600)),
    "g11_gap_counts": _log(lambda x: canvas.gap_counts(x, [300, 3600, 86400])),
    "g12_gap_statistics": _log(lambda x: rounded(canvas.gap_statistics(x), "mean", "least", "median", "deviation", digits=4)),
    "g13_cheaters": _log(lambda x: canvas.cheaters(x, 3600)),
    "g14_gaps_over_time": _log(lambda x: rounded(canvas.gap_over_time(x, 86400, 21600), "share")),
    "g15_user_radius": _log(lambda x: rounded(canvas.user_radius(x), "radius")),
    "g16_user_pair_radius": _log(lambda x: rounded(canvas.user_pair_radius(x), "radius")),
    "g17_radius_by_changes": _log(lambda x: canvas.radius_by_changes(x, 0.25)),
}

ORACLES = {
    "t13_change_counts": f"""WITH {SQL_CHANGES}
        SELECT comp_id, CAST(ceil((seconds - t0) / 21600) AS INT) AS bin, count(*) AS n_changes, count(*) FILTER (WHERE moderator) AS n_moderator,
            count(*) FILTER (WHERE cooldown_cheat) AS n_cheat, count(*) FILTER (WHERE redundant_col) AS n_redundant_col,
            count(*) FILTER (WHERE redundant_colanduser) AS n_redundant_colanduser, count(DISTINCT "user") AS n_users
        FROM changes WHERE active GROUP BY 1, 2""",
    "j1_changes_in_comps": f"WITH {SQL_CHANGES} SELECT comp_id, event_id, x, y, active FROM changes",
    "f1_f3_change_flags": f"WITH {SQL_CHANGES} SELECT comp_id, event_id, redundant_col, redundant_colanduser, cooldown_cheat FROM changes",
    "j3_changes_in_slice": f"WITH {SQL_CHANGES} SELECT comp_id, event_id, seconds FROM changes WHERE active AND seconds > 864000 AND seconds <= 950400",
    "g1_totals": f"""WITH {SQL_LOG} SELECT count(*) AS n_changes, count(DISTINCT "user") AS n_users, max(seconds) AS last_time, count(*) FILTER (WHERE moderator) AS n_moderator_changes,
        count(DISTINCT "user") FILTER (WHERE moderator) AS n_moderator_users FROM log""",
    "g2_color_use": f"WITH {SQL_LOG} SELECT color, min(seconds) AS first_use, max(seconds) AS last_use, count(*) AS n_changes FROM log GROUP BY color",
    "g3_enlargements": f"""WITH {SQL_LOG}, {SQL_SECTIONS} SELECT s.section, min(l.seconds) AS first_change FROM log l, sections s, sections o WHERE o.section = s.section - 1
        AND l.x BETWEEN s.xmin AND s.xmax AND l.y BETWEEN s.ymin AND s.ymax AND NOT (l.x BETWEEN o.xmin AND o.xmax AND l.y BETWEEN o.ymin AND o.ymax) GROUP BY 1""",
    "g4_changes_per_bin": f"""WITH {SQL_LOG} SELECT CAST(floor(seconds / 21600) AS INT) AS bin, count(*) AS n_all, count(*) FILTER (WHERE NOT moderator) AS n_users_only,
        count(*) FILTER (WHERE moderator) AS n_moderator FROM log GROUP BY 1""",
    "g5_active_users": f"""WITH {SQL_LOG} SELECT CAST(floor(seconds / 10800) AS INT) AS bin, count(DISTINCT "user") AS n_users FROM log GROUP BY 1""",
    "g6_heat_map": f"""WITH {SQL_LOG} SELECT x, y, count(*) AS n_changes, count(*) FILTER (WHERE moderator) AS n_moderator, count(DISTINCT "user") AS n_users FROM log GROUP BY 1, 2""",
    "g7_heat_map_in_time": f"""WITH {SQL_LOG} SELECT CAST(floor(seconds / 86400) AS INT) AS bin, x, y, count(*) AS n_changes, count(*) FILTER (WHERE moderator) AS n_moderator,
        count(DISTINCT "user") AS n_users FROM log GROUP BY 1, 2, 3""",
    "g8_pixel_change_distribution": f"""WITH {SQL_LOG}, n AS (SELECT gx.x, gy.y, count(l.event_id) AS n FROM range(10) gx(x) CROSS JOIN range(10) gy(y) LEFT JOIN log l ON l.x = gx.x AND l.y = gy.y GROUP BY 1, 2),
        edges(bin, lo, hi) AS (VALUES (0, 0, 1), (1, 1, 50), (2, 50, 90), (3, 90, 100), (4, 100, 110), (5, 110, 200), (6, 200, 1000000000))
        SELECT bin, count(*) AS n_pixels, round(count(*) / any_value(hi - lo), 9) AS density FROM n JOIN edges ON n >= lo AND n < hi GROUP BY bin""",
    "g9_user_change_distribution": f"""WITH {SQL_LOG} SELECT n_changes, count(*) AS n_users FROM (SELECT "user", count(*) AS n_changes FROM log WHERE NOT moderator GROUP BY 1) GROUP BY 1""",
    "g9_user_change_summary": f"""WITH {SQL_LOG} SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, max(n) AS most
        FROM (SELECT "user", count(*) AS n FROM log WHERE NOT moderator GROUP BY 1)""",
    "g9_top_users": f"""WITH {SQL_LOG} SELECT "user", count(*) AS n_changes FROM log WHERE NOT moderator GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "g11_gap_histogram": f"{GAPS} SELECT CAST(floor(gap / 3600) AS INT) AS bin, count(*) AS n FROM gaps GROUP BY 1",
    "g11_gap_counts": f"{GAPS} SELECT count(*) AS n_gaps, count(*) FILTER (WHERE gap < 300) AS below_0, count(*) FILTER (WHERE gap < 3600) AS below_1, count(*) FILTER (WHERE gap < 86400) AS below_2 FROM gaps",
    "g12_gap_statistics": f"""{GAPS} SELECT "user", round(avg(gap), 4) AS mean, round(min(gap), 4) AS least, round(quantile_cont(gap, 0.5), 4) AS median, round(stddev_pop(gap), 4) AS deviation FROM gaps GROUP BY 1""",
    "g13_cheaters": f"""{GAPS} SELECT "user", count(*) AS n_cheats FROM gaps WHERE gap < 3600 GROUP BY 1""",
    "g14_gaps_over_time": f"""{GAPS} SELECT bin, gap_bin, n, round(n / sum(n) OVER (PARTITION BY bin), 6) AS share
        FROM (SELECT CAST(floor(seconds / 86400) AS INT) AS bin, CAST(floor(gap / 21600) AS INT) AS gap_bin, count(*) AS n FROM gaps GROUP BY 1, 2)""",
    "g15_user_radius": f"""{RADIUS} SELECT "user", round(radius, 6) AS radius, n_changes FROM radius""",
    "g16_user_pair_radius": f"""WITH {SQL_LOG}, n AS (SELECT "user", count(*) AS n_changes FROM log GROUP BY 1 HAVING count(*) > 1)
        SELECT n."user", n.n_changes, round(coalesce(any_value(s), 0) / (n.n_changes * (n.n_changes - 1)), 6) AS radius
        FROM n LEFT JOIN (SELECT a."user", sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS s FROM log a JOIN log b ON a."user" = b."user" AND a.event_id < b.event_id GROUP BY 1) p ON n."user" = p."user" GROUP BY 1, 2""",
    "g17_radius_by_changes": f"""{RADIUS} SELECT CAST(floor(radius / 0.25) AS INT) AS radius_bin, CAST(floor(log2(n_changes)) AS INT) AS changes_bin, count(*) AS n_users FROM radius GROUP BY 1, 2""",
}
