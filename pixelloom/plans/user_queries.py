"""Registered queries on users, scaling, the network of users and null models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.config import TEST_CANVAS
from pixelloom.operators import changes, coactivity, network, nullmodels, users
from pixelloom.plans.canvas_queries import WIDTH, flagged, rounded
from pixelloom.plans.series_queries import ROWS, difference_series
from pixelloom.plans.state_queries import SQL_STATE
from pixelloom.plans.storage import write_shared
from pixelloom.sources import adapter
from pixelloom.sources.adapter import SQL_CHANGES, SQL_LOG, SQL_PIXELS

HOUR = 3600.0


def lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = adapter.borders(spark, sf_dir)
    return b.select("comp_id", ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).alias("area"), "t0", "t1")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean gap and number of changes of each user, as x and y."""
    log = adapter.pixel_log(spark, sf_dir)
    return log.groupBy("user").agg(F.avg("seconds").alias("x"), F.count("*").cast("double").alias("y"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.members(adapter.pixel_log(spark, sf_dir), HOUR, HOUR / 2)


def edges(spark: SparkSession, sf_dir: str, least: float = 0.0) -> DataFrame:
    return network.coactivity_edges(adapter.pixel_log(spark, sf_dir), HOUR, HOUR / 2, least)


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.rectangle_pixels(adapter.borders(spark, sf_dir))


def _log(make):
    return lambda spark, sf_dir: make(adapter.pixel_log(spark, sf_dir))


def _text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.select(F.concat(F.lit("n"), "u", F.lit(".0")).alias("source"), F.concat(F.lit("user "), "v").alias("target"), F.round("w", 6).cast("string").alias("weight"))


GRID = [i * 300_000.0 for i in range(1, 9)]
BREAKS = [i * 100_000.0 for i in range(9, 17)]

NORMALISED = ("share_moderator", "share_cheat", "share_redundant_col", "share_redundant_colanduser", "changes_rate", "changes_per_user")

QUERIES = {
    "t28_normalised_counts": lambda s, d: rounded(changes.normalised_counts(changes.change_counts(flagged(s, d), WIDTH), lives(s, d).select("comp_id", "area"), WIDTH), *NORMALISED, digits=9),
    "u1_attention": lambda s, d: rounded(users.attention(flagged(s, d), 300, TEST_CANVAS.whiteout), "mean", "median", "pix_norm", digits=9),
    "u2_user_paths": lambda s, d: rounded(users.paths(flagged(s, d)), "path_length", "mean_step", "mean_off_centre", "session", "mean_gap", "speed"),
    "u3_recovery_times": lambda s, d: users.recovery_times(write_shared(difference_series(s, d), "difference"), 0.6, 0.35),
    "u4_scaling_table": lambda s, d: rounded(users.scaling_table(changes.change_counts(flagged(s, d), WIDTH), lives(s, d).select("comp_id", "area"), 12), "mean_users", "density"),
    "u5_changes_matrix": lambda s, d: changes.change_counts(flagged(s, d), 5 * 86400.0).groupBy("comp_id").pivot("bin", list(range(1, 7))).agg(F.first("n_changes")).withColumnsRenamed({str(i): f"b{i}" for i in range(1, 7)}),
    "u6_survivorship": lambda s, d: rounded(users.survivorship(lives(s, d), [i * 86400.0 for i in range(0, 31, 3)], 86400.0, 30 * 86400.0, [0, 7, 10]), "share"),
    "u8_log_bins": lambda s, d: rounded(users.log_bins(points(s, d).select(F.col("y").alias("x"), F.col("x").alias("y")), 5), "mean_x", "mean_y", "median_y", "error_y"),
    "u9_kernel_smooth": lambda s, d: rounded(users.kernel_smooth(points(s, d), GRID, 200_000.0), "smooth", "n_effective"),
    "u10_log_fits": lambda s, d: rounded(users.log_fits(points(s, d)), "slope", "intercept", "slope_total", "intercept_total", "r2", "rms", digits=5),
    "u12_two_segment_fit": lambda s, d: rounded(users.two_segment_fit(points(s, d).select((F.col("x") / 1e6).alias("x"), "y"), [b / 1e6 for b in BREAKS]), "slope", "slope_after", "intercept", "error", digits=4),
    "n1_coactivity_edges": lambda s, d: rounded(edges(s, d), "w"),
    "n2_vertices": lambda s, d: rounded(network.vertices(adapter.pixel_log(s, d), members(s, d)), "log_changes", "strength"),
    "n3_degree_distribution": lambda s, d: coactivity.degrees(members(s, d)).groupBy("degree").agg(F.count("*").alias("n_users")),
    "n4_largest_component": lambda s, d: rounded(network.edges_of(network.largest_of(members(s, d))), "w"),
    "n5_clustering": lambda s, d: rounded(network.clustering(write_shared(edges(s, d, 0.3), "coactivity")), "clustering"),
    # no SQL: the triangles of the whole network are too many for it
    "n5_whole_clustering": lambda s, d: rounded(network.whole_clustering(edges(s, d)), "clustering"),
    "n6_edges_from_text": lambda s, d: network.edges_from_text(_text_edges(s, d)),
    "m1_uniform_null_model": _log(lambda x: nullmodels.uniform(x, TEST_CANVAS)),
    "m2_area_weights": lambda s, d: rounded(nullmodels.cumulative(nullmodels.pixel_weights(_pixels(s, d), 0.5)), "lo", "hi"),
    "m2_area_null_model": lambda s, d: nullmodels.weighted(adapter.pixel_log(s, d), nullmodels.pixel_weights(_pixels(s, d), 0.5)),
    "m3_perimeter_weights": lambda s, d: nullmodels.perimeter_weights(_pixels(s, d)),
    "m5_combined_weights": lambda s, d: rounded(nullmodels.combined_weights(nullmodels.pixel_weights(_pixels(s, d), 0.5), nullmodels.perimeter_weights(_pixels(s, d)), "mean"), "weight"),
    "m6_loyal_null_model": lambda s, d: nullmodels.loyal(adapter.pixel_log(s, d), _pixels(s, d)),
}

POINTS = f"""{SQL_LOG}, points AS (SELECT "user", avg(seconds) AS x, CAST(count(*) AS DOUBLE) AS y FROM log GROUP BY 1)"""
EDGES = f"""{SQL_LOG}, member AS (SELECT DISTINCT "user", unnest(range(greatest(CAST(floor(seconds / 1800) AS INT) - 1, 0), CAST(floor(seconds / 1800) AS INT) + 1)) AS win FROM log),
    edges AS (SELECT a."user" AS u, b."user" AS v, sum(1 / n) AS w FROM member a JOIN member b ON a.win = b.win AND a."user" < b."user" JOIN (SELECT win, count(*) AS n FROM member GROUP BY win) s ON s.win = a.win GROUP BY 1, 2),
    ends AS (SELECT u AS "user", w FROM edges UNION ALL SELECT v, w FROM edges), deg AS (SELECT "user", count(*) AS degree, sum(w) AS strength FROM ends GROUP BY 1)"""
LIVES = "borders_ AS (SELECT comp_id, (x1 - x0 + 1) * (y1 - y0 + 1) AS area, t0, t1 FROM borders)"
WEIGHTS = f"""{SQL_PIXELS}, areas AS (SELECT comp_id, count(DISTINCT (x, y)) AS area FROM pixels GROUP BY 1), weight AS (SELECT x, y, sqrt(min(area)) AS weight FROM pixels JOIN areas USING (comp_id) GROUP BY 1, 2),
    edge AS (SELECT comp_id, count(*) AS perimeter FROM (SELECT a.comp_id, a.x, a.y FROM pixels a LEFT JOIN pixels b ON a.comp_id = b.comp_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2, 3 HAVING count(b.x) < 4) GROUP BY 1),
    pweight AS (SELECT x, y, CAST(min(perimeter) AS DOUBLE) AS weight FROM pixels JOIN edge USING (comp_id) GROUP BY 1, 2)"""

ORACLES = {
    "t28_normalised_counts": f"""WITH {SQL_STATE}, {LIVES} SELECT b.comp_id, bin, round(count(*) FILTER (WHERE moderator) / count(*), 9) AS share_moderator, round(count(*) FILTER (WHERE cooldown_cheat) / count(*), 9) AS share_cheat,
        round(count(*) FILTER (WHERE redundant_col) / count(*), 9) AS share_redundant_col, round(count(*) FILTER (WHERE redundant_colanduser) / count(*), 9) AS share_redundant_colanduser,
        round(count(*) / (any_value(area) * 21600), 9) AS changes_rate, round(count(*) / count(DISTINCT "user"), 9) AS changes_per_user FROM binned b JOIN borders_ USING (comp_id) GROUP BY 1, 2""",
    "u1_attention": f"""WITH {SQL_CHANGES}, life AS (SELECT comp_id, min(t0) AS a, count(DISTINCT (x, y)) AS n_pix FROM changes GROUP BY 1),
        per AS (SELECT comp_id, "user", count(*) AS n FROM changes WHERE active GROUP BY 1, 2),
        v AS (SELECT per.*, n / ((2505600 - a) / 300) AS att, n_pix, row_number() OVER (PARTITION BY comp_id ORDER BY n, "user") AS i FROM per JOIN life USING (comp_id))
        SELECT comp_id, round(avg(att), 9) AS mean, round(quantile_cont(att, 0.5), 9) AS median, round(avg(att) FILTER (WHERE i <= n_pix), 9) AS pix_norm FROM v GROUP BY 1""",
    "u2_user_paths": f"""WITH {SQL_CHANGES}, m AS (SELECT *, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) AS step, sqrt((x - avg(x) OVER p) ** 2 + (y - avg(y) OVER p) ** 2) AS off_
            FROM changes WHERE active WINDOW o AS (PARTITION BY comp_id, "user" ORDER BY seconds, event_id), p AS (PARTITION BY comp_id, "user"))
        SELECT comp_id, "user", count(*) AS n_edits, round(sum(step), 6) AS path_length, round(avg(step), 6) AS mean_step, round(CASE WHEN count(*) > 1 THEN avg(off_) END, 6) AS mean_off_centre,
            round(CASE WHEN count(*) > 1 THEN max(seconds) - min(seconds) END, 6) AS session, round(CASE WHEN count(*) > 1 THEN (max(seconds) - min(seconds)) / (count(*) - 1) END, 6) AS mean_gap,
            round(CASE WHEN count(*) > 1 AND max(seconds) > min(seconds) THEN sum(step) / (max(seconds) - min(seconds)) END, 6) AS speed FROM m GROUP BY 1, 2""",
    "u3_recovery_times": f"""WITH {ROWS}, f AS (SELECT comp_id, min(bin) FILTER (WHERE val > 0.6) AS hit, count(*) FILTER (WHERE val > 0.6) AS n_hit FROM rows_ GROUP BY 1)
        SELECT f.comp_id, hit, min(bin) AS back, min(bin) - hit AS recovery FROM f JOIN rows_ r ON r.comp_id = f.comp_id AND bin > hit AND val < 0.35 WHERE n_hit > 1 GROUP BY f.comp_id, hit HAVING count(*) > 1""",
    "u4_scaling_table": f"""WITH {SQL_STATE}, {LIVES}, c AS (SELECT comp_id, bin, count(*) AS n, count(DISTINCT "user") AS u FROM binned GROUP BY 1, 2)
        SELECT b.comp_id, area, coalesce(sum(n), 0) AS changes, coalesce(sum(n) FILTER (WHERE bin <= 12), 0) AS changes_first, count(bin) AS active_bins, round(avg(u), 6) AS mean_users, round(coalesce(sum(n), 0) / area, 6) AS density
        FROM borders_ b LEFT JOIN c ON c.comp_id = b.comp_id GROUP BY 1, 2""",
    "u5_changes_matrix": f"""WITH {SQL_CHANGES}, c AS (SELECT comp_id, CAST(ceil((seconds - t0) / 432000) AS INT) AS bin, count(*) AS n FROM changes WHERE active GROUP BY 1, 2)
        SELECT comp_id, {', '.join(f'max(n) FILTER (WHERE bin = {i}) AS b{i}' for i in range(1, 7))} FROM c GROUP BY 1""",
    "u6_survivorship": f"""WITH {SQL_PIXELS}, {LIVES}, k AS (SELECT *, CASE WHEN area < 7 THEN 0 WHEN area < 10 THEN 1 END AS size_class FROM borders_ WHERE NOT (t0 > 86400 AND t1 >= 2592000)),
        a AS (SELECT size_class, age, count(*) FILTER (WHERE t1 - t0 > age) AS n FROM k, (SELECT unnest(range(0, 31, 3)) * 86400e0 AS age) WHERE size_class IS NOT NULL GROUP BY 1, 2)
        SELECT size_class, age, n, round(n / nullif(first_value(n) OVER (PARTITION BY size_class ORDER BY age), 0), 6) AS share FROM a""",
    "u8_log_bins": f"""WITH {POINTS}, l AS (SELECT log10(y) AS lx, log10(x) AS ly FROM points) SELECT CAST(floor(lx * 5) AS INT) AS bin, count(*) AS n, round(avg(lx), 6) AS mean_x, round(avg(ly), 6) AS mean_y,
        round(quantile_cont(ly, 0.5), 6) AS median_y, round(CASE WHEN count(*) > 1 THEN stddev_samp(ly) / sqrt(count(*)) END, 6) AS error_y FROM l GROUP BY 1""",
    "u9_kernel_smooth": f"""WITH {POINTS}, g AS (SELECT unnest(range(1, 9)) * 300000e0 AS at_), w AS (SELECT at_, y, exp(-0.5 * ((x - at_) / 200000) ** 2) AS w FROM points, g)
        SELECT at_ AS "at", round(sum(w * y) / sum(w), 6) AS smooth, round(sum(w) ** 2 / sum(w * w), 6) AS n_effective FROM w GROUP BY 1""",
    "u10_log_fits": f"""WITH {POINTS}, l AS (SELECT log10(x) AS lx, log10(y) AS ly FROM points), m AS (SELECT avg(lx) AS mx, avg(ly) AS my, var_pop(lx) AS vx, var_pop(ly) AS vy, covar_pop(lx, ly) AS c, count(*) AS n FROM l),
        t AS (SELECT *, c / vx AS s, (vy - vx + sqrt((vy - vx) ** 2 + 4 * c * c)) / (2 * c) AS st FROM m)
        SELECT n, round(s, 5) AS slope, round(my - s * mx, 5) AS intercept, round(st, 5) AS slope_total, round(my - st * mx, 5) AS intercept_total, round(s * c / vy, 5) AS r2, round(sqrt(greatest(vy - s * c, 0)), 5) AS rms FROM t""",
    "u12_two_segment_fit": f"""WITH {POINTS}, z AS (SELECT brk, x / 1e6 AS x, y, greatest(x / 1e6 - brk, 0) AS z FROM points, (SELECT unnest(range(9, 17)) * 100000e0 / 1e6 AS brk)),
        m AS (SELECT brk, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, var_pop(y) AS yy FROM z GROUP BY 1),
        f AS (SELECT brk, my, mx, mz, xy, zy, yy, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM m WHERE xx * zz - xz * xz > 1e-12)
        SELECT brk, round(b1, 4) AS slope, round(b1 + b2, 4) AS slope_after, round(my - b1 * mx - b2 * mz, 4) AS intercept, round(yy - b1 * xy - b2 * zy, 4) AS error FROM f ORDER BY round(yy - b1 * xy - b2 * zy, 9), brk LIMIT 1""",
    "n1_coactivity_edges": f"WITH {EDGES} SELECT u, v, round(w, 6) AS w FROM edges",
    "n2_vertices": f"""WITH {EDGES} SELECT l."user", count(*) AS n_changes, round(log10(count(*)), 6) AS log_changes, coalesce(any_value(degree), 0) AS degree, round(coalesce(any_value(strength), 0), 6) AS strength FROM log l LEFT JOIN deg d ON d."user" = l."user" GROUP BY 1""",
    "n3_degree_distribution": f"WITH {EDGES} SELECT degree, count(*) AS n_users FROM deg GROUP BY 1",
    "n4_largest_component": f"""WITH RECURSIVE {EDGES}, both_ AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges),
        reach(a, b) AS (SELECT u, u FROM both_ UNION SELECT r.a, e.v FROM reach r JOIN both_ e ON r.b = e.u), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY 1),
        best AS (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT u, v, round(w, 6) AS w FROM edges WHERE u IN (SELECT a FROM comp WHERE c = (SELECT c FROM best))""",
    "n5_clustering": f"""WITH {EDGES}, e AS (SELECT u, v FROM edges WHERE w > 0.3), d AS (SELECT x, count(*) AS k FROM (SELECT u AS x FROM e UNION ALL SELECT v FROM e) GROUP BY 1),
        t AS (SELECT count(*) AS n_triangles FROM e a JOIN e b ON a.v = b.u JOIN e c ON c.u = a.u AND c.v = b.v), p AS (SELECT CAST(sum(k * (k - 1) / 2) AS BIGINT) AS n_triples FROM d)
        SELECT n_triangles, n_triples, round(CASE WHEN n_triples > 0 THEN 3.0 * n_triangles / n_triples END, 6) AS clustering FROM t, p""",
    "n6_edges_from_text": f"WITH {EDGES} SELECT u, v, round(w, 6) AS w FROM edges",
    "m2_area_weights": f"WITH {WEIGHTS} SELECT x, y, round((sum(weight) OVER (ORDER BY x, y) - weight) / sum(weight) OVER (), 6) AS lo, round(sum(weight) OVER (ORDER BY x, y) / sum(weight) OVER (), 6) AS hi FROM weight",
    "m3_perimeter_weights": f"WITH {WEIGHTS} SELECT * FROM pweight",
    "m5_combined_weights": f"WITH {WEIGHTS} SELECT coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, round((coalesce(a.weight, 0) + coalesce(b.weight, 0)) / 2, 6) AS weight FROM weight a FULL JOIN pweight b ON a.x = b.x AND a.y = b.y",
}
