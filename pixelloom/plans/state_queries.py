"""Registered queries on colour times, images, references and attack and defence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.config import TEST_CANVAS, Canvas
from pixelloom.operators import attack_defense as ad
from pixelloom.operators import changes, state
from pixelloom.plans.canvas_queries import flagged, rounded
from pixelloom.sources import adapter
from pixelloom.sources.adapter import SQL_CHANGES
from pixelloom.plans.storage import write_shared

WIDTH, SW = TEST_CANVAS.bin_width, TEST_CANVAS.window


def opened(canvas: Canvas):
    """Opening time of a pixel's section: that of the first section that holds it."""
    found = F.lit(float("inf"))
    for s in reversed(canvas.sections):
        found = F.when(F.col("x").between(s.xmin, s.xmax) & F.col("y").between(s.ymin, s.ymax), F.lit(s.t_open)).otherwise(found)
    return found


class State:
    """The tables that several queries start from. The log in the order of its pixels, and the colour times made of it, are written once where several tables need them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.log = adapter.pixel_log(spark, sf_dir)
        self.pixels = changes.rectangle_pixels(adapter.borders(spark, sf_dir))
        self.stays = state.intervals(self.log, self.pixels, TEST_CANVAS.white, opened(TEST_CANVAS))
        self.times = state.color_time(self.stays, WIDTH)
        self.changes = flagged(spark, sf_dir)
        self._best: DataFrame | None = None

    def shared_stays(self) -> State:
        """Each pixel's changes are dealt and sorted once, whatever the number of compositions; all other tables are made of the written ones row by row."""
        log = write_shared(changes.with_neighbours(changes.with_redundancy(self.log, ["x", "y"])), "ordered-log")
        first = write_shared(state.first_stays(log, self.pixels, TEST_CANVAS.white), "first-stays")
        self.stays = state.stays_of(log, first, self.pixels, opened(TEST_CANVAS))
        self.times = state.color_time(self.stays, WIDTH)
        self.changes = changes.with_cheats(changes.changes_in_comps(log.drop("since", "next"), self.pixels), TEST_CANVAS.cooldown)
        return self

    def shared(self) -> State:
        self.shared_stays()  # first: the times are of the written log
        self.times = write_shared(self.times, "color-time")
        return self

    def both_ways(self) -> State:
        """For references behind and ahead: the colours that both are read from are written once."""
        self._best = write_shared(state.best_colors(self.shared_stays().times, SW), "best-colours")
        return self

    def ref(self) -> DataFrame:
        return state.reference_images(self.times, self.pixels, WIDTH, SW, self._best)

    def forward(self) -> DataFrame:
        return state.forward_references(self.times, self.pixels, WIDTH, SW, self._best)

    def instant(self) -> DataFrame:
        return state.instant_images(self.stays, WIDTH)

    def stability(self) -> DataFrame:
        return state.pixel_stability(self.times)


def _of(make):
    return lambda spark, sf_dir: make(State(spark, sf_dir))


def _differing(s: State) -> DataFrame:
    s.both_ways()
    return state.differing_pixels(state.stable_images(s.times), s.instant(), s.ref(), s.forward())


def _agreed(s: State) -> DataFrame:
    return ad.agreement(s.changes, s.ref(), WIDTH)


def _per_user(s: State) -> DataFrame:
    return ad.changes_per_user_in_window(changes.change_counts(s.changes, WIDTH), ad.window_users(s.changes, WIDTH, SW), state.life_bins(s.pixels, WIDTH), SW)


QUERIES = {
    "t1_bins": _of(lambda s: s.pixels.select("comp_id", "t0", "t1").distinct().join(state.life_bins(s.pixels, WIDTH), "comp_id").select(
        "comp_id", F.explode(F.sequence(F.lit(1), "n_bins")).alias("bin"), (F.col("t0") + (F.col("bin") - 1) * WIDTH).alias("t_beg"), F.least(F.col("t0") + F.col("bin") * WIDTH, "t1").alias("t_end"))),
    "t2_color_time": _of(lambda s: rounded(s.times, "secs")),
    "t3_ranked_colors": _of(lambda s: rounded(state.ranked_colors(s.times), "secs", "share")),
    "t4_pixel_stability": _of(lambda s: rounded(s.stability(), "stability", "runnerup_ratio")),
    "t5_stability_stats": _of(lambda s: rounded(state.integrated_stats(s.stability(), "stability"), "mean", "median", "percentile", "decile_mean")),
    "t5_runnerup_stats": _of(lambda s: rounded(state.integrated_stats(s.stability(), "runnerup_ratio"), "mean", "median", "percentile", "decile_mean")),
    "t6_instant_images": _of(lambda s: s.instant()),
    "t7_stable_images": _of(lambda s: state.stable_images(s.times)),
    "t8_reference_images": _of(lambda s: s.ref()),
    "t9_constant_reference": _of(lambda s: state.constant_reference(s.times)),
    "t10_forward_references": _of(lambda s: s.forward()),
    "t11_differing_pixels": _of(_differing),
    "t14_attack_defense": _of(lambda s: ad.attack_defense(_agreed(s))),
    "t15_new_users": _of(lambda s: ad.new_users(s.changes, WIDTH, SW)),
    "t15_window_users": _of(lambda s: ad.window_users(s.changes, WIDTH, SW)),
    "t16_in_out_groups": _of(lambda s: ad.in_out_groups(s.both_ways().changes, s.ref(), s.forward(), WIDTH)),
    "t17_pixel_attack_share": _of(lambda s: rounded(ad.pixel_attack_share(_agreed(s)), "attack_share")),
    "t18_attack_time": _of(lambda s: rounded(state.attack_time_share(s.shared().times, s.ref(), WIDTH), "attack_time")),
    "t19_return_rate": _of(lambda s: rounded(state.return_rate(s.shared().times, s.instant(), s.ref()), "return_rate")),
    "t23_autocorrelation_by_case": _of(lambda s: rounded(state.autocorrelation_by_case(state.stable_images(s.shared_stays().times), s.instant()), "by_case", "by_case_norm")),
    "t24_color_variances": _of(lambda s: rounded(state.color_variances(s.times), "var_inverse", "var_multinomial", "var_subdominant")),
    "t24_color_autocorrelation": _of(lambda s: rounded(state.color_autocorrelation(s.shared().times), "autocorr_multinomial", "dissimilarity", "autocorr_subdominant")),
    "t25_color_share": _of(lambda s: rounded(state.color_share_of_images(s.shared_stays().instant(), s.ref(), 1), "in_image", "in_ref")),
    "t26_lifetime_users": _of(lambda s: ad.lifetime_users(_agreed(s))),
    "t27_edge_pixels": _of(lambda s: state.edge_pixels(write_shared(s.ref(), "ref"))),
    "t29_changes_per_user": _of(lambda s: rounded(_per_user(s), "changes_per_user")),
    "t30_attack_map": _of(lambda s: s.shared_stays().instant().join(s.ref(), ["comp_id", "x", "y", "bin"]).select("comp_id", "x", "y", "bin", F.when(F.col("inst") == F.col("ref"), "white").otherwise("black").alias("shade"))),
    "t31_lifetime_stability": _of(lambda s: rounded(state.lifetime_stability(s.stays), "stability")),
    "j4_image_at": _of(lambda s: state.last_image(s.log, 20 * 86400.0, TEST_CANVAS.white, s.pixels)),
    "j5_agreement": _of(lambda s: _agreed(s).select("comp_id", "event_id", "bin", "ref", "defense")),
}

SQL_STATE = f"""{SQL_CHANGES}, first AS (
    SELECT p.comp_id, p.x, p.y, p.t0, p.t1, coalesce((SELECT arg_max(color, (seconds, event_id)) FROM log l WHERE l.x = p.x AND l.y = p.y AND l.seconds < p.t0), 4) AS color,
        p.t0 AS seconds, -1 AS event_id FROM pixels p
), stay AS (
    SELECT comp_id, x, y, color, greatest(seconds, CASE WHEN x <= 4 THEN 0 ELSE 432000 END) AS beg,
        coalesce(lead(seconds) OVER (PARTITION BY comp_id, x, y ORDER BY seconds, event_id), t1) AS fin, t0, t1
    FROM (SELECT * FROM first UNION ALL SELECT comp_id, x, y, t0, t1, color, seconds, event_id FROM member WHERE seconds > t0 AND seconds < t1)
), bins AS (
    SELECT comp_id, t0, t1, bin, t0 + (bin - 1) * 21600 AS b0, least(t0 + bin * 21600, t1) AS b1
    FROM (SELECT comp_id, t0, t1, unnest(range(1, CAST(ceil((t1 - t0) / 21600) AS INT) + 1)) AS bin FROM borders)
), times AS (
    SELECT s.comp_id, x, y, bin, color, sum(least(fin, b1) - greatest(beg, b0)) AS secs
    FROM stay s JOIN bins b ON s.comp_id = b.comp_id AND least(fin, b1) > greatest(beg, b0) GROUP BY 1, 2, 3, 4, 5
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY comp_id, x, y, bin ORDER BY secs DESC, color DESC) AS rank, secs / sum(secs) OVER (PARTITION BY comp_id, x, y, bin) AS share FROM times
), stability AS (
    SELECT comp_id, x, y, bin, max(share) FILTER (WHERE rank = 1) AS stability, coalesce(max(share) FILTER (WHERE rank = 2) / max(share) FILTER (WHERE rank = 1), 0) AS runnerup_ratio, count(*) AS n_colors
    FROM ranked GROUP BY 1, 2, 3, 4
), instant AS (
    SELECT s.comp_id, x, y, bin, color AS inst FROM stay s JOIN bins b ON s.comp_id = b.comp_id AND fin > beg AND beg <= b1 AND (b1 < fin OR (fin >= s.t1 AND b1 >= s.t1))
), stable AS (
    SELECT comp_id, x, y, bin, c1 AS stable1, coalesce(c2, c1) AS stable2, coalesce(c3, c2, c1) AS stable3 FROM (
        SELECT comp_id, x, y, bin, max(color) FILTER (WHERE rank = 1) AS c1, max(color) FILTER (WHERE rank = 2) AS c2, max(color) FILTER (WHERE rank = 3) AS c3 FROM ranked GROUP BY 1, 2, 3, 4)
), ref AS (
    SELECT comp_id, x, y, bin, arg_max(color, (round(secs, 6), color)) AS ref FROM (
        SELECT t.comp_id, x, y, b.bin, color, sum(secs) AS secs FROM times t JOIN bins b ON t.comp_id = b.comp_id AND t.bin BETWEEN b.bin - 7 AND b.bin GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4
), fwd AS (
    SELECT comp_id, x, y, bin, arg_max(color, (round(secs, 6), color)) AS ref_fwd FROM (
        SELECT t.comp_id, x, y, b.bin, color, sum(secs) AS secs FROM times t JOIN bins b ON t.comp_id = b.comp_id AND t.bin BETWEEN b.bin + 1 AND b.bin + 8 GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4
), binned AS (
    SELECT *, CAST(ceil((seconds - t0) / 21600) AS INT) AS bin FROM changes WHERE active
), agreed AS (
    SELECT b.*, r.ref, b.color = r.ref AS defense FROM binned b JOIN ref r ON b.comp_id = r.comp_id AND b.x = r.x AND b.y = r.y AND b.bin = r.bin
), seen AS (
    SELECT DISTINCT comp_id, bin, "user" FROM binned
)"""


def _stats(value: str) -> str:
    return f"""WITH {SQL_STATE}, o AS (SELECT *, count(*) OVER (PARTITION BY comp_id, bin) AS n, row_number() OVER (PARTITION BY comp_id, bin ORDER BY {value}, x, y) - 1 AS i FROM stability),
        e AS (SELECT *, CASE WHEN n >= 10 THEN n - n // 10 ELSE 0 END AS edge FROM o)
        SELECT comp_id, bin, round(avg({value}), 6) AS mean, round(max({value}) FILTER (WHERE i = n // 2), 6) AS median, round(max({value}) FILTER (WHERE i = edge), 6) AS percentile,
            round(avg({value}) FILTER (WHERE i >= edge), 6) AS decile_mean FROM e GROUP BY 1, 2"""


def _groups(inner: str) -> str:
    return f"count(*) FILTER (WHERE {inner})"


ORACLES = {
    "t1_bins": f"WITH {SQL_STATE} SELECT comp_id, bin, b0 AS t_beg, b1 AS t_end FROM bins",
    "t2_color_time": f"WITH {SQL_STATE} SELECT comp_id, x, y, bin, color, round(secs, 6) AS secs FROM times",
    "t3_ranked_colors": f"WITH {SQL_STATE} SELECT comp_id, x, y, bin, color, round(secs, 6) AS secs, rank, round(share, 6) AS share FROM ranked",
    "t4_pixel_stability": f"WITH {SQL_STATE} SELECT comp_id, x, y, bin, round(stability, 6) AS stability, round(runnerup_ratio, 6) AS runnerup_ratio, n_colors FROM stability",
    "t5_stability_stats": _stats("stability"),
    "t5_runnerup_stats": _stats("runnerup_ratio"),
    "t6_instant_images": f"WITH {SQL_STATE} SELECT * FROM instant",
    "t7_stable_images": f"WITH {SQL_STATE} SELECT * FROM stable",
    "t8_reference_images": f"WITH {SQL_STATE} SELECT * FROM ref",
    "t9_constant_reference": f"WITH {SQL_STATE} SELECT comp_id, x, y, arg_max(color, (round(secs, 6), color)) AS ref_const FROM (SELECT comp_id, x, y, color, sum(secs) AS secs FROM times GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3",
    "t10_forward_references": f"WITH {SQL_STATE} SELECT * FROM fwd",
    "t11_differing_pixels": f"""WITH {SQL_STATE}, im AS (SELECT s.comp_id, s.x, s.y, s.bin, stable1, inst, ref, ref_fwd FROM stable s LEFT JOIN instant USING (comp_id, x, y, bin) LEFT JOIN ref USING (comp_id, x, y, bin) LEFT JOIN fwd USING (comp_id, x, y, bin)),
        w AS (SELECT a.*, b.inst AS old_inst, b.stable1 AS old_stable FROM im a LEFT JOIN im b ON a.comp_id = b.comp_id AND a.x = b.x AND a.y = b.y AND a.bin = b.bin + 1)
        SELECT comp_id, bin, count(*) FILTER (WHERE stable1 <> ref) AS n_diff_stable_ref, count(*) FILTER (WHERE inst <> ref) AS n_diff_inst_ref, count(*) FILTER (WHERE inst <> ref_fwd) AS n_diff_inst_fwd,
            count(*) FILTER (WHERE inst <> old_inst) AS n_diff_inst_old, count(*) FILTER (WHERE inst <> old_stable) AS n_diff_inst_stable FROM w GROUP BY 1, 2""",
    "t14_attack_defense": f"""WITH {SQL_STATE}, u AS (SELECT comp_id, bin, "user", count(*) FILTER (WHERE defense) AS d, count(*) FILTER (WHERE NOT defense) AS a FROM agreed GROUP BY 1, 2, 3)
        SELECT comp_id, bin, sum(d) AS n_defense, sum(a) AS n_attack, {_groups('d = 0')} AS n_attackonly_users, {_groups('a = 0')} AS n_defenseonly_users, {_groups('a > 0 AND d > 0')} AS n_bothattdef_users, count(*) AS n_users FROM u GROUP BY 1, 2""",
    "t15_new_users": f"""WITH {SQL_STATE} SELECT a.comp_id, a.bin, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.comp_id = a.comp_id AND b."user" = a."user" AND b.bin = a.bin - 1)) AS n_new_vs_bin,
        count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.comp_id = a.comp_id AND b."user" = a."user" AND b.bin BETWEEN a.bin - 8 AND a.bin - 1)) AS n_new_vs_window FROM seen a GROUP BY 1, 2""",
    "t15_window_users": f"""WITH {SQL_STATE}, every AS (SELECT comp_id, unnest(range(1, max(bin) + 9)) AS bin FROM seen GROUP BY 1),
        n AS (SELECT e.comp_id, e.bin, count(DISTINCT s."user") AS n_users_window FROM every e LEFT JOIN seen s ON s.comp_id = e.comp_id AND s.bin BETWEEN e.bin - 7 AND e.bin GROUP BY 1, 2),
        moves AS (SELECT DISTINCT comp_id, bin FROM (SELECT a.comp_id, a.bin FROM seen a WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.comp_id = a.comp_id AND b."user" = a."user" AND b.bin BETWEEN a.bin - 7 AND a.bin - 1)
            UNION ALL SELECT a.comp_id, a.bin + 8 FROM seen a WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.comp_id = a.comp_id AND b."user" = a."user" AND b.bin BETWEEN a.bin + 1 AND a.bin + 7)))
        SELECT m.comp_id, m.bin, coalesce(n.n_users_window, 0) AS n_users_window FROM moves m LEFT JOIN n ON n.comp_id = m.comp_id AND n.bin = m.bin""",
    "t16_in_out_groups": f"""WITH {SQL_STATE}, io AS (SELECT b.comp_id, b.bin, b."user", (b.color = r.ref OR coalesce(b.color = f.ref_fwd, false)) AS inner_ FROM binned b JOIN ref r USING (comp_id, x, y, bin) LEFT JOIN fwd f USING (comp_id, x, y, bin)),
        u AS (SELECT comp_id, bin, "user", count(*) FILTER (WHERE inner_) AS i, count(*) FILTER (WHERE NOT inner_) AS o FROM io GROUP BY 1, 2, 3)
        SELECT comp_id, bin, sum(i) AS n_in, sum(o) AS n_out, {_groups('o = 0')} AS n_in_users, {_groups('i = 0')} AS n_out_users, {_groups('i > 0 AND o > 0')} AS n_both_users FROM u GROUP BY 1, 2""",
    "t17_pixel_attack_share": f"WITH {SQL_STATE} SELECT comp_id, x, y, bin, round(avg(CASE WHEN defense THEN 0.0 ELSE 1.0 END), 6) AS attack_share FROM agreed GROUP BY 1, 2, 3, 4",
    "t18_attack_time": f"""WITH {SQL_STATE} SELECT comp_id, bin, round(greatest(1 - sum(CASE WHEN color = ref THEN secs ELSE 0 END) / (count(DISTINCT (x, y)) * 21600), 0), 6) AS attack_time
        FROM times JOIN ref USING (comp_id, x, y, bin) GROUP BY 1, 2""",
    "t19_return_rate": f"""WITH {SQL_STATE} SELECT r.comp_id, r.bin, round(CASE WHEN count(*) FILTER (WHERE o.inst <> ref) > 0 THEN count(*) FILTER (WHERE o.inst <> ref AND (i.inst = ref OR t.secs IS NOT NULL)) / count(*) FILTER (WHERE o.inst <> ref) ELSE 1.0 END, 6) AS return_rate
        FROM ref r JOIN instant i ON r.comp_id = i.comp_id AND r.x = i.x AND r.y = i.y AND r.bin = i.bin JOIN instant o ON r.comp_id = o.comp_id AND r.x = o.x AND r.y = o.y AND r.bin = o.bin + 1
        LEFT JOIN times t ON t.comp_id = r.comp_id AND t.x = r.x AND t.y = r.y AND t.bin = r.bin AND t.color = ref GROUP BY 1, 2""",
    "t23_autocorrelation_by_case": f"""WITH {SQL_STATE}, c AS (SELECT s.comp_id, s.bin, CASE WHEN i.inst = o.inst THEN CASE WHEN i.inst = stable1 THEN 'still' ELSE 'stays' END WHEN stable1 IN (i.inst, o.inst) THEN 'half' ELSE 'moves' END AS k
            FROM stable s JOIN instant i USING (comp_id, x, y, bin) JOIN instant o ON o.comp_id = s.comp_id AND o.x = s.x AND o.y = s.y AND o.bin = s.bin - 1)
        SELECT comp_id, bin, round(avg(CASE k WHEN 'stays' THEN 1e0 WHEN 'moves' THEN -1 ELSE 0 END), 6) AS by_case,
            round(coalesce(sum(CASE k WHEN 'stays' THEN 1e0 WHEN 'moves' THEN -1 ELSE 0 END) / nullif(sum(CASE k WHEN 'still' THEN 0e0 WHEN 'half' THEN 0.5e0 ELSE 1 END), 0), 0), 6) AS by_case_norm FROM c GROUP BY 1, 2""",
    "t24_color_variances": f"""WITH {SQL_STATE}, c AS (SELECT comp_id, x, y, bin, share * share AS sq, share * (1 - share) AS spread FROM ranked),
        px AS (SELECT comp_id, x, y, bin, sum(sq) AS sq, sum(spread) AS spread, sum(sq) - max(sq) AS sub FROM c GROUP BY 1, 2, 3, 4)
        SELECT comp_id, bin, round(1 / avg(sq), 6) AS var_inverse, round(avg(spread), 6) AS var_multinomial, round(avg(sub), 6) AS var_subdominant FROM px GROUP BY 1, 2""",
    "t24_color_autocorrelation": f"""WITH {SQL_STATE}, v AS (SELECT p.comp_id, p.x, p.y, p.bin, sum(coalesce(o.share, 0) * (1 - coalesce(n.share, 0))) AS multi, 0.5 * sum(power(coalesce(o.share, 0) - coalesce(n.share, 0), 2)) AS apart,
            sum(coalesce(n.share * o.share, 0)) - max(coalesce(n.share * o.share, 0)) AS sub
            FROM stability p CROSS JOIN range(5) c(color) LEFT JOIN ranked n ON n.comp_id = p.comp_id AND n.x = p.x AND n.y = p.y AND n.bin = p.bin AND n.color = c.color
            LEFT JOIN ranked o ON o.comp_id = p.comp_id AND o.x = p.x AND o.y = p.y AND o.bin = p.bin - 1 AND o.color = c.color WHERE p.bin > 1 GROUP BY 1, 2, 3, 4)
        SELECT comp_id, bin, round(avg(multi), 6) AS autocorr_multinomial, round(avg(apart), 6) AS dissimilarity, round(avg(sub), 6) AS autocorr_subdominant FROM v GROUP BY 1, 2""",
    "t25_color_share": f"WITH {SQL_STATE} SELECT comp_id, bin, round(avg(CASE WHEN inst = 1 THEN 1.0 ELSE 0 END), 6) AS in_image, round(avg(CASE WHEN ref = 1 THEN 1.0 ELSE 0 END), 6) AS in_ref FROM instant JOIN ref USING (comp_id, x, y, bin) GROUP BY 1, 2",
    "t26_lifetime_users": f"""WITH {SQL_STATE}, u AS (SELECT comp_id, "user", count(*) FILTER (WHERE defense) AS d, count(*) FILTER (WHERE NOT defense) AS a FROM agreed GROUP BY 1, 2)
        SELECT comp_id, count(*) AS n_users, {_groups('d = 0')} AS n_attackonly, {_groups('a = 0')} AS n_defenseonly, {_groups('a > 0 AND d > 0')} AS n_both FROM u GROUP BY 1""",
    "t27_edge_pixels": f"""WITH {SQL_STATE}, w AS (SELECT r.comp_id, r.x, r.y, r.bin, coalesce(a.ref, r.ref) AS ri, coalesce(b.ref, r.ref) AS le, coalesce(c.ref, r.ref) AS dn, coalesce(d.ref, r.ref) AS up FROM ref r
        LEFT JOIN ref a ON a.comp_id = r.comp_id AND a.bin = r.bin AND a.x = r.x + 1 AND a.y = r.y LEFT JOIN ref b ON b.comp_id = r.comp_id AND b.bin = r.bin AND b.x = r.x - 1 AND b.y = r.y
        LEFT JOIN ref c ON c.comp_id = r.comp_id AND c.bin = r.bin AND c.x = r.x AND c.y = r.y + 1 LEFT JOIN ref d ON d.comp_id = r.comp_id AND d.bin = r.bin AND d.x = r.x AND d.y = r.y - 1)
        SELECT comp_id, x, y, bin, (ri <> le OR up <> dn) AS edge FROM w""",
    "t29_changes_per_user": f"""WITH {SQL_STATE} SELECT b.comp_id, b.bin, round(count(*) / count(DISTINCT c."user"), 6) AS changes_per_user FROM bins b JOIN binned c ON c.comp_id = b.comp_id AND c.bin BETWEEN b.bin - 7 AND b.bin GROUP BY 1, 2""",
    "t30_attack_map": f"WITH {SQL_STATE} SELECT comp_id, x, y, bin, CASE WHEN inst = ref THEN 'white' ELSE 'black' END AS shade FROM instant JOIN ref USING (comp_id, x, y, bin)",
    "t31_lifetime_stability": f"""WITH {SQL_STATE} SELECT comp_id, round(avg(s), 6) AS stability, count(*) AS area FROM (SELECT comp_id, x, y, max(secs) / sum(secs) AS s
        FROM (SELECT comp_id, x, y, color, sum(fin - beg) AS secs FROM stay WHERE fin > beg GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1""",
    "j4_image_at": f"WITH {SQL_CHANGES} SELECT p.x, p.y, coalesce(arg_max(l.color, (l.seconds, l.event_id)), 4) AS color FROM (SELECT DISTINCT x, y FROM pixels) p LEFT JOIN log l ON l.x = p.x AND l.y = p.y AND l.seconds < 1728000 GROUP BY 1, 2",
    "j5_agreement": f"WITH {SQL_STATE} SELECT comp_id, event_id, bin, ref, defense FROM agreed",
}
