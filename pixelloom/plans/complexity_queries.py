"""Registered queries on the complexity of images, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.config import TEST_CANVAS
from pixelloom.operators import changes, complexity, state
from pixelloom.plans.canvas_queries import rounded
from pixelloom.plans.entropy_queries import images
from pixelloom.plans.state_queries import SQL_STATE, SW, WIDTH, State
from pixelloom.plans.storage import write_shared


def _of(make):
    return lambda spark, sf_dir: make(images(spark, sf_dir))


def _state(make):
    return lambda spark, sf_dir: make(State(spark, sf_dir))


def _ref(s: State) -> DataFrame:
    return s.shared().ref().select("comp_id", "bin", "x", "y", F.col("ref").alias("color"))


def _attacks(s: State) -> DataFrame:
    return state.attack_durations(s.stays, state.constant_reference(s.times))


def _windowed(s: State) -> DataFrame:
    s.shared()
    return state.windowed_return_times(s.stays, s.instant(), s.ref(), WIDTH, SW)


def _fractal(x: DataFrame) -> DataFrame:
    return complexity.fractal_summary(complexity.fractal_dimensions(complexity.touched_boxes(x, [1, 2, 3])), complexity.color_shares(x))


def _ripley(s: State) -> DataFrame:
    found = complexity.ripley(changes.in_bins(s.changes, WIDTH).where("active"), [1.0, 1.5, 2.0])
    norm = complexity.normalised_ripley(found, complexity.random_ripley(s.pixels, [1.0, 1.5, 2.0]), 3)
    return rounded(norm, *norm.columns[2:])


QUERIES = {
    "i5_block_modes": _of(lambda x: complexity.block_modes(x, 2)),
    "i6_multiscale_complexity": _of(lambda x: rounded(complexity.multiscale_complexity(x, [1, 2]), "complexity")),
    "i7_levenshtein_complexity": _of(lambda x: rounded(complexity.levenshtein_complexity(x), "rows", "columns", "complexity")),
    "i10_touched_boxes": _of(lambda x: complexity.touched_boxes(x, [1, 2, 3])),
    "i10_boxes_by_corners": _of(lambda x: rounded(complexity.touched_boxes_by_corners(x), "n_boxes")),
    "i15_normalised_ripley": _state(_ripley),
    "i11_fractal_dimensions": _of(lambda x: rounded(complexity.fractal_dimensions(complexity.touched_boxes(x, [1, 2, 3])), "dimension")),
    "i12_color_shares": _of(lambda x: rounded(complexity.color_shares(x), "share")),
    "i13_fractal_summary": _of(lambda x: rounded(_fractal(x), "median", "weighted")),
    "i15_ripley": _state(lambda s: rounded(complexity.ripley(changes.in_bins(s.changes, WIDTH).where("active"), [1.0, 1.5, 2.0]), "k_0", "k_1", "k_2", "mean_distance")),
    "i16_image_shifts": _of(complexity.image_shifts),
    "t12_differing_blocks": _state(lambda s: complexity.differing_blocks(s.instant().withColumnRenamed("inst", "color"), _ref(s), 2)),
    "t20_last_installed": _state(lambda s: rounded(state.last_installed(s.stays), "last_got", "last_lost")),
    "t21_attack_durations": _state(lambda s: rounded(_attacks(s).drop("t0"), "beg", "duration")),
    "t21_windowed_return_times": _state(lambda s: rounded(_windowed(s), "return_time")),
    "t21_return_time_stats": _state(lambda s: rounded(state.return_time_stats(write_shared(_windowed(s), "return-times")), "mean", "median", "percentile", "decile_mean")),
    "t22_return_times": _state(lambda s: rounded(state.return_times(state.attack_flips(s.shared_stays().stays, state.constant_reference(s.times), TEST_CANVAS.total), WIDTH), "mean", "median_ln2", digits=5)),
}

IMAGES = f"""{SQL_STATE}, img AS (SELECT comp_id, bin, x - min(x) OVER i AS x, y - min(y) OVER i AS y, inst AS color FROM instant WINDOW i AS (PARTITION BY comp_id, bin))"""


def _modes(factor: int, source: str = "img") -> str:
    return f"""(SELECT comp_id, bin, bx, by_, arg_max(color, (n, -color)) AS color FROM (SELECT comp_id, bin, x // {factor} AS bx, y // {factor} AS by_, color, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY 1, 2, 3, 4)"""


def _entropy(factor: int) -> str:
    return f"""SELECT comp_id, bin, {factor * factor}e0 * sum(-p * ln(p)) AS part FROM (SELECT comp_id, bin, color, count(*) / sum(count(*)) OVER (PARTITION BY comp_id, bin) AS p FROM {_modes(factor)} GROUP BY 1, 2, 3) GROUP BY 1, 2"""


BOXES = f"""{IMAGES}, boxes AS ({' UNION ALL '.join(f'SELECT comp_id, bin, color, count(DISTINCT (x // {k}, y // {k})) AS n_boxes, {k} AS size FROM img GROUP BY 1, 2, 3' for k in (1, 2, 3))}),
    dims AS (SELECT comp_id, bin, color, -covar_pop(log10(size), log10(n_boxes)) / var_pop(log10(size)) AS dimension FROM boxes GROUP BY 1, 2, 3),
    shares AS (SELECT comp_id, bin, color, n / sum(n) OVER (PARTITION BY comp_id, bin) AS share, row_number() OVER (PARTITION BY comp_id, bin ORDER BY n DESC, color) AS rank FROM (SELECT comp_id, bin, color, count(*) AS n FROM img GROUP BY 1, 2, 3))"""


def _edits(along: str, across: str) -> str:
    return f"""(SELECT comp_id, bin, avg(levenshtein(line, old)) AS d FROM (SELECT *, lag(line) OVER (PARTITION BY comp_id, bin ORDER BY {across}) AS old
        FROM (SELECT comp_id, bin, {across}, string_agg(chr(65 + color), '' ORDER BY {along}) AS line FROM img GROUP BY 1, 2, 3)) WHERE old IS NOT NULL GROUP BY 1, 2)"""


ATTACKS = f"""{SQL_STATE}, const AS (SELECT comp_id, x, y, arg_max(color, (round(secs, 6), color)) AS ref_const FROM (SELECT comp_id, x, y, color, sum(secs) AS secs FROM times GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
    o AS (SELECT s.*, color <> ref_const AS off_ FROM stay s JOIN const USING (comp_id, x, y) WHERE fin > beg),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY comp_id, x, y ORDER BY beg) AS run FROM (SELECT *, CASE WHEN coalesce(lag(off_) OVER (PARTITION BY comp_id, x, y ORDER BY beg) <> off_, true) THEN 1 ELSE 0 END AS turn FROM o)),
    attacks AS (SELECT comp_id, x, y, min(beg) AS beg, max(fin) - min(beg) AS duration, max(fin) >= max(t1) AS open, min(t0) AS t0 FROM r WHERE off_ GROUP BY comp_id, x, y, run)"""

RETURNS = f"""{SQL_STATE}, shown AS (SELECT *, lag(color) OVER (PARTITION BY comp_id, x, y ORDER BY beg) AS old FROM stay WHERE fin > beg), births AS (SELECT comp_id, x, y, min(beg) AS born FROM shown GROUP BY 1, 2, 3),
    asks AS (SELECT r.comp_id, r.x, r.y, r.bin, ref, inst, b1 AS t, born FROM ref r JOIN instant USING (comp_id, x, y, bin) JOIN bins USING (comp_id, bin) JOIN births USING (comp_id, x, y)),
    looked AS (SELECT a.comp_id, a.x, a.y, a.bin, any_value(a.ref = a.inst) AS on_ref, any_value(a.t) AS t, coalesce(max(s.beg) FILTER (WHERE s.color = a.ref), any_value(born)) AS got, coalesce(max(s.beg) FILTER (WHERE s.old = a.ref), any_value(born)) AS lost
        FROM asks a LEFT JOIN shown s ON s.comp_id = a.comp_id AND s.x = a.x AND s.y = a.y AND s.beg <= a.t AND s.old <> s.color AND a.ref IN (s.color, s.old) GROUP BY 1, 2, 3, 4),
    returns AS (SELECT *, CASE WHEN NOT on_ref THEN t - lost WHEN lost > t - 8 * 21600 THEN got - lost END AS v FROM looked)"""

ORACLES = {
    "i5_block_modes": f"WITH {IMAGES} SELECT comp_id, bin, bx, by_ AS by, color FROM {_modes(2)}",
    "i6_multiscale_complexity": f"WITH {IMAGES} SELECT comp_id, bin, round(sum(part) / any_value(area), 6) AS complexity FROM ({_entropy(1)} UNION ALL {_entropy(2)}) JOIN (SELECT comp_id, bin, count(*) AS area FROM img GROUP BY 1, 2) USING (comp_id, bin) GROUP BY 1, 2",
    "i7_levenshtein_complexity": f"WITH {IMAGES} SELECT a.comp_id, a.bin, round(a.d, 6) AS rows, round(b.d, 6) AS columns, round(a.d * b.d, 6) AS complexity FROM {_edits('x', 'y')} a JOIN {_edits('y', 'x')} b ON a.comp_id = b.comp_id AND a.bin = b.bin",
    "i10_touched_boxes": f"WITH {BOXES} SELECT * FROM boxes",
    "i10_boxes_by_corners": f"""WITH {IMAGES}, wide AS (SELECT *, max(x) OVER (PARTITION BY comp_id, bin) + 1 AS w, max(y) OVER (PARTITION BY comp_id, bin) + 1 AS h FROM img),
        sized AS (SELECT *, unnest(range(1, CAST(least(greatest(round_even(0.1e0 * least(w, h), 0), 3), 10) AS INT) + 1)) AS size, CAST(least(greatest(round_even(0.1e0 * least(w, h), 0), 3), 10) AS INT) AS top FROM wide),
        grids AS (SELECT *, ceil(w / size) * size - w AS cw, ceil(h / size) * size - h AS ch FROM sized, range(4) g(grid) WHERE grid = 0 OR size > top - 3),
        n AS (SELECT comp_id, bin, color, size, grid, count(DISTINCT (floor((x + CASE WHEN grid IN (1, 3) THEN cw ELSE 0 END) / size), floor((y + CASE WHEN grid IN (1, 2) THEN ch ELSE 0 END) / size))) AS n FROM grids GROUP BY ALL)
        SELECT comp_id, bin, color, size, round(avg(n), 6) AS n_boxes FROM n GROUP BY 1, 2, 3, 4""",
    "i11_fractal_dimensions": f"WITH {BOXES} SELECT comp_id, bin, color, round(dimension, 6) + 0e0 AS dimension FROM dims",
    "i12_color_shares": f"WITH {BOXES} SELECT comp_id, bin, color, round(share, 6) AS share, rank FROM shares",
    "i13_fractal_summary": f"WITH {BOXES} SELECT comp_id, bin, round(quantile_cont(dimension, 0.5) FILTER (WHERE dimension > 1e-9), 6) AS median, round(sum(dimension * share), 6) + 0e0 AS weighted FROM dims JOIN shares USING (comp_id, bin, color) GROUP BY 1, 2",
    "t12_differing_blocks": f"""WITH {IMAGES}, rimg AS (SELECT comp_id, bin, x - min(x) OVER i AS x, y - min(y) OVER i AS y, ref AS color FROM ref WINDOW i AS (PARTITION BY comp_id, bin))
        SELECT a.comp_id, a.bin, count(*) FILTER (WHERE a.color <> b.color) AS n_diff, count(*) AS n_blocks FROM {_modes(2)} a JOIN {_modes(2, 'rimg')} b ON a.comp_id = b.comp_id AND a.bin = b.bin AND a.bx = b.bx AND a.by_ = b.by_ GROUP BY 1, 2""",
    "t20_last_installed": f"""WITH {SQL_STATE}, m AS (SELECT *, lag(color) OVER o AS old, lead(color) OVER o AS next FROM stay WHERE fin > beg WINDOW o AS (PARTITION BY comp_id, x, y ORDER BY beg))
        SELECT comp_id, x, y, color, round(max(beg) FILTER (WHERE old <> color), 6) AS last_got, round(max(fin) FILTER (WHERE next <> color), 6) AS last_lost FROM m GROUP BY 1, 2, 3, 4""",
    "t21_attack_durations": f"WITH {ATTACKS} SELECT comp_id, x, y, round(beg, 6) AS beg, round(duration, 6) AS duration, open FROM attacks",
    "t22_return_times": f"""WITH {ATTACKS}, n AS (SELECT *, row_number() OVER (PARTITION BY comp_id, x, y ORDER BY beg) AS place FROM o), d AS (SELECT *, lag(off_) OVER (PARTITION BY comp_id, x, y ORDER BY beg) AS old FROM n WHERE place > 1),
        f AS (SELECT a.comp_id, a.t0, a.beg, coalesce(min(b.beg) - a.beg, 2592000) AS duration FROM d a LEFT JOIN d b ON b.comp_id = a.comp_id AND b.x = a.x AND b.y = a.y AND b.beg > a.beg AND NOT b.off_ WHERE a.off_ AND (a.old IS NULL OR NOT a.old) GROUP BY a.comp_id, a.x, a.y, a.t0, a.beg)
        SELECT comp_id, CAST(ceil((beg - t0) / 21600) AS INT) AS bin, count(*) AS n, round(avg(duration), 5) AS mean, round(quantile_cont(duration, 0.5) / ln(2), 5) AS median_ln2 FROM f GROUP BY 1, 2""",
    "t21_windowed_return_times": f"WITH {RETURNS} SELECT comp_id, x, y, bin, round(v, 6) AS return_time FROM returns",
    "t21_return_time_stats": f"""WITH {RETURNS}, o AS (SELECT *, count(*) OVER (PARTITION BY comp_id, bin) AS n, row_number() OVER (PARTITION BY comp_id, bin ORDER BY v) - 1 AS i FROM returns WHERE v IS NOT NULL),
        e AS (SELECT *, CASE WHEN n >= 10 THEN n - n // 10 ELSE 0 END AS edge FROM o), st AS (SELECT comp_id, bin, avg(v) AS mean, max(v) FILTER (WHERE i = n // 2) AS median, max(v) FILTER (WHERE i = edge) AS percentile, avg(v) FILTER (WHERE i >= edge) AS decile_mean FROM e GROUP BY 1, 2)
        SELECT b.comp_id, b.bin, {', '.join(f'coalesce(round({c}, 6), 0e0) AS {c}' for c in ('mean', 'median', 'percentile', 'decile_mean'))} FROM (SELECT DISTINCT comp_id, bin FROM returns) b LEFT JOIN st USING (comp_id, bin)""",
}
