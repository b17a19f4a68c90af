"""Registered queries on written and reread tables, and on the training table of many variables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.config import DAY, TEST_CANVAS
from pixelloom.operators import attack_defense as ad
from pixelloom.operators import changes, compositions, evaluation, state, training, transitions
from pixelloom.operators.training import Variable
from pixelloom.plans import composition_queries as comps
from pixelloom.plans import preparation_queries as prep
from pixelloom.plans.canvas_queries import rounded
from pixelloom.plans.series_queries import ABS, FOUND, REL, _runs, difference_series
from pixelloom.plans.state_queries import SQL_STATE, SW, WIDTH, State
from pixelloom.plans.storage import new_path, write_shared
from pixelloom.plans.training_queries import BASE, LONG, NAMES, TRUTH, Table, _auc, _simpson
from pixelloom.sources import adapter, atlas, raw_logs

FINE, COARSE = training.lag_ranges([1, 1, 2, 4]), training.lag_ranges([2, 6])
COUNTED = ("n_changes", "n_moderator", "n_cheat", "n_redundant_col", "n_redundant_colanduser", "n_users")
FOUGHT = ("n_attack", "n_defense", "n_attackonly_users", "n_bothattdef_users")
CHOSEN = [
    *(Variable(n) for n in COUNTED), *(Variable(n, coarse=True) for n in FOUGHT), Variable("off_share"), Variable("n_changes", ratio=True), Variable("n_users", ratio=True, coarse=True),
    Variable("off_share", ratio=True), Variable("n_attack", ratio=True, coarse=True), Variable("off_share", coarse=True, kendall=True),
]
FEATURES = [f"{v.column}_t_{a}_{b}" for v in CHOSEN for a, b in (COARSE if v.coarse else FINE)]
SEVERAL = [f"{c}_t_0_0" for c in (*COUNTED, "off_share")]
REJECTED, AT_MOST = 0.3, 5 * DAY


def variables(spark: SparkSession, sf_dir: str, s: State | None = None) -> DataFrame:
    """Eleven variables of every composition and bin, 0 where nothing happened. s: the state, if its log is written already.

    They are not written, so that what a query doesn't ask for isn't made: who reads them more than once writes them.
    """
    s = s or State(spark, sf_dir).shared_stays()
    every = state.life_bins(s.pixels, WIDTH).select("comp_id", F.explode(F.sequence(F.lit(1), "n_bins")).alias("bin"))
    ref = write_shared(s.ref(), "ref")
    share = s.instant().join(ref, ["comp_id", "x", "y", "bin"]).groupBy("comp_id", "bin").agg(F.avg((F.col("inst") != F.col("ref")).cast("double")).alias("off_share"))
    key = ["comp_id", "bin"]
    wide = every.join(ad.counts_and_fights(s.changes, ref, WIDTH), key, "left").join(share, key, "left")
    return wide.na.fill(0).select(*key, *COUNTED, *FOUGHT, "off_share")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.choose_variables(variables(spark, sf_dir), CHOSEN, SW, FINE, COARSE)


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = comps.pixels(spark, sf_dir)
    placed = compositions.section_of_pixels(pixels, adapter.sections(spark)).groupBy("comp_id").agg(F.min("section").alias("section"))
    life = pixels.groupBy("comp_id").agg(F.countDistinct("x", "y").alias("area"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return life.join(placed, "comp_id").withColumn("n_bins", F.ceil((F.col("t1") - F.col("t0")) / WIDTH).cast("int"))


def unsigned(rows: DataFrame) -> DataFrame:
    """-0.0 as 0.0 in all columns but the first two."""
    return rows.select(*rows.columns[:2], *((F.col(c) + 0.0).alias(c) for c in rows.columns[2:]))


def timed(rows: DataFrame, info: DataFrame) -> DataFrame:
    life = info.select("comp_id", "t0", "t1")
    return rows.join(life, "comp_id").withColumn("t", F.least(F.col("t0") + F.col("bin") * WIDTH, "t1")).drop("t0", "t1")


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first days of the times that overlaps reject: neighbours share a third of their pixels for all of their lives."""
    return compositions.rejected_overlaps(comps.pixels(spark, sf_dir), REJECTED).withColumn("t1", F.least("t1", F.col("t0") + AT_MOST))


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, about = Table(spark, sf_dir), info(spark, sf_dir)
    began = t.transitions.join(about, "comp_id").select("comp_id", (F.col("t0") + F.col("bin_beg") * WIDTH).alias("t_start"))
    stable = comps.stable_ranges(spark, sf_dir)
    active = compositions.active_area(comps.split_pixels(spark, sf_dir), WIDTH)
    return training.training_rows(timed(t.rows, about), about, began, stable, rejected(spark, sf_dir), active, (ABS, REL), SW * WIDTH, 2 * WIDTH, 6, TEST_CANVAS.greyout)


def _rows_over(cut: float):
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = write_shared(difference_series(spark, sf_dir), "difference")
        spans = transitions.runs(rows, F.col("val") > cut, ["comp_id"]).select("comp_id", F.col("beg").alias("bin_beg"), F.col("fin").alias("bin_end"))
        last = rows.groupBy("comp_id").agg(F.max("bin").alias("n_bins"))
        near = spans.withColumn("bin_end", F.col("bin_end") + 1).unionByName(spans)  # each run once more, one bin longer: the same period before
        return transitions.merge_same_periods(transitions.with_periods(near, SW, last))

    return found


def _ranks(t: Table) -> DataFrame:
    return evaluation.variable_ranks(t.attributions().select("comp_id", "bin", F.col("feature").alias("variable"), "attribution", "value"))


def _matrix(t: Table) -> DataFrame:
    return training.correlation_matrix(t.features().na.fill(0.0), NAMES)


def _of(make):
    return lambda spark, sf_dir: make(Table(spark, sf_dir))


def _csv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "old-log")
    prep._old(spark, sf_dir).write.csv(path, header=True)
    return rounded(raw_logs.clean_old_log(raw_logs.read_old_csv(spark, path), "2024-01-02 00:00:00", "2024-01-20 12:00:00"), "seconds", digits=3)


def _line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines written as text of a header and one kind of event each, read again and numbered by kind and place. A kind is stored in parts, in the order of their names, so that no task writes it all."""
    path = new_path(spark, "raw-lines")
    lines = prep.raw_lines(spark, sf_dir).withColumn("file", F.col("event_id") % 3).select("file", "event_id", "line")
    head = spark.range(3).select(F.col("id").alias("file"), F.lit(-1).cast("long").alias("event_id"), F.lit("timestamp,user_id,pixel_color,coordinate").alias("line"))
    ordered = lines.unionByName(head).repartitionByRange("file", "event_id").sortWithinPartitions("file", "event_id")
    ordered.select("file", F.col("line").alias("value")).write.partitionBy("file").option("maxRecordsPerFile", 0).text(path)
    parts = raw_logs.read_lines(spark, path).withColumn("ordinal", F.struct("file", "ordinal")).withColumn("file", F.regexp_extract("file", r"/(file=\d+)/", 1))
    numbered = raw_logs.event_numbers(raw_logs.parse_lines(parts, prep.ORIGIN))
    return raw_logs.expand_shapes(numbered).select("event_id", F.round("seconds", 3).alias("seconds"), "user_hash", "hex", "x", "y", "moderator")


def _atlas_file(repaired: bool):
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_path(spark, "atlas")
        broken = comps.nested(spark, sf_dir).withColumn("path", F.transform_keys("path", lambda k, _: F.when(k == "T:0-1", "T").otherwise(k)))
        broken.write.option("maxRecordsPerFile", 1).json(path)  # one entry a file, as an atlas is one value
        found = atlas.read_atlas(spark, path)
        found = atlas.repair(found, ["c3"]) if repaired else found
        return found.select("id", "name", F.size("path").alias("n_borders"), F.array_join(F.array_sort(F.map_keys("path")), ";").alias("times"))

    return read


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "log")
    events = write_shared(prep._events(spark, sf_dir), "events")
    colors, users = raw_logs.dense_colors(events), raw_logs.dense_users(events)
    raw_logs.write_dictionaries(colors, users, path)
    raw_logs.write_log(raw_logs.condense(events, colors, users), f"{path}/log", DAY)
    log = raw_logs.read_log(spark, f"{path}/log", 10 * DAY)
    names = raw_logs.read_dictionary(spark, path, "user", "user").join(log, "user").join(raw_logs.read_dictionary(spark, path, "color", "color"), "color")
    return names.select("event_id", "seconds", "x", "y", "user_hash", "hex", "moderator")


def _runs_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "runs")
    s = State(spark, sf_dir)
    atlas.write_runs({f"w{h}": changes.change_counts(s.changes, h * 3600.0).select("comp_id", "bin", "n_changes", "n_users") for h in (6, 24)}, path)
    return atlas.read_runs(spark, path).select("param", "comp_id", "bin", "n_changes", "n_users")


def _communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "scaling")
    n = F.substring("comp_id", 2, 9).cast("int")
    counted = changes.change_counts(State(spark, sf_dir).changes, DAY).groupBy("comp_id").agg(F.sum("n_changes").alias("n_changes"))
    atlas.write_scaling(counted.select("comp_id", "n_changes", (n % 3 == 0).alias("streamer"), (n % 2 == 0).alias("alliance")), path)
    parts = atlas.read_scaling(spark, path, "comp_id string, n_changes bigint, streamer boolean, alliance boolean")
    kinds = [part.select(F.lit(kind).alias("kind"), "comp_id", "n_changes") for kind, part in parts.items()]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "heat-map")
    heat = adapter.pixel_log(spark, sf_dir).groupBy("x", "y").agg(F.count("*").alias("n"))
    atlas.write_result(heat, path)
    return spark.read.schema("x int, y int, n bigint").json(f"{path}/json").join(spark.read.parquet(f"{path}/parquet").select("x", "y", F.col("n").alias("n_parquet")), ["x", "y"])


AUC = ("tpr", "fpr", "purity", "f1", "accuracy")
MINUS = [-0.9, -0.6, -0.45, -0.3, -0.1]
CALM = {"val_t_0_0": 0.6, "val_t_1_1": 0.55, "val_t_2_3": 0.5}

QUERIES = {
    "s3_csv_log": _csv_log,
    "s6_atlas_file": _atlas_file(False),
    "s7_repaired_atlas": _atlas_file(True),
    "s8_stored_log": _stored,
    "s9_runs_of_jobs": _runs_of_jobs,
    "s10_communities": _communities,
    "s11_exported_heat_map": _export,
    "p7_event_numbers": _line_files,
    "d2_chosen_variables": lambda s, d: unsigned(rounded(features(s, d), *FEATURES)),
    "d3_extra_features": lambda s, d: rounded(
        training.extra_features(timed(variables(s, d), info(s, d)), info(s, d), compositions.placement(comps.pixels(s, d), adapter.sections(s), 1), ["off_share", "n_changes"], SW), "log_area", "off_share_sw", "n_changes_sw"),
    "d5_training_rows": _training_rows,
    "d6_recovered_rejects": lambda s, d: training.recovered_rejects(comps.pixels(s, d).where("comp_id like 'c1%'"), rejected(s, d)),
    "d8_clean_features": lambda s, d: (lambda x: unsigned(rounded(x, *x.columns[2:])))(training.clean_features(features(s, d), [], ["n_cheat", "n_moderator"], {"n_users": ["0_0", "4_7"]}, ["off_share_ratio", "n_changes_ratio"])),
    "d13_correlation_matrix": lambda s, d: rounded(training.correlation_matrix(write_shared(features(s, d).na.fill(0.0).select("comp_id", "bin", *SEVERAL), "features"), SEVERAL), "correlation"),
    "d13_variable_correlations": _of(lambda t: rounded(training.variable_correlations(_matrix(t)), "correlation")),
    "x4_merged_periods": _rows_over(ABS),
    "e4_precision_recall_area": _of(lambda t: rounded(evaluation.precision_recall_area(evaluation.threshold_counts(t.predictions(), TRUTH, [4.0, 8.0, 12.0, 16.0, 20.0])), "pr_auc")),
    "e4_fpr_at_tpr": _of(lambda t: rounded(evaluation.fpr_at_tpr(evaluation.threshold_counts(t.predictions(), TRUTH, [4.0, 8.0, 12.0, 16.0, 20.0]), 0.5), "fpr")),
    "e6_single_variables": _of(lambda t: rounded(evaluation.single_variables(t.features(), t.labelled(), NAMES, TRUTH, MINUS), *AUC)),
    "e6_single_variable_areas": _of(lambda t: rounded(evaluation.roc_area(evaluation.single_variables(t.features(), t.labelled(), NAMES, TRUTH, MINUS), ("feature",)), "auc")),
    "e17_correlated_groups": _of(lambda t: evaluation.correlated_groups(_matrix(t), _ranks(t), 0.8)),
    "e19_least_useful": _of(lambda t: t.rows.sparkSession.createDataFrame([(i, f) for i, f in enumerate(evaluation.least_useful(t.attributions(), _matrix(t), 3, 0.9))], "place int, feature string")),
    "e20_calm_rows": _of(lambda t: evaluation.calm_rows(t.features(), CALM)),
}

VARIABLES = f"""{SQL_STATE}, n AS (SELECT comp_id, bin, count(*) AS n_changes, count(*) FILTER (WHERE moderator) AS n_moderator, count(*) FILTER (WHERE cooldown_cheat) AS n_cheat,
        count(*) FILTER (WHERE redundant_col) AS n_redundant_col, count(*) FILTER (WHERE redundant_colanduser) AS n_redundant_colanduser, count(DISTINCT "user") AS n_users FROM binned GROUP BY 1, 2),
    share AS (SELECT comp_id, bin, avg(CASE WHEN inst <> ref THEN 1e0 ELSE 0 END) AS off_share FROM instant JOIN ref USING (comp_id, x, y, bin) GROUP BY 1, 2),
    u AS (SELECT comp_id, bin, "user", count(*) FILTER (WHERE defense) AS d, count(*) FILTER (WHERE NOT defense) AS a FROM agreed GROUP BY 1, 2, 3),
    att AS (SELECT comp_id, bin, sum(a) AS n_attack, sum(d) AS n_defense, count(*) FILTER (WHERE d = 0) AS n_attackonly_users, count(*) FILTER (WHERE a > 0 AND d > 0) AS n_bothattdef_users FROM u GROUP BY 1, 2),
    variables AS (SELECT b.comp_id, b.bin, b.t0, b.t1, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*COUNTED, *FOUGHT, 'off_share'))} FROM bins b LEFT JOIN n USING (comp_id, bin) LEFT JOIN share USING (comp_id, bin) LEFT JOIN att USING (comp_id, bin))"""


def _frame(a: int, b: int) -> str:
    return f"OVER (PARTITION BY comp_id ORDER BY bin ROWS BETWEEN {b} PRECEDING AND {f'{a} PRECEDING' if a else 'CURRENT ROW'})"


def _value(v: Variable) -> str:
    if v.kendall:
        return v.column
    mean = f"coalesce(avg({v.name}) OVER (PARTITION BY comp_id ORDER BY bin ROWS BETWEEN {SW} PRECEDING AND 1 PRECEDING), {v.name})"
    return f"CASE WHEN {mean} = 0 THEN 1.0 ELSE {v.name} / {mean} END" if v.ratio else f"CAST({v.name} AS DOUBLE)"


CHOOSE = f"""{VARIABLES}, taus AS (SELECT a.*, CASE WHEN m > 1 THEN 2.0 * s / (n * n * (m - 1e0) / m) ELSE 0 END AS off_share_tau FROM (SELECT a.*,
            (SELECT count(*) FROM variables c WHERE c.comp_id = a.comp_id AND c.bin BETWEEN a.bin - 9 AND a.bin) AS n, (SELECT count(DISTINCT off_share) FROM variables c WHERE c.comp_id = a.comp_id AND c.bin BETWEEN a.bin - 9 AND a.bin) AS m,
            (SELECT coalesce(sum(sign(d.off_share - c.off_share)), 0) FROM variables c JOIN variables d ON c.comp_id = d.comp_id AND c.bin < d.bin WHERE c.comp_id = a.comp_id AND c.bin >= a.bin - 9 AND d.bin <= a.bin) AS s FROM variables a) a),
    ready AS (SELECT comp_id, bin, {', '.join(f'{_value(v)} AS {v.column}' for v in CHOSEN)} FROM taus),
    feats AS (SELECT comp_id, bin, {', '.join(f'avg({v.column}) {_frame(a, b)} AS {v.column}_t_{a}_{b}' for v in CHOSEN for a, b in (COARSE if v.coarse else FINE))} FROM ready)"""
CLEAN = [n for n in FEATURES if not n.startswith(("n_cheat_t", "n_moderator_t")) and n not in ("n_users_t_1_1", "n_users_t_2_3")]


def _correlation(a: str, b: str) -> str:
    return f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 1e-12 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) ELSE 0 END"


def _pairs(names: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_correlation(f'coalesce({a}, 0)', f'coalesce({b}, 0)')} AS correlation FROM {source}" for a in sorted(names) for b in sorted(names) if a < b)


NESTED = f"{comps.SQL_PIXELS}, n AS (SELECT comp_id, CAST(comp_id[2:] AS INT) AS n FROM borders)"
TIMES = "(n + 1) || '-' || (n + 4) || ';' || (n + 6) || ', T, ' || (n + 9)"
SORTED = f"array_to_string(list_sort(string_split({TIMES}, ';')), ';')"
NAME = "CASE WHEN n % 3 = 0 THEN 'Flag of ' ELSE 'Twitch streamer ' END || comp_id AS name"
SINGLE = f"""{BASE}, long_ AS (SELECT comp_id, bin, feature, value FROM (UNPIVOT feats ON {', '.join(NAMES)} INTO NAME feature VALUE value)),
    single AS (SELECT feature, CAST(label AS DOUBLE) AS true_s, -value AS pred_s FROM long_ JOIN labelled USING (comp_id, bin) WHERE value IS NOT NULL),
    counts AS (SELECT feature, i, cut, tp, fp, nb - fp AS tn, ps - tp AS fn, tp / nullif(ps, 0) AS tpr, fp / nullif(nb, 0) AS fpr, tp / nullif(tp + fp, 0) AS purity, 2 * tp / nullif(2 * tp + fp + ps - tp, 0) AS f1, (tp + nb - fp) / nullif(ps + nb, 0) AS accuracy
        FROM (SELECT feature, i, cut, count(*) FILTER (WHERE pred_s < cut AND true_s < 8) AS tp, count(*) FILTER (WHERE pred_s < cut AND true_s >= 8) AS fp, count(*) FILTER (WHERE true_s < 8) AS ps, count(*) FILTER (WHERE true_s >= 8) AS nb
            FROM single, (VALUES {', '.join(f'({i}, {c}e0)' for i, c in enumerate(MINUS))}) g(i, cut) GROUP BY ALL))"""
COUNTS = """counts AS (SELECT i, tp / nullif(ps, 0) AS tpr, fp / nullif(nb, 0) AS fpr, tp / nullif(tp + fp, 0) AS purity FROM (SELECT i, count(*) FILTER (WHERE pred_s < cut AND true_s < 8) AS tp,
    count(*) FILTER (WHERE pred_s < cut AND true_s >= 8) AS fp, count(*) FILTER (WHERE true_s < 8) AS ps, count(*) FILTER (WHERE true_s >= 8) AS nb FROM pred, (VALUES (0, 4e0), (1, 8e0), (2, 12e0), (3, 16e0), (4, 20e0)) g(i, cut) GROUP BY i))"""
REJECTS = comps._rejects("pixels", REJECTED).replace("least(p.t1, o1) AS t1", "least(p.t1, o1, greatest(p.t0, o0) + 432000) AS t1")
NUMBER = "CAST(comp_id[2:] AS INT)"

ORACLES = {
    "s3_csv_log": prep.ORACLES["p11_old_log"],
    "s6_atlas_file": f"WITH {NESTED} SELECT comp_id AS id, {NAME}, CASE WHEN n = 0 THEN 1 ELSE 2 END AS n_borders, CASE WHEN n = 0 THEN 'T' ELSE {SORTED} END AS times FROM n",
    "s7_repaired_atlas": f"WITH {NESTED} SELECT comp_id AS id, {NAME}, CASE WHEN n = 0 THEN 1 ELSE 2 END AS n_borders, CASE WHEN n = 0 THEN 'T:0-1' ELSE {SORTED} END AS times FROM n WHERE n <> 3",
    "s8_stored_log": f"WITH {prep.RECT} SELECT event_id, seconds, x, y, user_hash, hex, moderator FROM events WHERE seconds < 864000",
    "s9_runs_of_jobs": f"""WITH {SQL_STATE} SELECT 'w' || h AS param, comp_id, CAST(ceil((seconds - t0) / (h * 3600)) AS INT) AS bin, count(*) AS n_changes, count(DISTINCT "user") AS n_users FROM changes, (VALUES (6), (24)) w(h) WHERE active GROUP BY 1, 2, 3""",
    "s10_communities": f"""WITH {SQL_STATE} SELECT CASE WHEN {NUMBER} % 3 = 0 THEN 'streamer' WHEN {NUMBER} % 2 = 0 THEN 'alliance' ELSE 'other' END AS kind, comp_id, count(*) AS n_changes FROM changes WHERE active GROUP BY comp_id""",
    "s11_exported_heat_map": f"WITH {comps.SQL_PIXELS.split('borders AS')[0]}{prep.SQL_LOG} SELECT x, y, count(*) AS n, count(*) AS n_parquet FROM log GROUP BY 1, 2",
    "p7_event_numbers": f"""WITH {prep.RECT}, o AS (SELECT event_id, (event_id % 3) * 10000000 + row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1 AS no FROM raw)
        SELECT no AS event_id, round(seconds, 3) AS seconds, user_hash, hex, x, y, moderator FROM events JOIN o USING (event_id)""",
    "d2_chosen_variables": f"WITH {CHOOSE} SELECT comp_id, bin, {', '.join(f'round({n}, 6) + 0e0 AS {n}' for n in FEATURES)} FROM feats",
    "d3_extra_features": f"""WITH {VARIABLES}, s AS (SELECT comp_id, count(DISTINCT (x, y)) AS area, min(CASE WHEN x <= 4 THEN 0 ELSE 1 END) AS section FROM pixels GROUP BY 1),
        f AS (SELECT comp_id, section, (x0 < 1 OR hi - x1 < 1) AS sx, (y0 < 1 OR 9 - y1 < 1) AS sy, (x0 < hi / 2 + 1 AND x1 > hi / 2 - 1 AND y0 < 5.5 AND y1 > 3.5) AS mid FROM borders JOIN s USING (comp_id), LATERAL (SELECT CASE WHEN section = 0 THEN 4 ELSE 9 END AS hi))
        SELECT v.comp_id, bin, round(log10(area), 6) AS log_area, least(bin * 21600e0, v.t1 - v.t0) AS age, section, CAST(sx OR sy AS INT) + CAST(sx AND sy AS INT) + CAST(mid AS INT) AS position,
            round(avg(off_share) OVER w, 6) AS off_share_sw, round(avg(n_changes) OVER w, 6) AS n_changes_sw FROM variables v JOIN s USING (comp_id) JOIN f USING (comp_id, section) WINDOW w AS (PARTITION BY v.comp_id ORDER BY bin ROWS BETWEEN {SW} PRECEDING AND 1 PRECEDING)""",
    "d5_training_rows": f"""WITH {FOUND}, {REJECTS}, r AS (SELECT r.comp_id, r.bin, val, ratio, least(b.t0 + bin * 21600, b.t1) AS t, b.t0, b.t1, (x1 - x0 + 1) * (y1 - y0 + 1) AS area, ceil((b.t1 - b.t0) / 21600) AS n_bins FROM rows_ r JOIN borders b USING (comp_id)),
        st AS (SELECT comp_id, t0 AS s0, t1 AS s1 FROM settled),
        tr AS (SELECT comp_id, t0 + bin_beg * 21600 AS t_start FROM found JOIN borders USING (comp_id)),
        halves AS (SELECT comp_id, x, t0, (t0 + t1) / 2 AS t1 FROM pixels UNION ALL SELECT comp_id, x, (t0 + t1) / 2 + CASE WHEN x % 2 = 1 THEN 86400 ELSE 0 END, t1 FROM pixels)
        SELECT comp_id, bin, t > t0 + 10 * 21600 AS safe_start, NOT EXISTS (SELECT 1 FROM tr WHERE tr.comp_id = r.comp_id AND r.t >= t_start AND r.t < t_start + 10 * 21600) AS safe_trans FROM r
        WHERE area >= 6 AND t > t0 + 8 * 21600 AND t < t1 AND t <= 28 * 86400 AND bin < n_bins AND (val < {ABS} OR ratio < {REL})
            AND EXISTS (SELECT 1 FROM st WHERE st.comp_id = r.comp_id AND r.t >= s0 + 10 * 21600 AND r.t <= s1) AND NOT EXISTS (SELECT 1 FROM rejects x WHERE x.comp_id = r.comp_id AND r.t BETWEEN x.t0 AND x.t1)
            AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.comp_id = r.comp_id AND r.t >= t_start AND r.t < t_start + 8 * 21600)
            AND EXISTS (SELECT 1 FROM halves h WHERE h.comp_id = r.comp_id AND h.t0 < r.t0 + bin * 21600 AND h.t1 > r.t0 + (bin - 1) * 21600)""",
    "d6_recovered_rejects": f"WITH {comps.SQL_PIXELS}, {REJECTS} SELECT * FROM rejects WHERE comp_id LIKE 'c1%'",
    "d8_clean_features": f"WITH {CHOOSE} SELECT comp_id, bin, " + ", ".join(
        f"round(CASE WHEN abs(coalesce({n}, 0)) > 1 THEN 1 ELSE coalesce({n}, 0) END, 6) AS {n}" if n.startswith(("off_share_ratio_t", "n_changes_ratio_t")) else f"round(coalesce({n}, 0), 6) + 0e0 AS {n}" for n in CLEAN) + " FROM feats",
    "d13_correlation_matrix": f"WITH {VARIABLES}, f AS (SELECT {', '.join(f'CAST({n[:-6]} AS DOUBLE) AS {n}' for n in SEVERAL)} FROM variables) SELECT a, b, round(correlation, 6) AS correlation FROM ({_pairs(SEVERAL, 'f')})",
    "d13_variable_correlations": f"WITH {BASE} SELECT split_part(a, '_t_', 1) AS a, split_part(b, '_t_', 1) AS b, round(avg(correlation), 6) AS correlation FROM ({_pairs(NAMES, 'feats')}) WHERE split_part(a, '_t_', 2) = split_part(b, '_t_', 2) GROUP BY 1, 2",
    "x4_merged_periods": f"""WITH {FOUND}, spans_ AS ({_runs(f'val > {ABS}')}), every AS (SELECT comp_id, beg, fin FROM spans_ UNION ALL SELECT comp_id, beg, fin + 1 FROM spans_)
        SELECT comp_id, greatest(beg - 8, 1) AS pre_beg, beg AS pre_end, min(beg) AS bin_beg, max(fin) AS bin_end, max(fin) AS post_beg, max(least(fin + 8, n)) AS post_end
        FROM every JOIN (SELECT comp_id, max(bin) AS n FROM rows_ GROUP BY 1) USING (comp_id) GROUP BY 1, 2, 3""",
    "e4_precision_recall_area": f"""WITH {BASE}, {COUNTS}, c AS (SELECT i, tpr AS x, purity AS y FROM counts UNION ALL SELECT -1, 0, NULL UNION ALL SELECT 9, 1, (SELECT avg(CASE WHEN true_s < 8 THEN 1e0 ELSE 0 END) FROM pred)),
        m AS (SELECT i, x, coalesce(y, CASE WHEN i < 2 THEN (SELECT arg_min(y, i) FROM c WHERE y IS NOT NULL) ELSE (SELECT arg_max(y, i) FROM c WHERE y IS NOT NULL) END) AS y FROM c),
        points AS (SELECT row_number() OVER (ORDER BY i) - 1 AS k, x, CASE WHEN y < 1e-10 THEN 1 ELSE y END AS y FROM m) SELECT round(area, 6) AS pr_auc FROM ({_simpson('points')})""",
    "e4_fpr_at_tpr": f"""WITH {BASE}, {COUNTS} SELECT round(coalesce(l.fpr + (h.fpr - l.fpr) * (0.5 - l.tpr) / (h.tpr - l.tpr), h.fpr, l.fpr), 6) AS fpr FROM (SELECT max((tpr, fpr)) FILTER (WHERE tpr < 0.5) AS lo, min((tpr, fpr)) FILTER (WHERE tpr >= 0.5) AS hi FROM counts),
        LATERAL (SELECT lo[1] AS tpr, lo[2] AS fpr) l, LATERAL (SELECT hi[1] AS tpr, hi[2] AS fpr) h""",
    "e6_single_variables": f"WITH {SINGLE} SELECT feature, i, cut, tp, fp, tn, fn, {', '.join(f'round({n}, 6) AS {n}' for n in AUC)} FROM counts",
    "e6_single_variable_areas": f"WITH {SINGLE}, {_auc('feature')}",
    "e17_correlated_groups": f"""WITH RECURSIVE {LONG}, matrix AS ({_pairs(NAMES, 'feats')}), link AS (SELECT a, b FROM matrix WHERE abs(correlation) > 0.8 UNION SELECT b, a FROM matrix WHERE abs(correlation) > 0.8),
        reach AS (SELECT a AS feature, a AS other FROM link UNION SELECT r.feature, l.b FROM reach r JOIN link l ON l.a = r.other), grp AS (SELECT feature, min(other) AS g FROM reach GROUP BY 1),
        own AS (SELECT comp_id, feature, row_number() OVER (PARTITION BY comp_id ORDER BY round(avg(abs(attribution)), 9) DESC, feature) AS rank FROM attr GROUP BY 1, 2)
        SELECT comp_id, g AS "group", n_variables, row_number() OVER (PARTITION BY comp_id ORDER BY best) AS rank FROM (SELECT comp_id, coalesce(g, o.feature) AS g, min(rank) AS best, count(*) AS n_variables FROM own o LEFT JOIN grp USING (feature) GROUP BY 1, 2)""",
    "e20_calm_rows": f"WITH {BASE} SELECT comp_id, bin FROM feats WHERE {' AND '.join(f'{k} < {v}' for k, v in CALM.items())}",
}
