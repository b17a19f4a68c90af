"""The training table: lag-range features, labels, filters, weights, splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.functions.columns import hash_unit, safe_ratio
from pixelloom.operators import series


def lag_ranges(widths: list[int]) -> list[tuple[int, int]]:
    """Consecutive ranges of bins back in time with the given widths: (0, 0), (1, 1), (2, 3), ..."""
    found, start = [], 0
    for w in widths:
        found.append((start, start + w - 1))
        start += w
    return found


def feature_windows(rows: DataFrame, names: list[str], ranges: list[tuple[int, int]]) -> DataFrame:
    """Mean of each variable over each range of bins back, `<name>_t_<a>_<b>`; one window for all."""
    order = Window.partitionBy("comp_id").orderBy("bin")
    made = {f"{n}_t_{a}_{b}": F.avg(n).over(order.rowsBetween(-b, -a)) for n in names for a, b in ranges}
    return rows.select("comp_id", "bin", *(c.alias(n) for n, c in made.items()))


def labels(rows: DataFrame, transitions: DataFrame, cap: int) -> DataFrame:
    """Bins to the composition's next transition, `cap` at most or without one."""
    marks = rows.select("comp_id", "bin", F.lit(None).cast("int").alias("next")).unionByName(transitions.select("comp_id", F.col("bin_beg").alias("bin"), F.col("bin_beg").alias("next")))
    ahead = Window.partitionBy("comp_id").orderBy("bin").rangeBetween(0, Window.unboundedFollowing)
    reach = marks.withColumn("ahead", F.min("next").over(ahead)).where("next is null")
    return reach.select("comp_id", "bin", F.coalesce(F.least(F.col("ahead") - F.col("bin"), F.lit(cap)), F.lit(cap)).alias("label"))


def stable_rows(rows: DataFrame, transitions: DataFrame, area: DataFrame, least_area: int, last_bin: int) -> DataFrame:
    """Rows of large compositions, outside transitions and before `last_bin`; `safe_start`: at least a window after the last transition."""
    large = rows.join(area.where(F.col("area") >= least_area), "comp_id", "left_semi").where(F.col("bin") < last_bin)
    spans = transitions.select("comp_id", "bin_beg", "bin_end")
    inside = large.join(spans, "comp_id").where("bin >= bin_beg and bin < bin_end").select("comp_id", "bin").distinct()
    return large.join(inside, ["comp_id", "bin"], "left_anti")


def transformed(label: Column) -> Column:
    return F.log10(label + 100) - 1.5


def restored(value: Column) -> Column:
    return F.pow(F.lit(10.0), value + 1.5) - 100


def row_weights(label: Column, flat: float, cap: float, least: float) -> Column:
    """1 up to `flat`, then a power law down to `least` at `cap`."""
    power = F.log(F.lit(least)) / F.log(F.lit(cap / flat))
    return F.when(label <= flat, F.lit(1.0)).otherwise(F.pow(F.greatest(label, F.lit(flat)) / flat, power))


def split_by_composition(rows: DataFrame, test_share: float, seed: int = 0) -> DataFrame:
    """Add `is_test`: all rows of a composition are on one side."""
    return rows.withColumn("is_test", hash_unit(F.col("comp_id"), seed=seed) < test_share)


def split_by_ids(rows: DataFrame, test_ids: DataFrame) -> DataFrame:
    """Add `is_test`: the rows of the compositions of a stored list (comp_id), so that later runs are tested on the same ones. Ids without rows change nothing."""
    listed = test_ids.select("comp_id").distinct().withColumn("is_test", F.lit(True))
    return rows.join(listed, "comp_id", "left").na.fill(False, ["is_test"])


def down_sampled(rows: DataFrame, most_train: int, most_test: int, seed: int = 0) -> DataFrame:
    """`rows` (comp_id, bin, is_test, ...) with as many of either part as asked, or all if there are fewer: those with the smallest hashes.

    Hashes are cut at a value found from their counts in 4096 parts, and only the rows of the part that the limit falls into are ranked.
    """
    draw = hash_unit(F.col("comp_id"), F.col("bin"), seed=seed)
    placed = rows.withColumns({"draw": draw, "part": F.floor(draw * 4096).cast("int")})
    counts = placed.groupBy("is_test", "part").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("is_test").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limit = F.when(F.col("is_test"), F.lit(most_test)).otherwise(F.lit(most_train))
    room = counts.select("is_test", "part", "held", (limit - before).alias("room")).where("room > 0")
    inside = placed.join(room, ["is_test", "part"])
    whole = inside.where("held <= room")
    rank = F.row_number().over(Window.partitionBy("is_test", "part").orderBy("draw", "comp_id", "bin"))
    partly = inside.where("held > room").withColumn("rank", rank).where("rank <= room").drop("rank")
    return whole.unionByName(partly).drop("draw", "part", "held", "room")


def with_random_features(rows: DataFrame, n: int) -> DataFrame:
    """Add uniform and normal numbers that depend on the row only."""
    u = lambda i: hash_unit(F.col("comp_id"), F.col("bin"), seed=i)
    normal = lambda i: F.sqrt(-2 * F.log(1 - u(100 + i))) * F.cos(2 * 3.141592653589793 * u(200 + i))
    return rows.withColumns({f"uniform_{i}": u(i) for i in range(n)} | {f"normal_{i}": normal(i) for i in range(n)})


def correlations(rows: DataFrame, names: list[str], target: str) -> DataFrame:
    """Correlation of each feature with the target, in one pass; 0 where one of them is constant."""
    spread = lambda n: F.stddev_pop(n) * F.stddev_pop(target)
    wide = rows.agg(*(F.when(spread(n) > 1e-12, F.covar_pop(n, target) / spread(n)).otherwise(0.0).alias(n) for n in names))
    return wide.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("feature", "correlation"))


def feature_relation(rows: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Mean of y and its standard error in bins of x."""
    return rows.groupBy(F.floor(F.col(x) / width).cast("int").alias("x_bin")).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean_y"), F.when(F.count("*") > 1, F.stddev_samp(y) / F.sqrt(F.count("*"))).alias("error_y")
    )


@dataclass(frozen=True)
class Variable:
    """A variable of the training table: as it is or over the mean of the window before, its Kendall tau instead, and whether only coarse time ranges are wanted."""

    name: str
    ratio: bool = False
    coarse: bool = False
    kendall: bool = False

    @property
    def column(self) -> str:
        return self.name + ("_ratio" if self.ratio else "") + ("_tau" if self.kendall else "")


def choose_variables(rows: DataFrame, chosen: list[Variable], window: int, fine: list[tuple[int, int]], coarse: list[tuple[int, int]]) -> DataFrame:
    """The features of `chosen` variables from rows (comp_id, bin, a column for each name): means over time ranges, `<column>_t_<a>_<b>`."""
    order = Window.partitionBy("comp_id").orderBy("bin")
    base = lambda n: F.coalesce(F.avg(n).over(order.rowsBetween(-window, -1)), F.col(n))
    made = {v.column: safe_ratio(F.col(v.name), base(v.name), 1.0, 1.0) if v.ratio else F.col(v.name) for v in chosen if not v.kendall}
    ranked = {v.column: v.name for v in chosen if v.kendall}
    ready = rows.select("comp_id", "bin", *(c.cast("double").alias(n) for n, c in made.items()), *(F.col(name).cast("double").alias(n) for n, name in ranked.items()))
    for n in ranked:  # in the rows' own order, so that they are read once
        ready = series.rolling_kendall(ready.withColumn("val", F.col(n)), keys=["comp_id"]).withColumn(n, F.col("tau")).drop("val", "tau")
    ranges = {v.column: coarse if v.coarse else fine for v in chosen}
    means = [F.avg(n).over(order.rowsBetween(-b, -a)).alias(f"{n}_t_{a}_{b}") for n, of in ranges.items() for a, b in of]
    return ready.select("comp_id", "bin", *means)


def extra_features(rows: DataFrame, info: DataFrame, places: DataFrame, window_mean: list[str], window: int) -> DataFrame:
    """log10 of the area, age, section, how many of border, corner and centre a composition is at in its section, and the given columns' means over the window before.

    rows: comp_id, bin, t and the columns; info: comp_id, area, t0, section; places: comp_id, section, at_border, in_corner, in_centre.
    """
    order = Window.partitionBy("comp_id").orderBy("bin").rowsBetween(-window, -1)
    importance = sum((F.col(c).cast("int") for c in ("in_corner", "in_centre")), F.col("at_border").cast("int"))
    means = [F.avg(c).over(order).alias(f"{c}_sw") for c in window_mean]
    placed = rows.select("comp_id", "bin", "t", *means).join(info, "comp_id").join(places.select("comp_id", "section", importance.alias("position")), ["comp_id", "section"])
    return placed.select("comp_id", "bin", F.log10("area").alias("log_area"), (F.col("t") - F.col("t0")).alias("age"), "section", "position", *(f"{c}_sw" for c in window_mean))


def training_rows(
    rows: DataFrame, info: DataFrame, transitions: DataFrame, stable: DataFrame, rejected: DataFrame, active: DataFrame,
    cuts: tuple[float, float], window: float, margin: float, least_area: int, end: float,
) -> DataFrame:
    """`(comp_id, bin, safe_start, safe_trans)` of the rows that may be learned from.

    Kept: compositions of `least_area`; later than `window` seconds after their start and before their end and the canvas's; not
    beyond both cuts of a transition, nor within the window after one began; in a stable border range since `window + margin`; outside the times that overlaps
    reject; with an active pixel; not in the last bin. `safe_start`, `safe_trans`: also `margin` later than the start, and than every transition's window.

    rows: comp_id, bin, t, val, ratio; info: comp_id, area, t0, t1, n_bins; transitions: comp_id, t_start; stable, rejected: comp_id, t0, t1; active: comp_id, bin, active_area.
    """
    key = ["comp_id", "bin"]
    kept = rows.join(info, "comp_id").where((F.col("area") >= least_area) & (F.col("t") > F.col("t0") + window) & (F.col("t") < F.col("t1")) & (F.col("t") <= end) & (F.col("bin") < F.col("n_bins")))
    kept = kept.where((F.col("val") < cuts[0]) | (F.col("ratio") < cuts[1])).join(active.where("active_area > 0").select(*key), key, "left_semi")
    since = F.col("t") - F.col("t_start")
    near = kept.join(transitions, "comp_id").where((since >= 0) & (since < window + margin)).groupBy(*key).agg(F.min(since).alias("since"))
    spans = lambda other: other.select("comp_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    calm = kept.join(spans(stable), "comp_id").where((F.col("t") >= F.col("s0") + margin + window) & (F.col("t") <= F.col("s1"))).select(*key).distinct()
    out = kept.join(spans(rejected), "comp_id").where((F.col("t") >= F.col("s0")) & (F.col("t") <= F.col("s1"))).select(*key).distinct()
    found = kept.join(calm, key, "left_semi").join(out, key, "left_anti").join(near, key, "left").where(F.coalesce(F.col("since") >= window, F.lit(True)))
    return found.select(*key, (F.col("t") > F.col("t0") + margin + window).alias("safe_start"), F.col("since").isNull().alias("safe_trans"))


def recovered_rejects(comps: DataFrame, rejected: DataFrame) -> DataFrame:
    """The times rejected in one run for the compositions of another, by id; compositions without any have none."""
    return comps.select("comp_id").distinct().join(rejected, "comp_id").select("comp_id", "t0", "t1")


def clean_features(rows: DataFrame, keep: list[str], drop: list[str], sparse: dict[str, list[str]], clip: list[str]) -> DataFrame:
    """The features of the variables in `keep` but not in `drop`, of those in `sparse` only at the given time ranges (`<a>_<b>`); null and NaN become 0, and variables
    in `clip` are 1 where they exceed 1 either way. An empty `keep` keeps all."""
    chosen = []
    for name in (c for c in rows.columns if "_t_" in c):
        variable, ranges = name.rsplit("_t_", 1)
        if (not keep or variable in keep) and variable not in drop and (variable not in sparse or ranges in sparse[variable]):
            value = F.coalesce(F.nanvl(F.col(name), F.lit(0.0)), F.lit(0.0))
            chosen.append((F.when(F.abs(value) > 1, 1.0).otherwise(value) if variable in clip else value).alias(name))
    return rows.select("comp_id", "bin", *chosen)


def correlation_matrix(rows: DataFrame, names: list[str]) -> DataFrame:
    """`(a, b, correlation)` of every pair of columns a < b by name; 0 where one is constant.

    The features are one vector, and tasks add up matrices of products, so hundreds of columns are as many columns as one. The matrix, a number a pair, comes to the driver.
    """
    names = sorted(names)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows.select(*(F.col(n).cast("double").alias(n) for n in names)))
    n = vectors.count()
    pairs = []
    if n > 1:
        deviation = vectors.agg(Summarizer.std(F.col("features")).alias("s")).first()["s"].toArray() * ((n - 1) / n) ** 0.5
        found = Correlation.corr(vectors, "features").first()[0].toArray()
        pairs = [(a, b, float(found[i, j]) if deviation[i] * deviation[j] > 1e-12 else 0.0) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    elif n:
        pairs = [(a, b, 0.0) for i, a in enumerate(names) for b in names[i + 1 :]]
    return rows.sparkSession.createDataFrame(pairs, "a string, b string, correlation double")


def variable_correlations(matrix: DataFrame) -> DataFrame:
    """Mean correlation of each pair of variables over the time ranges that both have."""
    variable, ranges = lambda c: F.regexp_extract(c, r"^(.*)_t_", 1), lambda c: F.regexp_extract(c, r"_t_(.*)$", 1)
    return matrix.where(ranges("a") == ranges("b")).groupBy(variable("a").alias("a"), variable("b").alias("b")).agg(F.avg("correlation").alias("correlation"))
