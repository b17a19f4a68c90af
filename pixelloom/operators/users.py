"""Users' attention and paths, and scaling of compositions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.operators.changes import TIME


def attention(changes: DataFrame, slot: float, whiteout: float, largest: bool = False) -> DataFrame:
    """Changes of each user over the slots of `slot` seconds from the composition's beginning to `whiteout`: mean, median, and mean over as many users as it has pixels.

    The last figure takes the least attentive users, as the surveyed work does, or the most attentive if `largest`. Needs t0 and the pixel's x, y. A
    composition that begins at `whiteout` or later has no slots, and nulls.
    """
    life = changes.groupBy("comp_id").agg(F.min("t0").alias("a"), F.countDistinct("x", "y").alias("n_pix"))
    per = changes.where("active").groupBy("comp_id", "user").agg(F.count("*").alias("n")).join(life, "comp_id")
    slots = (whiteout - F.col("a")) / slot
    valued = per.withColumn("attention", F.when(slots > 0, F.col("n") / F.when(slots > 0, slots)))
    order = Window.partitionBy("comp_id").orderBy(F.desc("n") if largest else F.col("n"), "user")
    ranked = valued.withColumn("i", F.row_number().over(order))
    return ranked.groupBy("comp_id").agg(
        F.avg("attention").alias("mean"), F.expr("percentile(attention, 0.5)").alias("median"), F.avg(F.when(F.col("i") <= F.col("n_pix"), F.col("attention"))).alias("pix_norm")
    )


def paths(changes: DataFrame) -> DataFrame:
    """Length, mean step, mean distance to the centre, session, mean time between edits and speed of each user in each composition; null for single edits."""
    user = Window.partitionBy("comp_id", "user")
    order = user.orderBy(*TIME)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(order), 2) + F.pow(F.col("y") - F.lag("y").over(order), 2))
    centre = F.sqrt(F.pow(F.col("x") - F.avg("x").over(user), 2) + F.pow(F.col("y") - F.avg("y").over(user), 2))
    moved = changes.where("active").withColumns({"step": step, "off": centre})
    session = F.max("seconds") - F.min("seconds")
    some = F.count("*") > 1
    return moved.groupBy("comp_id", "user").agg(
        F.count("*").alias("n_edits"),
        F.sum("step").alias("path_length"),
        F.avg("step").alias("mean_step"),
        F.when(some, F.avg("off")).alias("mean_off_centre"),
        F.when(some, session).alias("session"),
        F.when(some, session / (F.count("*") - 1)).alias("mean_gap"),
        F.when(some & (session > 0), F.sum("step") / session).alias("speed"),
    )


def recovery_times(rows: DataFrame, high: float, low: float) -> DataFrame:
    """Bins from the first value above `high` to the first later one below `low`; both must occur more than once."""
    first = rows.groupBy("comp_id").agg(F.min(F.when(F.col("val") > high, F.col("bin"))).alias("hit"), F.sum((F.col("val") > high).cast("int")).alias("n_hit"))
    later = rows.join(first, "comp_id").where("bin > hit and val < {}".format(low)).groupBy("comp_id").agg(F.min("bin").alias("back"), F.count("*").alias("n_back"))
    return first.join(later, "comp_id").where("n_hit > 1 and n_back > 1").select("comp_id", "hit", "back", (F.col("back") - F.col("hit")).alias("recovery"))


def scaling_table(counts: DataFrame, area: DataFrame, first_bins: int) -> DataFrame:
    """Life-time and first bins' changes and users of each composition, with area and density. counts: comp_id, bin, n_changes, n_users."""
    early = F.col("bin") <= first_bins
    sums = counts.groupBy("comp_id").agg(
        F.sum("n_changes").alias("changes"), F.sum(F.when(early, F.col("n_changes")).otherwise(0)).alias("changes_first"), F.avg("n_users").alias("mean_users"), F.count("*").alias("active_bins")
    )
    return area.join(sums, "comp_id", "left").select(
        "comp_id", "area", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("changes", "changes_first", "active_bins")), "mean_users", (F.coalesce("changes", F.lit(0)) / F.col("area")).alias("density")
    )


def survivorship(lives: DataFrame, ages: list[float], start_time: float, end_time: float, edges: list[float]) -> DataFrame:
    """Number and share of compositions alive at each age, by size class. lives: comp_id, area, t0, t1.

    Those that began after `start_time` and reached `end_time` are censored and left out.
    """
    cls = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        cls = F.when((F.col("area") >= edges[i]) & (F.col("area") < edges[i + 1]), i).otherwise(cls)
    kept = lives.where(~((F.col("t0") > start_time) & (F.col("t1") >= end_time))).withColumn("size_class", cls).where("size_class is not null")
    at = kept.withColumn("age", F.explode(F.array(*map(F.lit, ages))))
    alive = at.groupBy("size_class", "age").agg(F.sum((F.col("t1") - F.col("t0") > F.col("age")).cast("long")).alias("n"))
    first = F.first("n").over(Window.partitionBy("size_class").orderBy("age"))
    return alive.withColumn("share", F.when(first > 0, F.col("n") / first))


def log_bins(points: DataFrame, per_decade: int) -> DataFrame:
    """Points (x, y > 0) in bins of log10 x: number, means of the logs, standard error."""
    logs = points.where("x > 0 and y > 0").select(F.log10("x").alias("lx"), F.log10("y").alias("ly"))
    return logs.groupBy(F.floor(F.col("lx") * per_decade).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg("lx").alias("mean_x"), F.avg("ly").alias("mean_y"), F.expr("percentile(ly, 0.5)").alias("median_y"),
        F.when(F.count("*") > 1, F.stddev_samp("ly") / F.sqrt(F.count("*"))).alias("error_y"),
    )


def kernel_smooth(points: DataFrame, grid: list[float], bandwidth: float) -> DataFrame:
    """Gaussian-weighted mean of y at each grid point, with the effective number of points."""
    at = points.withColumn("at", F.explode(F.array(*map(F.lit, grid))))
    w = F.exp(-0.5 * F.pow((F.col("x") - F.col("at")) / bandwidth, 2))
    return at.withColumn("w", w).groupBy("at").agg(
        (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("smooth"), (F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w"))).alias("n_effective")
    )


def log_fits(points: DataFrame) -> DataFrame:
    """Ordinary and total least squares of log10 y on log10 x, R^2 and RMS error, in one pass of moments."""
    logs = points.where("x > 0 and y > 0").select(F.log10("x").alias("lx"), F.log10("y").alias("ly"))
    m = logs.agg(F.avg("lx").alias("mx"), F.avg("ly").alias("my"), F.var_pop("lx").alias("vx"), F.var_pop("ly").alias("vy"), F.covar_pop("lx", "ly").alias("c"), F.count("*").alias("n"))
    slope = F.col("c") / F.col("vx")
    d = F.col("vy") - F.col("vx")
    total = (d + F.sqrt(d * d + 4 * F.col("c") * F.col("c"))) / (2 * F.col("c"))
    return m.select(
        "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), total.alias("slope_total"), (F.col("my") - total * F.col("mx")).alias("intercept_total"),
        (slope * F.col("c") / F.col("vy")).alias("r2"), F.sqrt(F.greatest(F.col("vy") - slope * F.col("c"), F.lit(0.0))).alias("rms"),
    )


def two_segment_fit(points: DataFrame, breaks: list[float]) -> DataFrame:
    """The break of a continuous two-segment line that leaves the least square error, among `breaks`, with its slopes and intercept.

    For each break the least squares of y on x and max(x - break, 0) come from sums of products: one pass over points times breaks.
    """
    at = points.withColumn("brk", F.explode(F.array(*map(F.lit, breaks)))).withColumn("z", F.greatest(F.col("x") - F.col("brk"), F.lit(0.0)))
    cov = lambda a, b, n: F.covar_pop(a, b).alias(n)
    m = at.groupBy("brk").agg(F.avg("x").alias("mx"), F.avg("z").alias("mz"), F.avg("y").alias("my"), cov("x", "x", "xx"), cov("z", "z", "zz"), cov("x", "z", "xz"), cov("x", "y", "xy"), cov("z", "y", "zy"), cov("y", "y", "yy"))
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    ok = m.where(det > 1e-12)
    b1 = (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det
    b2 = (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det
    fit = ok.select("brk", b1.alias("slope"), (b1 + b2).alias("slope_after"), (F.col("my") - b1 * F.col("mx") - b2 * F.col("mz")).alias("intercept"), (F.col("yy") - b1 * F.col("xy") - b2 * F.col("zy")).alias("error"))
    return fit.agg(F.min_by(F.struct("brk", "slope", "slope_after", "intercept", "error"), F.struct(F.round("error", 9), "brk")).alias("f")).select("f.*")


def community_flags(atlas: DataFrame) -> DataFrame:
    """Whether an entry's text or links tell of a streamer, a flag, an alliance, a subreddit."""
    text = F.lower(F.concat_ws(" ", "name", "description"))
    return atlas.select(
        "id", (text.contains("stream") | text.contains("twitch")).alias("streamer"), text.contains("flag").alias("flag"), text.contains("alliance").alias("alliance"),
        F.coalesce(F.map_contains_key("links", "subreddit"), F.lit(False)).alias("subreddit"),
    )


def t_quantile(p: float, degrees: int) -> float:
    """The quantile of Student's t, by bisection of the distribution summed numerically; for a handful of calls on the driver."""
    log_c = math.lgamma((degrees + 1) / 2) - math.lgamma(degrees / 2) - 0.5 * math.log(degrees * math.pi)

    def below(t: float) -> float:  # t = sqrt(degrees) tan(a), where the density becomes a power of a cosine
        a, n = math.atan(t / math.sqrt(degrees)), 2000
        values = [math.cos(a * i / n) ** (degrees - 1) for i in range(n + 1)]
        simpson = a / n / 3 * (values[0] + values[-1] + 4 * sum(values[1:-1:2]) + 2 * sum(values[2:-1:2]))
        return 0.5 + math.exp(log_c) * math.sqrt(degrees) * simpson

    low, high = 0.0, 1e8
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def fit_intervals(points: DataFrame, level: float = 0.95) -> DataFrame:
    """The ordinary fit of `log_fits` with the confidence intervals of slope and intercept by Student's t."""
    logs = points.where("x > 0 and y > 0").select(F.log10("x").alias("lx"), F.log10("y").alias("ly"))
    m = logs.agg(F.count("*").alias("n"), F.avg("lx").alias("mx"), F.avg("ly").alias("my"), F.var_pop("lx").alias("vx"), F.var_pop("ly").alias("vy"), F.covar_pop("lx", "ly").alias("c")).first()
    n, slope = m["n"], m["c"] / m["vx"]
    error = math.sqrt(max(m["vy"] - slope * m["c"], 0) / (n - 2) / m["vx"])
    width = t_quantile((1 + level) / 2, n - 2)
    intercept, spread = m["my"] - slope * m["mx"], error * math.sqrt(m["vx"] + m["mx"] ** 2)
    row = (n, slope, slope - width * error, slope + width * error, intercept, intercept - width * spread, intercept + width * spread)
    return points.sparkSession.createDataFrame([row], "n long, slope double, slope_low double, slope_high double, intercept double, intercept_low double, intercept_high double")
