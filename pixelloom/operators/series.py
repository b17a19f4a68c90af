"""Rolling figures of time series, one window for each series. A series is (keys..., bin, val), without holes in `bin`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pixelloom.functions.columns import safe_ratio

KEYS = ["comp_id", "variable"]


def _order(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("bin")


def ratio_to_mean(series: DataFrame, window: int, keys: list[str] = KEYS) -> DataFrame:
    """`ratio` to the mean of the `window` values before this one (to itself for the first), 1 where that mean is 0."""
    mean = F.avg("val").over(_order(keys).rowsBetween(-window, -1))
    base = F.coalesce(mean, F.col("val"))
    return series.withColumn("ratio", safe_ratio(F.col("val"), base, 1.0, 1.0))


def zero_if_nan(c: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))


def rolling_moments(series: DataFrame, window: int = 10, keys: list[str] = KEYS) -> DataFrame:
    """Sample variance, bias-corrected skewness and lag-1 autocorrelation over the last `window` values; 0 where undefined."""
    frame = _order(keys).rowsBetween(-(window - 1), 0)
    lagged = series.withColumn("old", F.lag("val").over(_order(keys)))
    lagged = lagged.withColumn("now", F.when(F.col("old").isNotNull(), F.col("val")))
    n, mean = F.count("val").over(frame), F.avg("val").over(frame)
    powers = {k: F.avg(F.pow("val", F.lit(k))).over(frame) for k in (2, 3)}
    m2 = powers[2] - mean * mean
    m3 = powers[3] - 3 * mean * powers[2] + 2 * F.pow(mean, F.lit(3))
    skewness = F.when((n > 2) & (m2 > 1e-9 * (powers[2] + 1e-9)), m3 / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1.0)) / (n - 2.0)).otherwise(0.0)
    pairs = _order(keys).rowsBetween(-(window - 2), 0)
    spread = F.stddev_pop("now").over(pairs) * F.stddev_pop("old").over(pairs)
    autocorrelation = F.when(spread > 1e-9, F.covar_pop("now", "old").over(pairs) / spread)
    return lagged.withColumns(
        {"variance": zero_if_nan(F.var_samp("val").over(frame)), "skewness": skewness, "autocorrelation": zero_if_nan(autocorrelation)}
    ).drop("old", "now")


def rolling_kendall(series: DataFrame, window: int = 10, keys: list[str] = KEYS) -> DataFrame:
    """Kendall's tau-c of the last `window` values against time; 0 where all are equal. `series` with `tau`.

    Pairs come from a window of at most `window` values on each row, not from a self-join.
    """
    frame = _order(keys).rowsBetween(-(window - 1), 0)
    gathered = series.withColumn("vals", F.collect_list("val").over(frame))
    n, distinct = F.size("vals"), F.size(F.array_distinct("vals"))
    later = lambda x, i: F.aggregate(F.slice("vals", i + 2, n), F.lit(0), lambda s, y: s + F.signum(y - x).cast("int"))
    pairs = F.aggregate(F.transform("vals", later), F.lit(0), lambda s, y: s + y)
    tau = F.when(distinct > 1, 2.0 * pairs / (n * n * (distinct - 1.0) / distinct)).otherwise(0.0)
    return gathered.withColumn("tau", tau).drop("vals")


def rolling_mean_square(series: DataFrame, window: int, keys: list[str] = KEYS) -> DataFrame:
    """Mean of the squares of the last `window` values, of as many as there are at the start."""
    return series.withColumn("mean_square", F.avg(F.col("val") * F.col("val")).over(_order(keys).rowsBetween(-(window - 1), 0)))


def mean_before(series: DataFrame, window: int, keys: list[str] = KEYS) -> DataFrame:
    """Mean of the `window` values before this one, of as many as there are at the start."""
    return series.withColumn("mean_before", F.avg("val").over(_order(keys).rowsBetween(-window, -1)))


def mean_square_deviation(series: DataFrame, window: int, keys: list[str] = KEYS) -> DataFrame:
    """Mean over the last `window` values of the squared distance from the running mean of the same length."""
    frame = _order(keys).rowsBetween(-(window - 1), 0)
    apart = series.withColumn("d", F.col("val") - F.avg("val").over(frame))
    return apart.withColumn("deviation", F.avg(F.col("d") * F.col("d")).over(frame)).drop("d")
