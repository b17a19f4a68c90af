"""Exact ranks, quantiles and percentiles of large columns, without a task that holds them.

Values are counted first, so that repeated ones are one row. Distinct values are range-partitioned and sorted; a value's rank is the sum of the partitions before
it and of the values before it in its own. Only the sums of partitions meet, one row for each partition and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.plans.storage import write_shared


def counted_ranks(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`(by, value, k, below, n)`: each distinct value of a group, how often it occurs, how many are smaller, and the group's size. Null and NaN don't count. Columns in `by`
    should have other names than these."""
    number = F.col(value).cast("double")
    counts = rows.where(number.isNotNull() & ~F.isnan(number)).groupBy(*by, (number + 0.0).alias("value")).agg(F.count("*").alias("k"))
    order = [*by, "value"]
    placed = write_shared(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranks")
    sums = placed.groupBy(*by, "part").agg(F.sum("k").alias("part_sum"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # as many rows as partitions
    line = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = write_shared(sums.select(*by, "part", F.coalesce(F.sum("part_sum").over(line), F.lit(0)).alias("offset"), F.sum("part_sum").over(group).alias("n")), "rank-offsets")
    inside = Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("inside", F.coalesce(F.sum("k").over(inside), F.lit(0))).join(offsets, [*by, "part"])
    return ranked.select(*by, "value", "k", (F.col("offset") + F.col("inside")).alias("below"), "n")


def quantiles(rows: DataFrame, value: str, at: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """`(by, i, q, value)`: the quantiles `at` of each group, on straight lines between neighbours in rank. Groups without values have none.

    Only the rows on either side of a wanted rank are kept, so what is gathered is two rows for each quantile and group.
    """
    asked = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(at)))
    h = lambda q: F.round(q * (F.col("n") - 1), 9)  # noqa: E731  a whole rank is one, whatever the product's last digit
    holds = lambda rank: (F.col("below") <= rank) & (rank < F.col("below") + F.col("k"))
    wanted = lambda a: holds(F.floor(h(a["q"]))) | holds(F.ceil(h(a["q"])))
    near = counted_ranks(rows, value, by).withColumn("a", F.filter(asked, wanted)).where(F.size("a") > 0).withColumn("a", F.explode("a"))
    q = F.col("a.q")
    ends = near.groupBy(*by, F.col("a.i").alias("i"), q.alias("q"), "n").agg(
        F.max(F.when(holds(F.floor(h(q))), F.col("value"))).alias("lo"), F.max(F.when(holds(F.ceil(h(q))), F.col("value"))).alias("hi")
    )
    return ends.select(*by, "i", "q", (F.col("lo") + (F.col("hi") - F.col("lo")) * (h(F.col("q")) - F.floor(h(F.col("q"))))).alias("value"))


def percentile_ranks(rows: DataFrame, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with `name`: the mean rank of equal values, from 1, over the group's size; null for null and NaN."""
    share = (F.col("below") + (F.col("k") + 1) / 2) / F.col("n")
    ranked = write_shared(counted_ranks(rows, value, by).select(*by, F.col("value").alias("ranked_value"), share.alias(name)), "percentile-ranks")
    number = F.col(value).cast("double") + 0.0
    return rows.withColumn("ranked_value", F.when(~F.isnan(number), number)).join(ranked, [*by, "ranked_value"], "left").drop("ranked_value")


def percentiles(rows: DataFrame, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with `name`: the last of the group's whole percentiles that isn't above the value, as a share; null for null and NaN. Groups are few: a row of edges each."""
    edges = quantiles(rows, value, [p / 100 for p in range(101)], by).groupBy(*by).agg(F.array_sort(F.collect_list("value")).alias("edges"))
    edges = write_shared(edges, "percentile-edges")
    joined = rows.join(edges, list(by), "left") if by else rows.join(F.broadcast(edges), F.lit(True), "left")  # one row of 101 numbers
    below = F.size(F.filter("edges", lambda e: e <= F.col(value)))
    return joined.withColumn(name, F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), (below - 1) / 100.0)).drop("edges")


def bucket(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted `cuts` are not above the value, by halving; all of them for null and NaN."""
    held, steps, step = F.array(*(F.lit(float(c)) for c in cuts)), [], 1
    while step <= len(cuts):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    reaches = lambda at: (at <= len(cuts)) & F.coalesce(F.get(held, at - 1) <= value, F.lit(True))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda found, s: F.when(reaches(found + s), found + s).otherwise(found))


def two_dimensional_histogram(rows: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """`(x_bin, y_bin, n)` over `bins` equal bins of each axis between its extremes, the last one closed. Bins without rows have no row; null and NaN don't count."""
    good = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    ends = good.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)))
    at = lambda c: F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), F.least(F.floor((F.col(c) - F.col(f"min_{c}")) / (F.col(f"max_{c}") - F.col(f"min_{c}")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return good.join(F.broadcast(ends)).groupBy(at("x").alias("x_bin"), at("y").alias("y_bin")).agg(F.count("*").alias("n"))  # one row of four numbers
