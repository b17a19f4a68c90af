"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two equi-joins on the edge table; nothing is collected but two numbers that tell
whether the edges still change. Hubs are met by aggregating minima before the shuffle; the join of a hub's
edges to its one minimum is a plain sort-merge join that adaptive execution splits when it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.plans.storage import write_shared


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 100) -> DataFrame:
    """`(node, component)` for every node of an edge, `component` being the smallest node it can reach.

    Ids must be of an ordered type. Loops and null ends are left out; nodes without an edge to another node
    don't appear. Repeated and reversed edges change nothing. No edge at all gives an empty table.
    """
    a, b = F.col(left), F.col(right)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    stars = write_shared(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _digest(stars)
    for _ in range(max_rounds if before[0] else 0):
        stars = write_shared(_small_star(_large_star(stars)), "stars")
        now = _digest(stars)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
