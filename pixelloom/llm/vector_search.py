"""Exact top-k by inner product over a vector-approximation file.

Copies of a vector collapse first: only the k + 1 smallest ids of each can ever be among k results and the query itself. Each component of a distinct vector
is replaced by the number of its cell, one byte; the cells' borders are quantiles of a sample, but their outermost ones are a block's own
extremes, so that a cell always holds its value whatever the sample was. A block of queries and a block of cells give bounds of all their scores with two products of
matrices. A candidate is kept while its upper bound reaches the k-th best lower bound seen so far.

Exact vectors are then read in the order of upper bounds (the lower bounds of distance): first a few for each query, after which its k-th exact
score is known; then those whose bound still reaches it. What is left can't be among the results, so they are certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.llm.common import table
from pixelloom.plans.storage import write_shared

#: Vectors with the smallest hashes, about so many, whose quantiles are the cells' borders. They change the number of candidates, never a result.
FIT_ROWS = 4096
#: Bytes of approximations in a block, and queries in a block.
BLOCK_BYTES = 1 << 16
QUERY_BLOCK = 256
#: Whole numbers from here on (either sign) are not scored: sums of their products need not fit a long.
LIMIT = 1 << 26


def whole_vectors(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """`rows` with `z`, the whole parts of the scaled components; rows without a finite vector, or beyond LIMIT, go."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | ~(F.abs(F.floor(x.cast("double") * scale).cast("double")) < LIMIT))
    return rows.where(F.col(vector).isNotNull()).where(~bad).withColumn("z", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, short ones filled with zeros."""
    out = np.zeros((len(column), width), np.int32)
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values.slice(offsets[0], offsets[-1] - offsets[0]), dtype=np.int32) if len(column) else np.empty(0, np.int32)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def fit_sample(distinct: DataFrame, width: int) -> np.ndarray:
    """About FIT_ROWS vectors, those with the smallest hashes: a limit on the hash, since the first rows of an order would come to the driver from each task."""
    n = distinct.count()
    share = F.pmod(F.xxhash64("z"), F.lit(1 << 30)) < F.lit(-(-(FIT_ROWS << 30) // max(n, 1)))
    parts = distinct.where(share).select("z").toArrow().column("z").combine_chunks()
    return _matrix(parts, width)


def fit_borders(sample: np.ndarray, cells: int) -> np.ndarray:
    """For each component the borders between its cells, from the quantiles of a sample."""
    return np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="lower").T.copy() if len(sample) else np.zeros((sample.shape[1], cells - 1))


def approximate(distinct: DataFrame, borders: np.ndarray) -> DataFrame:
    """Blocks `(vs, cells, low, high)` of `distinct` (v, z); `low` and `high` are the block's extremes by component."""
    width = len(borders)
    rows = max(1, BLOCK_BYTES // max(1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, v = _matrix(batch.column("z"), width), np.asarray(batch.column("v"))
            for i in range(0, len(v), rows):
                part = z[i : i + rows]
                cells = np.empty(part.shape, np.uint8)
                for d in range(width):  # a border is the largest value of the cell below it
                    cells[:, d] = np.searchsorted(borders[d], part[:, d], side="left")
                found = {"vs": v[i : i + rows].tobytes(), "cells": cells.tobytes(), "low": part.min(axis=0).tobytes(), "high": part.max(axis=0).tobytes()}
                yield pa.RecordBatch.from_pylist([found], pa.schema([(k, pa.binary()) for k in found]))

    return distinct.select("v", "z").mapInArrow(run, "vs binary, cells binary, low binary, high binary")


def query_blocks(queries: DataFrame, sample: np.ndarray, k: int) -> DataFrame:
    """Blocks `(block, qs, queries, floors)` of `queries` (v, z). A floor is a query's `k`-th best score in the sample, which bounds its `k`-th best of all from below."""
    width = sample.shape[1]
    held = queries.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, v = _matrix(batch.column("z"), width), np.asarray(batch.column("v"))
            for i in range(0, len(v), QUERY_BLOCK):
                some = z[i : i + QUERY_BLOCK]
                floors = np.full(len(some), -np.inf)
                if len(held.value) >= k:
                    scores = some.astype(np.float64) @ held.value.T.astype(np.float64)
                    slack = 1e-12 * np.abs(some).max(initial=0).astype(np.float64) * np.abs(held.value).max(initial=0) * width
                    floors = np.partition(scores, -k, axis=1)[:, -k] - slack
                found = {"qs": v[i : i + QUERY_BLOCK].tobytes(), "queries": some.tobytes(), "floors": floors.tobytes()}
                yield pa.RecordBatch.from_pylist([found], pa.schema([(k, pa.binary()) for k in found]))

    return queries.select("v", "z").mapInArrow(run, "qs binary, queries binary, floors binary").withColumn("block", F.monotonically_increasing_id())


def bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores of `q` with the vectors in `cells`."""
    bottom = np.concatenate([low[:, None], np.maximum(borders + 1, low[:, None])], axis=1).astype(np.float64)
    top = np.concatenate([np.minimum(borders, high[:, None]), high[:, None]], axis=1).astype(np.float64)
    at = np.arange(len(borders))[None, :]
    centre, radius = (bottom[at, cells] + top[at, cells]) / 2, (top[at, cells] - bottom[at, cells]) / 2
    middle, reach = q @ centre.T, np.abs(q) @ radius.T
    slack = 1e-12 * float(np.abs(q).max(initial=0)) * float(np.abs(centre).max(initial=0) + radius.max(initial=0)) * len(borders)
    return middle - reach - slack, middle + reach + slack


def candidates(pairs: DataFrame, borders: np.ndarray, k: int) -> DataFrame:
    """`(q, v, low, high)` of those pairs of a query and a vector whose bounds leave a place among the best `k` open.

    Blocks of cells that come after each other for one block of queries share its best lower bounds so far, and never ask for less than its floors.
    """
    width = len(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, floors, q, qs = None, None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != held:
                    held, qs = row["block"], np.frombuffer(row["qs"], np.int64)
                    q = np.frombuffer(row["queries"], np.int32).reshape(len(qs), width).astype(np.float64)
                    best, floors = np.full((len(qs), k), -np.inf), np.frombuffer(row["floors"], np.float64)
                vs = np.frombuffer(row["vs"], np.int64)
                cells = np.frombuffer(row["cells"], np.uint8).reshape(len(vs), width)
                low, high = bounds(q, cells, *(np.frombuffer(row[c], np.int32) for c in ("low", "high")), borders)
                first = np.partition(low, max(0, len(vs) - k), axis=1)[:, -k:]
                best = np.partition(np.concatenate([best, first], axis=1), -k, axis=1)[:, -k:]
                i, j = np.nonzero(high >= np.maximum(best[:, 0], floors)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(qs[i]), pa.array(vs[j]), pa.array(low[i, j]), pa.array(high[i, j])], ["q", "v", "low", "high"])

    return pairs.select("block", "qs", "queries", "floors", "vs", "cells", "low", "high").mapInArrow(run, "q long, v long, low double, high double")


def _kth(found: DataFrame, value: str, k: int) -> DataFrame:
    """`(q, least)`: the k-th largest `value` of each q, -infinity where there are fewer."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(value)))
    best = found.select("q", value).withColumn("place", place).where(F.col("place") <= k)
    return best.groupBy("q").agg(F.when(F.count("*") == k, F.min(value)).otherwise(F.lit(float("-inf"))).alias("least"))


def top_k(rows: DataFrame, is_query, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256, cells: int = 64, replicas: int | None = None) -> DataFrame:
    """`(query_id, rank, id, score)`: of each row of `is_query` (a condition) the `k` other rows with the highest inner products.

    Components are scaled and rounded down to whole numbers. Ties go to the smaller id (null last); fewer rows than `k` give fewer results. Rows
    whose vector is null or holds null, non-finite or very large components (LIMIT) take no part. A shorter vector counts as filled up with
    zeros. A repeated id is a row of its own: it is queried again, and finds its copies. At most 256 cells. Other columns aren't looked at.
    """
    spark = rows.sparkSession  # stored vectors take a fourth of their size or less, by which Spark would broadcast them through the driver: joins ask for a merge
    parts = replicas or int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = whole_vectors(rows.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("query")), "vector", scale).select("id", "query", "z")
    usable = write_shared(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    place = F.row_number().over(Window.partitionBy("z").orderBy(F.col("id").asc_nulls_last(), "row"))
    firsts = usable.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("z").agg(F.collect_list(F.struct("place", "id", "row")).alias("members"))
    distinct = write_shared(firsts.withColumn("v", F.monotonically_increasing_id()), "distinct-vectors")
    width = distinct.agg(F.max(F.size("z"))).first()[0] or 0
    asked = write_shared(usable.where("query").select("id", "row", "z").join(distinct.select("v", "z").hint("merge"), "z").select("id", "row", "v"), "queries")
    wanted = write_shared(distinct.join(asked.select("v").distinct().hint("merge"), "v", "left_semi").select("v", "z"), "query-vectors")
    sample = fit_sample(distinct, width)
    borders = fit_borders(sample, cells)
    blocks = approximate(distinct, borders).withColumn("part", F.pmod(F.xxhash64("vs"), F.lit(parts)).cast("int"))
    near = query_blocks(wanted.repartition(max(1, -(-wanted.count() // QUERY_BLOCK))), sample, k + 1).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = write_shared(near, "query-blocks").join(write_shared(blocks, "approximations").hint("merge"), "part")
    found = write_shared(candidates(pairs, borders, k + 1), "candidates")
    open_ = found.join(_kth(found, "low", k + 1), "q").where("high >= least").select("q", "v", "high")
    open_ = write_shared(open_.withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("high"), "v"))), "open")
    exact = distinct.select("v", "z", "members")
    zq = wanted.select(F.col("v").alias("q"), F.col("z").alias("zq"))
    shared = F.least(F.size("z"), F.size("zq"))
    product = F.zip_with(F.slice("z", F.lit(1), shared), F.slice("zq", F.lit(1), shared), lambda a, b: a.cast("long") * b)
    score = F.aggregate(product, F.lit(0).cast("long"), lambda a, x: a + x)

    def read(some: DataFrame) -> DataFrame:
        return some.select("q", "v").join(exact.hint("merge"), "v").join(zq.hint("merge"), "q").select("q", score.alias("score"), "members")

    first = write_shared(read(open_.where(F.col("turn") <= 2 * (k + 1))), "read-first")
    rest = open_.where(F.col("turn") > 2 * (k + 1)).join(_kth(first, "score", k + 1), "q").where("high >= least")
    scored = first.unionByName(read(rest)).select("q", "score", F.explode("members").alias("m")).select("q", "score", F.col("m.id").alias("found"), F.col("m.row").alias("row"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("found").asc_nulls_last(), "row")
    top = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    top = write_shared(top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "found", "row", "score"))).alias("top")), "best")
    own = asked.join(top.hint("merge"), asked["v"] == top["q"]).select(F.col("id").alias("query_id"), F.slice(F.filter("top", lambda t: t["row"] != F.col("row")), 1, k).alias("top"))
    ranked = own.select("query_id", F.posexplode("top").alias("at", "t"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.found").alias(id), F.col("t.score").alias("score"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id,
  (row_number() OVER (PARTITION BY q.row ORDER BY list_inner_product(q.z, c.z) DESC, c.vec_id))::INTEGER AS rank, c.vec_id, list_inner_product(q.z, c.z)::BIGINT AS score
FROM whole q JOIN whole c ON c.row <> q.row
WHERE q.vec_id % 50 = 0
QUALIFY rank <= 5
"""
