"""Exact top-k search against all scores, for coarse and fine cells, and on odd vectors."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pixelloom.llm import vector_search

SCHEMA = "vec_id long, embedding array<double>, z string, row string, place string, v string"


def brute(rows, k, scale):
    """Sorted (query, rank, id, score) of rows (id, vector), queried by each id divisible by 5."""
    used = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    used = [(i, z) for i, z in used if all(abs(x) < vector_search.LIMIT for x in z)]
    out = []
    for at, (query, q) in enumerate(used):
        if query is not None and query % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, z, strict=False)), i is None, i or 0) for other, (i, z) in enumerate(used) if other != at)
            out += [(query, rank, None if null else i, -score) for rank, (score, null, i) in enumerate(scores[:k], 1)]
    return sorted(map(repr, out))


def search(spark, rows, k, scale, cells):
    df = spark.createDataFrame([(i, v, "mine", "mine", "mine", "mine") for i, v in rows], SCHEMA).repartition(4)
    found = vector_search.top_k(df, F.coalesce(F.col("vec_id") % 5 == 0, F.lit(False)), k, scale=scale, cells=cells, replicas=3)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(repr(tuple(r)) for r in found.collect())


def test_equals_all_scores_on_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)]  # many copies, some of them queries
    rows += [(7, rows[7][1]), (20, rows[20][1]), (20, rows[21][1]), (None, rows[5][1]), (None, None), (400, None), (405, [])]
    rows += [(410, [1.0, None]), (415, [float("nan")] * 12), (420, [float("inf")] + [0.0] * 11), (425, [1.5, -2.5]), (430, [1e300] * 12), (435, [0.0] * 12)]
    assert search(spark, rows, 3, 256, 64) == brute(rows, 3, 256)
    wide = [(i, [x * 10 ** rng.randint(0, 5) for x in v] if v and all(x is not None for x in v) else v) for i, v in rows]
    assert search(spark, wide, 4, 100, 3) == brute(wide, 4, 100)


def test_few_rows_and_none(spark):
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, [2.0]), (5, [3.0, 4.0])], [(0, []), (5, [])], [(1, [1.0])]):
        assert search(spark, rows, 5, 256, 16) == brute(rows, 5, 256)


def test_bounds_hold_and_leave_few_open():
    rng = np.random.default_rng(1)
    z = np.floor(rng.normal(0, 40, (500, 24))).astype(np.int32)
    borders = np.quantile(z[:100], np.arange(1, 64) / 64, axis=0, method="lower").T.copy()  # extremes are not in the sample
    cells = np.stack([np.searchsorted(borders[d], z[:, d], side="left") for d in range(24)], axis=1).astype(np.uint8)
    low, high = vector_search.bounds(z[:40].astype(float), cells, z.min(axis=0), z.max(axis=0), borders)
    exact = z[:40].astype(int) @ z.T.astype(int)
    assert (low <= exact).all() and (exact <= high).all()
    assert (high >= np.partition(low, -6, axis=1)[:, -6:-5]).mean() < 0.2


def test_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, vector_search.op12_exact_top_k(spark, sf_dir).collect())) == sorted(duckdb.sql(vector_search.SQL).fetchall())


def test_little_comes_to_the_driver(spark, tmp_path):
    """Neither the sample nor a join sends the vectors of every task to the driver; no stage sends as much as the table"""
    import time

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 32)]) for i in range(8000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8).write.parquet(str(tmp_path / "embeddings.parquet"))
    store = spark.sparkContext._jsc.sc().statusStore()
    lists = spark._jvm.scala.jdk.javaapi.CollectionConverters
    stages = lambda: lists.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
    before = {s.stageId() for s in stages()}
    assert vector_search.op12_exact_top_k(spark, str(tmp_path)).count() == 800
    time.sleep(1)
    sent = [
        sum(t.taskMetrics().get().resultSize() for t in lists.asJava(store.taskList(s.stageId(), s.attemptId(), 10_000)) if t.taskMetrics().isDefined())
        for s in stages() if s.stageId() not in before
    ]
    assert sent and max(sent) < 8000 * 32 * 4 * 0.6
