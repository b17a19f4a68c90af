"""Plans that stay within bounds where tables grow."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def many_customers(tmp_path_factory):
    folder = tmp_path_factory.mktemp("many")
    duckdb.sql(f"COPY (SELECT i AS c_custkey FROM range(1, 45001) r(i)) TO '{folder}/customer.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["c3_split_at_jumps", "c18_pixel_owners_of_many", "m3_perimeter_weights_of_many", "m2_slice_weights_of_many", "c4_overlaps_of_many"])
def test_exploded_tables_are_not_broadcast(spark, many_customers, name):
    """The pixels of 45,000 small rectangles come from a file of a few kilobytes, which Spark takes for their size."""
    plan = __spark_entry__.queries()[name](spark, many_customers)._jdf.queryExecution().executedPlan().toString()
    small = 1 if name.startswith("m2_") else 0  # the slices, a row for each time
    assert plan.count("BroadcastHashJoin") <= small


@pytest.mark.parametrize("name", ["c11_lives_of_many", "c19_size_distribution_of_many"])
def test_pixels_are_made_in_several_tasks(spark, many_customers, name):
    """One small file is one task; 45,000 rectangles are three."""
    plan = __spark_entry__.queries()[name](spark, many_customers)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "comp_id" in plan.split("REPARTITION_BY_NUM")[0].rsplit("hashpartitioning", 1)[1]


def test_no_task_numbers_a_whole_file(spark, sf_dir):
    """Lines are numbered within range partitions, also of one file in several, and in their order."""
    from pyspark.sql import functions as F

    from pixelloom.sources.raw_logs import event_numbers

    lines = spark.range(3000).select(F.concat(F.lit("f"), F.col("id") % 2).alias("file"), F.col("id").alias("ordinal"), F.col("id").alias("was")).repartition(7)
    numbered = event_numbers(lines, 10_000)
    assert {r.was: r.event_id for r in numbered.collect()} == {i: i % 2 * 10_000 + i // 2 for i in range(3000)}
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(block" in plan and "windowspecdefinition(file#" not in plan.split("row_number()")[1].split("AS")[0]
