"""The atlas of compositions: nested JSON to borders with time ranges, and tables written for others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom import schemas


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schemas.ATLAS).json(path)


def repair(atlas: DataFrame, drop_ids: list[str]) -> DataFrame:
    """Without the given entries, and with the time key "T" written as "T:0-1"."""
    return atlas.where(~F.col("id").isin(drop_ids)).withColumn("path", F.transform_keys("path", lambda k, _: F.when(k == "T", "T:0-1").otherwise(k)))


def borders_of(atlas: DataFrame, unit: float, total: float) -> DataFrame:
    """`(comp_id, seq, t0, t1, path)`: one row for each border and time range, in order of start.

    Keys are ranges of units ("5-10" is [4, 10] units), single units, or lists of these. Any other tag stands for the whole time if it is the
    entry's only key, and for nothing otherwise.
    """
    keyed = atlas.select(F.col("id").alias("comp_id"), F.size("path").alias("n_keys"), F.explode("path").alias("key", "path"))
    parts = keyed.withColumn("part", F.explode(F.split("key", r",\s*")))
    timed = F.col("part").rlike(r"^\s*\d+(-\d+)?\s*$")
    number = lambda i: F.try_element_at(F.regexp_extract_all("part", F.lit(r"(\d+)"), 1), F.lit(i)).cast("double")
    t0 = F.when(timed, (number(1) - 1) * unit).otherwise(0.0)
    t1 = F.when(timed, F.coalesce(number(2), number(1)) * unit).otherwise(total)
    found = parts.where(timed | (F.col("n_keys") == 1)).select("comp_id", t0.alias("t0"), t1.alias("t1"), "path")
    order = Window.partitionBy("comp_id").orderBy("t0", "t1", F.to_json("path"))
    return found.withColumn("seq", F.row_number().over(order) - 1)


def write_scaling(table: DataFrame, path: str) -> None:
    table.write.csv(path, header=True)


def read_scaling(spark: SparkSession, path: str, schema: str) -> dict[str, DataFrame]:
    """The table again, split in streamers' compositions, alliances', and others."""
    rows = spark.read.csv(path, header=True, schema=schema)
    streamer, alliance = F.col("streamer"), F.col("alliance")
    return {"streamer": rows.where(streamer), "alliance": rows.where(~streamer & alliance), "other": rows.where(~streamer & ~alliance)}


def write_runs(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of several parameter sets as one dataset, partitioned by `param`."""
    for param, table in tables.items():
        table.withColumn("param", F.lit(param)).write.mode("append").partitionBy("param").parquet(path)


def read_runs(spark: SparkSession, path: str, param: str | None = None) -> DataFrame:
    """All runs, or that of one parameter set; other partitions are not read."""
    rows = spark.read.option("recursiveFileLookup", False).parquet(path)
    return rows if param is None else rows.where(F.col("param") == param)


def write_result(table: DataFrame, path: str) -> None:
    """A result, such as a histogram or heat map, as Parquet and as JSON lines."""
    table.write.parquet(f"{path}/parquet")
    table.write.json(f"{path}/json")
