"""The driver's tables as a canvas: `events` is the log, `nation` the atlas of rectangular compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.config import DAY, TEST_CANVAS

ORIGIN_MICROS = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC
#: Rectangles whose pixels one task makes.
BORDERS_A_PART = 20_000
#: Event types in the order of their colour numbers.
KINDS = ("click", "error", "purchase", "signup", "view")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone, the latter as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def micros_of(seconds: Column) -> Column:
    """Whole microseconds of seconds since the origin: the product alone may fall just short of them."""
    return F.round(seconds * 1e6).cast("long")


def pixel_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean log of `events`. A row's JSON is read once, in a step of its own, as two columns are made of it."""
    events = read_table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    color = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int") - 1
    return events.select(
        "event_id",
        ((micros(F.col("ts")) - ORIGIN_MICROS) / 1e6).alias("seconds"),
        (k % 10).alias("x"),
        F.floor(k / 10).cast("int").alias("y"),
        F.col("user_id").alias("user"),
        color.alias("color"),
        (F.col("value") > 300).alias("moderator"),
    )


def borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(comp_id, x0, y0, x1, y1, t0, t1)`: one rectangle for each nation, corners inclusive."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    x0, y0 = (n % 5) * 2, F.floor(n / 5).cast("int") * 2
    return read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("c"), n.cast("string")).alias("comp_id"),
        x0.cast("int").alias("x0"),
        y0.alias("y0"),
        F.least(x0 + 2, F.lit(9)).cast("int").alias("x1"),
        F.least(y0 + 2, F.lit(9)).alias("y1"),
        (r * DAY).alias("t0"),
        ((30 - r) * DAY).alias("t1"),
    )


def sections(spark: SparkSession) -> DataFrame:
    rows = [(s.section, s.t_open, s.xmin, s.xmax, s.ymin, s.ymax) for s in TEST_CANVAS.sections]
    return spark.createDataFrame(rows, "section int, t_open double, xmin int, xmax int, ymin int, ymax int")


#: The same mappings in DuckDB SQL, as common table expressions.
SQL_LOG = """log AS (
    SELECT event_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS seconds, k % 10 AS x, k // 10 AS y, user_id AS "user",
        CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS color,
        value > 300 AS moderator
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
SQL_BORDERS = """borders AS (
    SELECT 'c' || n_nationkey AS comp_id, (n_nationkey % 5) * 2 AS x0, (n_nationkey // 5) * 2 AS y0, least((n_nationkey % 5) * 2 + 2, 9) AS x1,
        least((n_nationkey // 5) * 2 + 2, 9) AS y1, n_regionkey * 86400e0 AS t0, (30 - n_regionkey) * 86400e0 AS t1
    FROM nation)"""
SQL_PIXELS = f"""{SQL_BORDERS}, pixels AS (
    SELECT b.comp_id, x, y, b.t0, b.t1 FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM borders) b, LATERAL (SELECT unnest(range(b.y0, b.y1 + 1)) AS y))"""
SQL_SECTIONS = """sections(section, t_open, xmin, xmax, ymin, ymax) AS (VALUES (0, 0.0, 0, 4, 0, 9), (1, 432000.0, 0, 9, 0, 9))"""
SQL_CHANGES = f"""{SQL_LOG}, {SQL_PIXELS}, member AS (
    SELECT p.comp_id, l.*, p.t0, p.t1, (l.seconds > p.t0 AND l.seconds < p.t1) AS active FROM log l JOIN pixels p ON l.x = p.x AND l.y = p.y
), changes AS (
    SELECT m.*, coalesce(color = lag(color) OVER px, false) AS redundant_col,
        coalesce(color = lag(color) OVER px AND "user" = lag("user") OVER px, false) AS redundant_colanduser,
        moderator OR coalesce(seconds - max(seconds) FILTER (WHERE NOT moderator) OVER us < 21600, false) AS cooldown_cheat
    FROM member m
    WINDOW px AS (PARTITION BY comp_id, x, y ORDER BY seconds, event_id),
        us AS (PARTITION BY comp_id, "user" ORDER BY seconds, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


def many_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `borders`, from a table that grows: one small rectangle for each customer, on a canvas 97 wide that grows downwards; neighbours overlap."""
    customers = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("int")
    x0, y0 = (k * 7) % 97, F.floor(k / 97).cast("int") * 2
    made = customers.select(
        F.concat(F.lit("k"), k.cast("string")).alias("comp_id"), x0.alias("x0"), y0.alias("y0"), (x0 + k % 5).alias("x1"), (y0 + k % 4).alias("y1"),
        ((k % 20) * DAY).alias("t0"), ((k % 20 + 1 + k % 9) * DAY).alias("t1"),
    )
    # a file of customers is small, and one task would make all of its pixels; a number of parts that is given is kept
    return made.repartition(max(1, -(-customers.count() // BORDERS_A_PART)), "comp_id")


SQL_MANY_BORDERS = """borders AS (
    SELECT 'k' || c_custkey AS comp_id, x0, y0, x0 + k % 5 AS x1, y0 + k % 4 AS y1, (k % 20) * 86400e0 AS t0, (k % 20 + 1 + k % 9) * 86400e0 AS t1
    FROM (SELECT *, CAST(c_custkey AS INT) AS k, (CAST(c_custkey AS INT) * 7) % 97 AS x0, (CAST(c_custkey AS INT) // 97) * 2 AS y0 FROM customer))"""
