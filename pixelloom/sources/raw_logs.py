"""Raw edit logs: text in three layouts to typed events, pixels of moderator shapes, and dense numbers.

Two layouts are lines of a time, a user, a colour and quoted coordinates (in either order); a third is a plain CSV. Coordinates are a point, a rectangle of two corners, or a
circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom import schemas
from pixelloom.functions.columns import seconds_since
from pixelloom.plans.storage import write_shared

#: The patterns of a raw line in either order of colour and coordinates.
LINE_COLOR_FIRST = r'^(\S+) (\S+) UTC,([^,]+),(#[0-9A-Fa-f]{6}),"([^"]*)"'
LINE_COLOR_LAST = r'^(\S+) (\S+) UTC,([^,]+),"([^"]*)",(#[0-9A-Fa-f]{6})'


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(line, file, ordinal)` of text files: `ordinal` sorts the lines of a file as they stand there."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ordinal"))


def parse_lines(lines: DataFrame, origin: str, color_last: bool = False) -> DataFrame:
    """Typed columns of raw lines: seconds, user_hash, hex, coords and the numbers in them. Lines that don't match, such as headers, drop out."""
    pattern = LINE_COLOR_LAST if color_last else LINE_COLOR_FIRST
    part = lambda i: F.regexp_extract("line", pattern, i)
    coords = part(4) if color_last else part(5)
    hits = lines.where(F.col("line").rlike(pattern))
    return hits.select(
        *[c for c in lines.columns if c != "line"],
        seconds_since(part(1), part(2), origin).alias("seconds"),
        part(3).alias("user_hash"),
        F.upper(part(5) if color_last else part(4)).alias("hex"),
        coords.contains("R:").alias("circle"),
        F.transform(F.regexp_extract_all(coords, F.lit(r"(-?\d+)"), 1), lambda x: x.cast("int")).alias("at"),
    )


def event_numbers(parsed: DataFrame, per_file: int = 10_000_000) -> DataFrame:
    """Add `event_id`: number of the file (by name) times `per_file` plus the line's place in it. One number for all pixels of an event.

    Lines are range-partitioned by file and place, and written with their partition's number; each partition numbers its own, so that no task sorts a file.
    """
    dealt = write_shared(parsed.repartitionByRange("file", "ordinal").withColumn("block", F.spark_partition_id()), "lines")
    counts = dealt.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", (F.dense_rank().over(Window.orderBy("file")) - 1).alias("file_no"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row for each block
    place = F.row_number().over(Window.partitionBy("block", "file").orderBy("ordinal")) - 1
    numbered = dealt.withColumn("place", place).join(F.broadcast(offsets), ["file", "block"])
    return numbered.withColumn("event_id", F.col("file_no") * per_file + F.col("offset") + F.col("place")).drop("file_no", "file", "ordinal", "block", "offset", "place")


def expand_shapes(parsed: DataFrame) -> DataFrame:
    """One row for each pixel: points as they are, rectangles with both corners, circles with dx^2 + dy^2 < r^2 - 0.001.

    `moderator` is whether the event was a shape.
    """
    n, at = F.size("at"), lambda i: F.get("at", F.lit(i))
    r = at(2)
    shape = (n == 4) | F.col("circle")
    span = lambda a, b, i: F.when(F.col("circle"), F.sequence(at(i) - r, at(i) + r)).when(n == 4, F.sequence(F.least(a, b), F.greatest(a, b))).otherwise(F.array(at(i)))
    wide = parsed.withColumns({"moderator": shape, "xs": span(at(0), at(2), 0), "ys": span(at(1), at(3), 1)})
    pixels = wide.withColumn("x", F.explode("xs")).withColumn("y", F.explode("ys"))
    inside = F.pow(F.col("x") - at(0), 2) + F.pow(F.col("y") - at(1), 2) < F.pow(r, 2) - 1e-3
    return pixels.where(~F.col("circle") | inside).drop("xs", "ys", "at", "circle")


def dense_colors(events: DataFrame) -> DataFrame:
    """`(hex, color)`: colours numbered by first appearance. A palette is small, so one window numbers it."""
    first = events.groupBy("hex").agg(F.min(F.struct("seconds", "event_id")).alias("first"))
    return first.select("hex", (F.row_number().over(Window.orderBy("first", "hex")) - 1).alias("color"))


def dense_users(events: DataFrame) -> DataFrame:
    """`(user_hash, user)`: users numbered by first appearance, without a single-task sort.

    Users are range-partitioned by their first appearance, so that bursts spread, and written with their partition's number; each partition numbers its own and adds
    the number of users before it.
    """
    first = events.groupBy("user_hash").agg(F.min(F.struct("seconds", "event_id")).alias("first"))
    dealt = write_shared(first.repartitionByRange("first", "user_hash").withColumn("block", F.spark_partition_id()), "first-seen")
    counts = dealt.groupBy("block").agg(F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # one row for each block
    place = F.row_number().over(Window.partitionBy("block").orderBy("first", "user_hash")) - 1
    return dealt.withColumn("place", place).join(offsets, "block").select("user_hash", (F.col("place") + F.col("offset")).alias("user"))


def condense(events: DataFrame, colors: DataFrame, users: DataFrame) -> DataFrame:
    """The clean log, with dense numbers in place of hashes and colours."""
    return events.join(F.broadcast(colors), "hex").join(users, "user_hash").select("event_id", "seconds", "x", "y", "user", "color", "moderator")


def read_old_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.OLD_LOG)


def clean_old_log(raw: DataFrame, begin: str, end: str) -> DataFrame:
    """Rows without nulls, without full duplicates, with a good time within [begin, end]; seconds from the first kept row. Users are numbered in hash order by a later step."""
    stamp = F.try_to_timestamp(F.regexp_replace("ts", " UTC$", ""))
    good = raw.dropna().dropDuplicates().withColumn("at", stamp).where(F.col("at").between(F.lit(begin).cast("timestamp"), F.lit(end).cast("timestamp")))
    start = good.agg(F.min(F.unix_micros("at"))).first()[0]
    return good.select(
        ((F.unix_micros("at") - F.lit(start or 0)) / 1e6).alias("seconds"), "user_hash", F.col("x_coordinate").alias("x"), F.col("y_coordinate").alias("y"), "color"
    )


def write_log(log: DataFrame, path: str, bucket_seconds: float = 3600.0) -> None:
    """Parquet partitioned by time bucket and sorted within files; rows are dealt by bucket and hash, so a busy hour is no single task."""
    bucketed = log.withColumn("bucket", F.floor(F.col("seconds") / bucket_seconds).cast("int"))
    bucketed.repartitionByRange("bucket", "seconds").sortWithinPartitions("bucket", "seconds", "event_id").write.partitionBy("bucket").parquet(path)


def read_log(spark: SparkSession, path: str, before: float | None = None) -> DataFrame:
    """The written log, all of it or what is before a time; whole buckets beyond it are pruned."""
    log = spark.read.parquet(path)
    return (log if before is None else log.where(F.col("seconds") < before)).drop("bucket")


def write_dictionaries(colors: DataFrame, users: DataFrame, path: str) -> None:
    """Colour and user numbers as tables, each sorted for both directions of the look-up: by number and by name."""
    for table, name, number in ((colors, "hex", "color"), (users, "user_hash", "user")):
        for by in (name, number):
            table.repartitionByRange(by).sortWithinPartitions(by).write.parquet(f"{path}/{number}_by_{by}")


def read_dictionary(spark: SparkSession, path: str, number: str, by: str) -> DataFrame:
    """`number` is color or user, `by` the column that the wanted keys are in; filters on it are pushed to sorted row groups."""
    return spark.read.parquet(f"{path}/{number}_by_{by}")
