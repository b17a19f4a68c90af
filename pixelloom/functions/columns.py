"""Column expressions of the canvas jobs; all stay inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column, both_zero: float = 1.0, zero_below: float = 10.0) -> Column:
    """a / b, with `both_zero` for 0/0 and `zero_below` where only b is 0. Null stays null."""
    return F.when((b == 0) & (a == 0), F.lit(both_zero)).when(b == 0, F.lit(zero_below)).otherwise(a / F.when(b != 0, b))


def seconds_since(date: Column, hour: Column, origin: str) -> Column:
    """Seconds since `origin` of a date and a time with or without fraction, in milliseconds; null for bad text."""
    stamp = F.try_to_timestamp(F.concat(date, F.lit(" "), hour))
    return F.round((F.unix_micros(stamp) - F.unix_micros(F.lit(origin).cast("timestamp"))) / 1e6, 3)


def original_stamp(seconds: Column, origin: str) -> Column:
    """Time text of a raw log: milliseconds without trailing zeros, no fraction for whole seconds."""
    stamp = F.timestamp_micros((F.round(seconds * 1000).cast("long") * 1000) + F.unix_micros(F.lit(origin).cast("timestamp")))
    text = F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit(" UTC"))


def red_green_blue(hex_color: Column) -> Column:
    """`struct(r, g, b)` of a text like #FF4500."""
    part = lambda i: F.conv(F.substring(hex_color, i, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def palette_size(seconds: Column, steps: tuple[tuple[float, int], ...]) -> Column:
    """Number of colours in force: that of the last step begun."""
    size = F.lit(steps[0][1])
    for start, colors in steps[1:]:
        size = F.when(seconds >= start, F.lit(colors)).otherwise(size)
    return size


def hash_unit(*keys: Column, seed: int = 0) -> Column:
    """Uniform number in [0, 1) that depends on the keys only, not on partitioning."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def bin_number(seconds: Column, start: Column, width: float) -> Column:
    """Bin of an event among (start, start + width], ...; from 1."""
    return F.ceil((seconds - start) / width).cast("int")
