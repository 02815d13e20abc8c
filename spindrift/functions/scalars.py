"""Buckets, fixed point and integer codes, as expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def bucket(ts: Column, width: int) -> Column:
    """floor(ts / width) in whole numbers, negative times included."""
    return ((ts - F.pmod(ts, F.lit(width))) / width).cast("long") if width == 1 else F.floor((ts - F.pmod(ts, F.lit(width))) / width)


def fixed_point(value: Column, digits: int) -> Column:
    """The value times 10^digits, cut towards zero."""
    return (value * 10**digits).cast("long")


def zigzag(value: Column) -> Column:
    """0, -1, 1, -2 ... to 0, 1, 2, 3 ..., for 64 bits."""
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-value.bitwiseAND(F.lit(1).cast("long")))


def varint_bytes(value: Column) -> Column:
    """Bytes that a value takes in groups of 7 bits."""
    return F.greatest(F.lit(1), F.ceil((F.length(F.regexp_replace(F.bin(value), "^0+", ""))) / 7)).cast("int")


def delta(value: Column, by: list[str], order: list[str]) -> Column:
    """The difference to the row before; the first row's own value."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return value - F.coalesce(before, F.lit(0))


def delta_of_delta(value: Column, by: list[str], order: list[str]) -> Column:
    window = Window.partitionBy(*by).orderBy(*order)
    one, two = F.lag(value, 1).over(window), F.lag(value, 2).over(window)
    return F.when(two.isNotNull(), value - 2 * one + two).when(one.isNotNull(), value - one).otherwise(value)


def undelta(delta: Column, by: list[str], order: list[str]) -> Column:
    return F.sum(delta).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
