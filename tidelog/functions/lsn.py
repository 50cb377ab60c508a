"""Log positions as text: 16 upper-case hexadecimal digits, so that text order is numeric order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = "0" * 16


def from_long(c: Column) -> Column:
    """A position from a number; values from 2**63 on are negative longs and keep their bits."""
    return F.lpad(F.hex(c), 16, "0")


def canonical(c: Column) -> Column:
    """From ``X/Y`` or plain hexadecimal to the canonical text; null if malformed."""
    high, low = F.split_part(c, F.lit("/"), F.lit(1)), F.split_part(c, F.lit("/"), F.lit(2))
    slashed = F.concat(F.lpad(high, 8, "0"), F.lpad(low, 8, "0"))
    return F.upper(F.when(c.rlike(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), slashed).when(c.rlike(r"^[0-9A-Fa-f]{1,16}$"), F.lpad(c, 16, "0")))


def display(c: Column) -> Column:
    """``X/Y`` without leading zeros."""
    strip = lambda x: F.when(F.ltrim(x, F.lit("0")) == "", F.lit("0")).otherwise(F.ltrim(x, F.lit("0")))
    return F.concat_ws("/", strip(F.substring(c, 1, 8)), strip(F.substring(c, 9, 8)))


def to_decimal(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("decimal(20,0)")


def distance(a: Column, b: Column) -> Column:
    """a - b in bytes, 0 if b is later."""
    return F.greatest(to_decimal(a) - to_decimal(b), F.lit(0).cast("decimal(21,0)"))


def minus(c: Column, lag: int) -> Column:
    """The position ``lag`` bytes earlier, not below zero: the floor of retention."""
    n = F.greatest(to_decimal(c) - F.lit(lag), F.lit(0).cast("decimal(21,0)")).cast("string")
    return F.lpad(F.conv(n, 10, 16), 16, "0")


def pair(commit: str = "_commit_lsn", lsn: str = "_lsn") -> Column:
    """The order of changes: commit position, then position."""
    return F.struct(F.col(commit).alias("c"), F.col(lsn).alias("l"))
