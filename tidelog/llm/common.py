"""Shared helpers: the shared scratch folder, size-checked broadcasts, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans.scratch import cut, scratch

__all__ = ["components", "cut", "marked", "row_key", "scratch", "small"]

#: A side is broadcast only if it has been counted and has at most this many rows.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it is small enough, otherwise unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_key(text: str = "text") -> F.Column:
    """Tells rows with one doc_id apart: a hash of the text; identical rows share it."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list of longs: (node, root), root the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), so the number of
    rounds is logarithmic and no group is gathered: each round is two aggregations and two
    joins.  Every round's edges are written to the shared folder, and so are the least neighbours, which leaves both
    sides of a join to shuffles of their own: then Spark splits the edges of a star's centre among tasks.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        linked = large.join(least, "u")
        e = cut(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = state


#: Bits of the map that :func:`marked` broadcasts: a constant 2 MB, whatever the input.
MAP_BITS = 1 << 24


def marked(rows: DataFrame, ids: DataFrame, column: str = "doc_id", name: str = "marked") -> DataFrame:
    """``rows`` with a boolean that is true wherever ``column`` occurs in ``ids`` (and now and then elsewhere).

    A bitmap of hashes of constant size is broadcast, so rows that a join would drop need not
    be shuffled.  The more ids, the more rows pass; none is ever lost.
    """
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(MAP_BITS)) + 1
    bits = ids.select(place(column).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits_"))
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring(F.col("bits_"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, (at % 8).cast("int")) == 1, F.lit(False))
    joined = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(column)) == F.col("bucket_"), "left")
    return joined.select(*(F.col(c) for c in rows.columns), hit.alias(name))
