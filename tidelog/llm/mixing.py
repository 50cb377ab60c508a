"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: a share of all words is divided by weight; no source gets more than ``cap`` times its words,
   and what it would have got beyond is shared by the others.
2. Each source is dealt into blocks by a hash, as many as its words call for, and its blocks into a random order.  A target of 1.3
   times the source draws every block once and, in that order, blocks for the remaining 0.3;
   the block at the limit is drawn in part, document by document in hash order, so that the
   words taken differ from the target by less than one document.
3. The numbers of drawn blocks of each source are split between two halves of the output shards by
   a multivariate hypergeometric draw, and so on down to single shards.  Then every shard takes its
   quota of each source's drawn blocks, in the random order: disjoint sets by construction.
4. Within a shard, documents are put in the order of another hash.

Blocks and shards hold a number of words, so their counts follow the input.  Blocks, draws and quotas are tables; the driver
sees sums only.  A source may hold any share of the rows: it is dealt into blocks before anything is ranked.  The top of the
tree is split in one task, which sees a number for each source; its branches are split side by side.

Everything random comes from hashes and generators seeded by the place in the tree, so reruns agree.
Null sources form a source of their own, the last; null and empty texts have size 0 and are
taken with 0 words.  Rows repeated whole, and rows with one doc_id, are separate documents: each has draws of its own.  An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import cut, small

#: Words of a block and blocks of any source at least; words of a shard; branches of the tree that are split side by side.
BLOCK_WORDS, LEAST_BLOCKS, SHARD_WORDS, BRANCHES = 1 << 20, 64, 1 << 24, 64


def word_count(text: str | Column = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    spaced = F.trim(F.regexp_replace(F.translate(text, "\t\n\x0b\f\r", "     "), " {2,}", " "))
    return F.coalesce(F.when(spaced == "", F.lit(0)).otherwise(F.length(spaced) - F.length(F.translate(spaced, " ", "")) + 1), F.lit(0)).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``no``, their place in the order from 0 on.  Only counts of partitions are held together, never all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id()))
    counts = dealt.groupBy("part_").count()
    begin = counts.select(F.col("part_").alias("p_"), F.coalesce(F.sum("count").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin_"))
    within = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return dealt.join(F.broadcast(begin), F.col("part_") == F.col("p_")).withColumn("no", (within + F.col("begin_")).cast("long")).drop("part_", "p_", "begin_")


def targets(sources: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size) with no, their place by code point with null last, and target, the words to take.

    Each round fixes the sources that reach ``cap``; it needs two sums over the sources that are still open.
    """
    ranked = cut(numbered(sources, F.col("source").isNull(), F.col("source")).withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("no") % len(weights)).cast("int"))))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    each, full = 0.0, None
    while True:
        over = F.lit(False) if full is None else F.lit(each) * F.col("weight") > F.lit(cap) * F.col("source_size")
        n, taken, weight = ranked.agg(F.count_if(over), F.sum(F.when(over, F.lit(cap) * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not weight:
            break
        each, full = max(0.0, share * total - (taken or 0.0)) / weight, n
    return ranked.withColumn("target", F.least(F.lit(cap) * F.col("source_size"), F.lit(each) * F.col("weight")) if weight else F.lit(cap) * F.col("source_size")).drop("weight")


def branch(lo: int, hi: int, source: np.ndarray, first: np.ndarray, quota: np.ndarray, leaf: int, seed: int) -> Iterator[tuple]:
    """Split the shards from lo to hi down to ranges of at most ``leaf`` shards: (lo, hi, source, first, quota) of each.

    quota[i] drawn blocks of source[i], which begin with its ``first``, are dealt to the range.  A half gets its share of all blocks, drawn
    without replacement from the sources' quotas; sources without any are dropped.
    """
    todo = [(lo, hi, source, first, quota)]
    while todo:
        lo, hi, source, first, quota = todo.pop()
        if hi - lo <= leaf:
            yield lo, hi, source, first, quota
            continue
        half = (hi - lo) // 2
        left = np.random.default_rng([seed, 2, lo, hi]).multivariate_hypergeometric(quota, int(quota.sum()) * half // (hi - lo), method="marginals")
        for a, b, f, q in ((lo + half, hi, first + left, quota - left), (lo, lo + half, first, left)):
            some = np.flatnonzero(q)
            todo.append((a, b, source[some], f[some], q[some]))


def quotas(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, shard, first, n): the quota n of each source's drawn blocks that a shard takes, from ``first`` on.

    drawn: (source_no, n), the drawn blocks of each source.
    """
    leaf = max(1, math.ceil(shards / BRANCHES))

    def table(parts: Iterator[tuple]) -> pa.Table:
        parts = list(parts)
        spread = lambda k: np.concatenate([np.full(len(p[2]), p[k], np.int64) for p in parts] or [np.zeros(0, np.int64)])
        joined = lambda k: np.concatenate([p[k].astype(np.int64) for p in parts] or [np.zeros(0, np.int64)])
        return pa.table({"lo": spread(0), "hi": spread(1), "source_no": joined(2), "first": joined(3), "n": joined(4)})

    def top(t: pa.Table) -> pa.Table:
        t = t.sort_by("source_no")
        n = t["n"].to_numpy()
        return table(branch(0, shards, t["source_no"].to_numpy(), np.zeros(len(n), np.int64), n, leaf, seed))

    def below(t: pa.Table) -> pa.Table:
        t = t.sort_by("source_no")
        return table(branch(t["lo"][0].as_py(), t["hi"][0].as_py(), *(t[c].to_numpy() for c in ("source_no", "first", "n")), 1, seed))

    schema = "lo long, hi long, source_no long, first long, n long"
    branches = drawn.where("n > 0").withColumn("tree", F.lit(0)).groupBy("tree").applyInArrow(top, schema)
    return branches.groupBy("lo", "hi").applyInArrow(below, schema).select("source_no", F.col("lo").cast("int").alias("shard"), "first", "n")


def _keys(seed: int) -> list[Column]:
    """Two hashes that name a row by doc_id, source and text; rows repeated whole share them."""
    parts = [F.col("doc_id"), F.col("doc_id").isNull(), F.col("source"), F.col("source").isNull(), F.coalesce("text", F.lit(""))]
    return [F.xxhash64(F.lit(seed), *parts).alias("k1"), F.xxhash64(F.lit(seed + 1), *parts).alias("k2")]


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int | None = None, seed: int = 11, block_words: int = BLOCK_WORDS, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, draws (copy, shard, rank), k1 and k2 of every document.

    A document appears in the mix once for each of its draws; :func:`materialize` writes them out.
    """
    slim = cut(docs.select("doc_id", "source", word_count().alias("size"), *_keys(seed)))
    sources = cut(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap).withColumn("blocks", least_blocks + F.floor(F.col("source_size") / block_words)))
    shards = shards or max(1, math.ceil((sources.agg(F.sum("target")).first()[0] or 0) / SHARD_WORDS))
    named = small(sources.withColumnRenamed("source", "source_"))
    placed = slim.join(named, slim.source.eqNullSafe(F.col("source_"))).drop("source_", "blocks_").withColumn("block", F.pmod("k1", F.col("blocks"))).drop("blocks").withColumnRenamed("no", "source_no")
    words = cut(placed.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")))
    # Passes over a source: whole ones, then the one that ends at the target.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    passes = words.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    passes = passes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("whole")))).withColumn("order", F.xxhash64("source_no", "block", "copy", F.lit(seed)))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source_no", "copy").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = passes.withColumn("before", before).where("copy < whole or before < rest")
    drawn = drawn.withColumn("limit", F.when((F.col("copy") == F.col("whole")) & (F.col("before") + F.col("words") > F.col("rest")), F.col("rest") - F.col("before")))
    place = F.row_number().over(Window.partitionBy("source_no").orderBy("copy", "order", "block")).cast("long") - 1
    drawn = cut(drawn.select("source_no", "block", "copy", "limit", place.alias("place")))
    table = quotas(drawn.groupBy("source_no").agg(F.count("*").alias("n")), shards, seed)
    dealt = table.select("source_no", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("place"))
    by_block = cut(drawn.join(dealt, ["source_no", "place"]).groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard", "limit"))).alias("d")))
    joined = placed.join(small(by_block), ["source_no", "block"], "left").withColumn("d", F.coalesce("d", F.array().cast("array<struct<copy:int,shard:int,limit:double>>")))
    draw = lambda x: F.struct(x["copy"].alias("copy"), x["shard"].alias("shard"), F.xxhash64("k1", "k2", x["copy"]).alias("rank"))
    ends = F.exists("d", lambda x: x["limit"].isNotNull())
    full = joined.where(~ends).withColumn("draws", F.transform("d", draw))
    # Of a block drawn in part: documents in hash order, as long as the middle of the document is within the limit.
    order = Window.partitionBy("source_no", "block").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    part = joined.where(ends).withColumn("middle", middle).withColumn("draws", F.transform(F.filter("d", lambda x: x["limit"].isNull() | (F.col("middle") <= x["limit"])), draw)).drop("middle")
    return full.unionByName(part).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws", "k1", "k2")


def materialize(docs: DataFrame, mixed: DataFrame, seed: int = 11) -> DataFrame:
    """The mix itself: a row of ``docs`` for each draw; a partition for each shard, in the shard's own order.

    Rows repeated whole are told apart by a number, so each is written for its own draws only.
    """
    mixed = cut(mixed.select("k1", "k2", "draws"))
    keys = [c.alias(n) for c, n in zip(_keys(seed), ("tidelog__1", "tidelog__2"), strict=True)]
    draws = mixed.where(F.size("draws") > 0).groupBy(F.col("k1").alias("tidelog__1"), F.col("k2").alias("tidelog__2")).agg(F.sort_array(F.collect_list("draws")).alias("tidelog__all"))
    rows = docs.select("*", *keys).join(draws, ["tidelog__1", "tidelog__2"])
    number = F.row_number().over(Window.partitionBy("tidelog__1", "tidelog__2").orderBy(F.xxhash64(*docs.columns)))
    rows = rows.withColumn("tidelog__no", number).withColumn("tidelog__draw", F.explode(F.get("tidelog__all", F.col("tidelog__no") - 1)))
    shards = (mixed.agg(F.max(F.array_max(F.transform("draws", lambda d: d["shard"])))).first()[0] or 0) + 1
    order = (F.col("tidelog__draw.shard"), F.xxhash64("tidelog__draw.rank", "tidelog__no"))
    return rows.repartitionById(shards, F.col("tidelog__draw.shard")).sortWithinPartitions(*order).select(*docs.columns)
