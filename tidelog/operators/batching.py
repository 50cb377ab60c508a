"""Committed transactions to files: where a table's batch is cut, what it covers, and when intake has to wait.

A batch is closed at a commit only, so no transaction is split; what has not committed stays open.  Commits, not rows, are
folded in order, so a table's fold holds one slim row for each transaction.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def commits(rows: DataFrame, size: Column | None = None) -> DataFrame:
    """(table, commit_lsn, commit_ts, n_rows, n_bytes) of each transaction of a table.  rows: (table, commit_lsn, commit_ts, ...)."""
    bytes_ = size if size is not None else F.lit(0).cast("long")
    return rows.groupBy("table", "commit_lsn").agg(F.max("commit_ts").alias("commit_ts"), F.count("*").alias("n_rows"), F.sum(bytes_).cast("long").alias("n_bytes"))


def flushes(units: DataFrame, max_rows: int, max_bytes: int, max_seconds: int) -> DataFrame:
    """``units`` (see :func:`commits`) with batch, the number of the file that a transaction goes to.

    A file is closed by the commit at which it has reached max_rows or max_bytes, or whose time is max_seconds after the first one's.
    The order of commits decides, so a table's are folded in one stream; only three numbers are kept.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, batch, n, size, since = None, 0, 0, 0, None
        for b in batches:
            out = []
            for name, ts, rows, bytes_ in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("table", "commit_ts", "n_rows", "n_bytes")), strict=True):
                if name != table:
                    table, batch, n, size, since = name, 0, 0, 0, None
                since = ts if since is None else since
                n, size = n + rows, size + bytes_
                out.append(batch)
                if n >= max_rows or size >= max_bytes or ts - since >= max_seconds:
                    batch, n, size, since = batch + 1, 0, 0, None
            yield b.append_column("batch", pa.array(out, pa.int64()))

    slim = units.select("table", "commit_lsn", F.col("commit_ts").cast("long").alias("commit_ts"), "n_rows", "n_bytes")
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartition(parts, "table").sortWithinPartitions("table", "commit_lsn")
    return ordered.mapInArrow(fold, slim.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", batch long")


def seal(flushed: DataFrame) -> DataFrame:
    """(table, batch, lsn_start, lsn_end, n_rows, n_bytes, n_commits) of each file; lsn_end is its last commit's position, not its greatest row's."""
    return flushed.groupBy("table", "batch").agg(F.min("commit_lsn").alias("lsn_start"), F.max("commit_lsn").alias("lsn_end"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_commits"))


def cut(rows: DataFrame, outcomes: DataFrame, upto: str) -> DataFrame:
    """``rows`` with part: sealed (committed at or before ``upto``), later (committed after it), open (no outcome yet) or gone (aborted).

    outcomes: (top_xid, kind, commit_lsn) of whole transactions.
    """
    o = outcomes.select(F.col("top_xid").alias("t_"), "kind", F.col("commit_lsn").alias("c_"))
    part = F.when(F.col("kind").isNull(), "open").when(F.col("kind") == "abort", "gone").when(F.col("c_") <= upto, "sealed").otherwise("later")
    return rows.join(o, F.col("top_xid") == F.col("t_"), "left").withColumn("part", part).drop("t_", "kind", "c_")


def out_of_order(messages: DataFrame) -> DataFrame:
    """Commits that arrive with a position before an earlier one's.  messages: (slot, seq, commit_lsn), commits only."""
    before = Window.partitionBy("slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("highest", F.max("commit_lsn").over(before)).where("commit_lsn < highest")


def acknowledged(pieces: DataFrame) -> DataFrame:
    """By slot, the position that may be acknowledged: the greatest commit before everything that is not durable.

    pieces: (slot, commit_lsn, durable); commit_lsn of an open transaction is the position where it began.
    """
    floor = pieces.where("not durable").groupBy("slot").agg(F.min("commit_lsn").alias("floor"))
    done = pieces.where("durable").join(floor, "slot", "left").where("floor is null or commit_lsn < floor")
    return pieces.select("slot").distinct().join(done.groupBy("slot").agg(F.max("commit_lsn").alias("at")), "slot", "left")


def shed(used: Column, ceiling: Column, committed: Column, spillable: Column) -> Column:
    """What to do about memory: nothing below the ceiling; else flush what is committed, else spill open transactions, else pause intake."""
    return F.when(used < ceiling, "none").when(committed > 0, "flush").when(spillable > 0, "spill").otherwise("pause")


def paused(samples: DataFrame, pause: float = 0.85, resume: float = 0.75) -> DataFrame:
    """``samples`` (slot, seq, used, ceiling) with paused: from a sample at or over ``pause`` of the ceiling up to one below ``resume``.

    Between the two nothing changes, so the last sample outside decides.
    """
    share = F.col("used") / F.col("ceiling")
    says = F.when(share >= pause, True).when(share < resume, False)
    return samples.withColumn("paused", F.coalesce(F.last(says, ignorenulls=True).over(Window.partitionBy("slot").orderBy("seq")), F.lit(False)))
