"""Work queue of staged files: claims of whole units within a budget, validation, supersession, lag."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def units(files: DataFrame) -> DataFrame:
    """One row for each unit: the files of a stream group, or one file.

    files: (id, table, kind, lsn_end, row_count, group_id, ordinal, group_files, status).  A group is valid if its ordinals are 0 to
    n - 1, it has all its files, all are ready and their positions agree.
    """
    unit = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("f"), F.col("id").cast("string")))
    g = files.groupBy("table", unit.alias("unit")).agg(
        F.min("id").alias("first_id"), F.max("lsn_end").alias("lsn_end"), F.min("lsn_end").alias("lsn_low"), F.min("kind").alias("kind"), F.count("*").alias("n_files"), F.sum("row_count").alias("n_rows"),
        F.count_distinct("ordinal").alias("ordinals"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.max("group_files").alias("group_files"),
        F.bool_and(F.col("status") == "ready").alias("ready"), F.first("group_id").isNotNull().alias("grouped"),
        F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "id"))), lambda x: F.concat_ws(":", x["ordinal"].cast("string"), x["id"].cast("string")))), 256).alias("shape"),
    )
    whole = (F.col("low") == 0) & (F.col("high") == F.col("n_files") - 1) & (F.col("ordinals") == F.col("n_files")) & (F.col("group_files") == F.col("n_files")) & (F.col("lsn_low") == F.col("lsn_end"))
    return g.select("table", "unit", "first_id", "lsn_end", "kind", "n_files", "n_rows", "shape", (F.col("ready") & (~F.col("grouped") | whole)).alias("valid"))


def claim(files: DataFrame, budget_files: int, budget_rows: int, paused: DataFrame | None = None) -> DataFrame:
    """Units to take, by table in the order (lsn_end, kind, id): the first always, then while the sum before is within the budgets.

    An invalid unit stops its table: nothing behind it is taken.  ``paused`` tables (under a reload) are left out.
    """
    u = units(files)
    if paused is not None:
        u = u.join(paused.select("table").distinct(), "table", "left_anti")
    before = Window.partitionBy("table").orderBy("lsn_end", "kind", "first_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("table").orderBy("lsn_end", "kind", "first_id").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("files_before", F.coalesce(F.sum("n_files").over(before), F.lit(0))).withColumn("rows_before", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).withColumn("blocked", F.bool_or(~F.col("valid")).over(upto))
    fits = (F.col("files_before") == 0) | ((F.col("files_before") + F.col("n_files") <= budget_files) & (F.col("rows_before") + F.col("n_rows") <= budget_rows))
    return u.where(fits & ~F.col("blocked")).select("table", "unit", "lsn_end", "n_files", "n_rows")


def superseded(files: DataFrame, fences: DataFrame) -> DataFrame:
    """Files of a reloaded table at or before its fence, other than the reload's own.  fences: (table, fence)."""
    return files.join(fences, "table").where((F.col("kind") != "reload") & (F.col("lsn_end") <= F.col("fence"))).select("id", "table")


def unseen(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files without a receipt in the ledger."""
    return files.join(ledger.select("uri").distinct(), "uri", "left_anti")


def lag(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """By table: bytes between the last ready file and what has been appended."""
    from tidelog.functions import lsn

    last = files.where("status = 'ready'").groupBy("table").agg(F.max("lsn_end").alias("last"))
    return checkpoints.join(last, "table", "left").select("table", F.when(F.col("last").isNotNull(), lsn.distance(F.col("last"), F.col("raw_appended"))).otherwise(0).cast("long").alias("lag"))


def seal(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """By reload: whether all its ranges are complete and their totals agree with the files staged.

    files: (reload_id, row_count); ranges: (reload_id, done, n_files, n_rows).
    """
    f = files.groupBy("reload_id").agg(F.count("*").alias("staged_files"), F.sum("row_count").alias("staged_rows"))
    r = ranges.groupBy("reload_id").agg(F.bool_and("done").alias("complete"), F.sum("n_files").alias("n_files"), F.sum("n_rows").alias("n_rows"))
    agree = (F.coalesce("staged_files", F.lit(0)) == F.col("n_files")) & (F.coalesce("staged_rows", F.lit(0)) == F.col("n_rows"))
    return r.join(f, "reload_id", "left").select("reload_id", "n_files", "n_rows", (F.col("complete") & agree).alias("sealed"))


def owner(table: str, workers: list[str]) -> str:
    """The worker with the highest hash for a table; a worker's leaving moves only its own tables."""
    return max(workers, key=lambda w: (hashlib.sha256(f"{table}\0{w}".encode()).digest(), w))


def owners(table: Column, workers: list[str]) -> Column:
    """:func:`owner` of a column of tables."""
    ranked = F.array(*(F.struct(F.sha2(F.concat(table, F.lit("\0"), F.lit(w)), 256).alias("h"), F.lit(w).alias("w")) for w in sorted(workers)))
    return F.array_max(ranked)["w"]


def scan_ranges(blocks: int, workers: int, each: int = 4) -> list[tuple[int, int | None]]:
    """Contiguous disjoint page ranges, ``each`` for a worker; the last is open-ended."""
    n = max(1, min(blocks, workers * each))
    cuts = [blocks * i // n for i in range(n)]
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]


def restart(slot: str) -> str:
    """What to do at start, by the state of the replication slot."""
    return {"healthy": "resume", "absent": "fresh", "invalidated": "fresh", "unreachable": "retry"}[slot]


class Backpressure:
    """Pauses intake above one share of the ceiling, resumes below a smaller one."""

    def __init__(self, ceiling: int, pause: float = 0.85, resume: float = 0.75):
        self.ceiling, self.pause, self.resume, self.paused = ceiling, pause, resume, False

    def update(self, used: int) -> bool:
        self.paused = used >= self.ceiling * (self.resume if self.paused else self.pause)
        return self.paused
