"""Structured Streaming driver: staged change files to the mirror, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidelog.sources.store import TableStore


def watch(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 32) -> DataFrame:
    """New change files of a folder as a stream, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def mirror_stream(changes: DataFrame, store: TableStore, keys: list[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch to the log, then bring the mirror up to date.

    A batch's number is its entry in the ledger: a batch that runs again after a crash appends nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        high = batch.agg(F.max("_commit_lsn")).first()[0]
        if high is not None:
            store.append({f"batch-{number}": batch}, high)
        store.transform(keys)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


FRAME = "slot string, seq long, data binary"


def record(frames: DataFrame, folder: str, rows_per_file: int = 100_000) -> None:
    """Keep frames (slot, seq, data) as files, in order, for :func:`replay`."""
    frames.select("slot", "seq", "data").repartitionByRange("slot", "seq").sortWithinPartitions("slot", "seq").write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(folder)


def replay(spark: SparkSession, folder: str, files_per_batch: int = 32) -> DataFrame:
    """Recorded frames as a stream.  A source's connection writes such files; a batch holds some of them, and their order is in ``seq``."""
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drain(query: StreamingQuery, seconds: float = 60.0) -> bool:
    """Stop a stream after the batch that is under way; true if it ended in time.  What it had not published is not there, and the next start does it again."""
    try:
        query.processAllAvailable() if query.isActive and seconds > 0 else None
    finally:
        query.stop()
    return not query.isActive


def cancellable(spark: SparkSession, group: str, work):
    """Run ``work`` so that :func:`cancel` can end its jobs.  A cancelled step has published nothing: None is returned and the state is as before."""
    from py4j.protocol import Py4JJavaError

    spark.sparkContext.setJobGroup(group, group, True)
    try:
        return work()
    except Py4JJavaError as e:
        if "cancel" in str(e.java_exception).lower():
            return None
        raise
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def cycle(store: TableStore, keys: list[str], files: dict[str, DataFrame], position: str, comments: dict[str, str] | None = None, compact_every: int = 0) -> dict:
    """One round of the poll loop: append new files, take over comments, bring the mirror up to date, and now and then put the log's batches together."""
    state = store.append(files, position) if files else store.state()
    if comments is not None:
        state = store.comment(comments)
    state = store.transform(keys)
    if compact_every and len(state["batches"]) >= compact_every:
        state = store.compact()
    return state
