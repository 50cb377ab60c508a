"""A bounded, repeatable sample of labelled documents, for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most.  The only bound; scoring covers all rows.
SAMPLE_ROWS = 12_000


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents outside fold ``held``, chosen by a hash of the id.

    Rows with a null id, label or text are left out, and an id counts once.
    """
    usable = labels.select(F.col("doc_id").alias("id_"), F.col(label).cast("int").alias("y")).where("id_ is not null and y is not null").where(fold("id_", folds) != held)
    chosen = usable.orderBy(F.xxhash64("id_"), "id_", "y").limit(rows).dropDuplicates(["id_"])
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("id_"), "inner").select("text", "y")


def in_slices(measure, texts: pa.Array, rows: int = 256) -> np.ndarray:
    """``measure`` of a few texts at a time, which bounds a worker's memory."""
    parts = [measure(texts.slice(k, rows).to_pylist()) for k in range(0, len(texts), rows)]
    return np.vstack(parts) if parts else measure([])
