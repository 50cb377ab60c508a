"""Staged change files: writing, verified reading and validation of their rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class IntegrityError(ValueError):
    """A staged file is not what its manifest says."""


@dataclass(frozen=True)
class Expectation:
    """What a manifest says of a file's rows."""

    table: str
    epoch: int
    schema_version: int
    kind: str
    row_count: int
    low: str
    high: str


def stage(rows: DataFrame, folder: str, epoch: int, table: str) -> str:
    """Write rows as Parquet under ``epoch/table``, one folder for each schema version and a bounded number of rows in a file."""
    path = f"{folder.rstrip('/')}/{epoch}/{table.replace('.', '/')}"
    by = ["schema_version"] if "schema_version" in rows.columns else []
    rows.write.mode("append").option("compression", "snappy").option("maxRecordsPerFile", 1_000_000).partitionBy(*by).parquet(path)
    return path


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(uri, size, sha256) of whole files; executors read them, one file at a time."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("path").alias("uri"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, manifest: DataFrame) -> None:
    """Raise unless every file has the size and hash of its manifest row (uri, size, sha256)."""
    paths = [r["uri"] for r in manifest.select("uri").collect()]
    bad = manifest.alias("m").join(fingerprints(spark, paths).alias("f"), "uri", "left").where("not (m.size <=> f.size and m.sha256 <=> f.sha256)").limit(5).collect()
    if bad:
        raise IntegrityError(f"size or hash differ: {[r['uri'] for r in bad]}")


def same_shape(actual: T.StructType, wanted: T.StructType) -> list[str]:
    """Differences between a file's columns and the plan's; names, order and types must agree."""
    a, w = [(f.name, f.dataType.simpleString()) for f in actual], [(f.name, f.dataType.simpleString()) for f in wanted]
    return [f"{x} instead of {y}" for x, y in zip(a, w, strict=False) if x != y] + [f"{len(a)} columns instead of {len(w)}"] * (len(a) != len(w))


def rule_counts(rows: DataFrame, e: Expectation) -> DataFrame:
    """One row: how many rows break each rule.  rows: promoted, with ``m_`` = the parsed provenance."""
    bad_pos = ~F.col("_lsn").rlike("^[0-9A-F]{16}$") | ~F.col("_commit_lsn").rlike("^[0-9A-F]{16}$")
    rules = {
        "table": F.concat_ws(".", "m_.source_schema", "m_.source_table") != e.table, "epoch": F.col("m_.epoch") != e.epoch, "version": F.col("m_.schema_version") != e.schema_version,
        "kind": F.col("m_.kind") != e.kind, "op": ~F.col("_op").isin("i", "u", "d", "t") | ((F.col("m_.kind") != "stream") & (F.col("_op") != "i")), "position": bad_pos | (F.col("_commit_lsn") < F.col("_lsn")),
        "bounds": (F.col("_commit_lsn") < e.low) | (F.col("_commit_lsn") > e.high), "fence": (F.col("m_.kind") == "reload") & (F.col("_lsn") != F.col("_commit_lsn")), "omitted": F.col("_op").isin("d", "t") & (F.size("_omitted") > 0),
    }
    return rows.agg(F.count("*").alias("n_rows"), *(F.count_if(F.coalesce(r, F.lit(True))).alias(f"bad_{k}") for k, r in rules.items()))


def validate(raw: DataFrame, e: Expectation) -> None:
    """Raise unless all rows of a file agree with its manifest: one aggregation."""
    from tidelog.operators.reconcile import META_SCHEMA, promote

    rows = promote(raw).withColumn("m_", F.from_json("meta", META_SCHEMA))
    got = rule_counts(rows, e).first().asDict()
    broken = {k: v for k, v in got.items() if k != "n_rows" and v}
    if got["n_rows"] != e.row_count:
        broken["row_count"] = got["n_rows"]
    if broken:
        raise IntegrityError(f"{e.table}: {broken}")
