"""The queue of staged files: writing a file under its own key, publishing its row, claiming under a lease, retiring what has been ingested.

A manifest is a frame of rows (id, epoch, table, kind, uri, row_count, size, sha256, lsn_start, lsn_end, schema_version, group_id, ordinal, group_files, reload_id,
status).  The operators here are pure: they return the next manifest or its parts, and :class:`Queue` keeps it in numbered documents beside each
other, of which each is published by creating it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidelog.operators import claim
from tidelog.sources import staging
from tidelog.sources.store import Conflict

ROW = "id long, epoch long, table string, kind string, uri string, row_count long, size long, sha256 string, lsn_start string, lsn_end string, schema_version long, group_id string, ordinal int, group_files int, reload_id string, status string"


def object_key(epoch: int, table: str, position: str, name: str | None = None) -> str:
    """epoch/schema/table/position-name.parquet: no two files share one, and a listing of a table is in the order of positions."""
    return f"{epoch}/{table.replace('.', '/')}/{position}-{name or uuid.uuid4()}.parquet"


def export(rows: DataFrame, folder: str, epoch: int, table: str, position: str, max_rows: int = 1_000_000) -> DataFrame:
    """Write ``rows`` as files of at most ``max_rows`` under one key, side by side, and return their manifest part: (uri, row_count, size, sha256).

    The folder of a key is written once; a task that runs again replaces its own file only, by Spark's commit protocol, and a failed export leaves nothing
    that a manifest names.
    """
    spark = rows.sparkSession
    path = f"{folder.rstrip('/')}/{object_key(epoch, table, position)}"
    rows.write.option("compression", "snappy").option("maxRecordsPerFile", max_rows).parquet(path)
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("uri")).agg(F.count("*").alias("row_count"))
    return counts.join(staging.fingerprints(spark, [f"{path}/*.parquet"]), "uri")


def scan(spark: SparkSession, table: str, key: str, low: int, high: int, parts: int) -> list[DataFrame]:
    """A table as disjoint ranges of an integer key that cover it; the last one is open, as is the first one downwards."""
    cuts = [low + (high - low) * i // parts for i in range(1, parts)]
    whole, out = spark.read.parquet(table), []
    for a, b in zip([None, *cuts], [*cuts, None], strict=True):
        part = whole if a is None else whole.where(F.col(key) >= a)
        out.append(part if b is None else part.where(F.coalesce(F.col(key) < b, F.lit(a is None))))
    return out


def published(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest with ``rows``, ready to claim.  A file that is there already with the same content stays as it is; with another one it is an error."""
    same = F.col("m.sha256").eqNullSafe(F.col("r.sha256")) & F.col("m.row_count").eqNullSafe(F.col("r.row_count")) & F.col("m.lsn_end").eqNullSafe(F.col("r.lsn_end"))
    clash = manifest.alias("m").join(rows.alias("r"), "uri").where(~same).select("uri").limit(5).collect()
    if clash:
        raise Conflict(f"published before with other content: {[r['uri'] for r in clash]}")
    return manifest.unionByName(rows.withColumn("status", F.lit("ready")).join(manifest.select("uri"), "uri", "left_anti").select(manifest.columns))


def barrier(table: str, schema_version: int, position: str, unit: int) -> tuple:
    """A row without a file: what lies behind it belongs to a later version of the table."""
    return (unit, None, table, "schema", None, 0, 0, None, position, position, schema_version, None, 0, 1, None, "ready")


def units(manifest: DataFrame) -> DataFrame:
    """The units of a manifest (see :func:`tidelog.operators.claim.units`); a barrier is a unit of no file."""
    u = claim.units(manifest)
    files = manifest.groupBy("table", F.coalesce(F.concat(F.lit("g"), F.col("group_id")), F.concat(F.lit("f"), F.col("id").cast("string"))).alias("unit")).agg(F.count("uri").alias("files"), F.max("schema_version").alias("schema_version"))
    return u.join(files, ["table", "unit"]).withColumn("n_files", F.col("files")).drop("files")


def upto_barrier(claimed: DataFrame) -> DataFrame:
    """Claimed units of a table up to its first barrier, that one included: what lies behind waits until the version has been taken."""
    before = Window.partitionBy("table").orderBy("lsn_end", "kind", "first_id").rowsBetween(Window.unboundedPreceding, -1)
    return claimed.withColumn("b_", F.coalesce(F.bool_or(F.col("kind") == "schema").over(before), F.lit(False))).where("not b_").drop("b_")


def owned(files: DataFrame, leases: DataFrame, worker: str, now: float) -> DataFrame:
    """Files of tables that ``worker`` holds a live lease of, with its fencing token.  leases: (table, owner, token, expires)."""
    mine = leases.where((F.col("owner") == worker) & (F.col("expires") > F.lit(now))).select("table", "token")
    return files.join(mine, "table")


def retired(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest without the files of ingested units.  done: (table, unit).  A unit of which a part is gone already is an error."""
    unit = F.coalesce(F.concat(F.lit("g"), F.col("group_id")), F.concat(F.lit("f"), F.col("id").cast("string")))
    held = manifest.withColumn("unit", unit)
    part = held.join(done.select("table", "unit"), ["table", "unit"], "left_semi").groupBy("table", "unit").agg(F.count("*").alias("n"), F.max(F.when(F.col("group_id").isNotNull(), F.col("group_files")).otherwise(1)).alias("of")).where("n <> of").limit(5).collect()
    if part:
        raise Conflict(f"units that are not whole: {[r['unit'] for r in part]}")
    return held.join(done.select("table", "unit"), ["table", "unit"], "left_anti").select(manifest.columns)


def reconciled(manifest: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: whether the files of a manifest and what the exporters counted agree.  stats: (n_files, n_rows, ...), summed to one row beside the manifest's."""
    a = manifest.agg(F.count("uri").alias("files"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"))
    b = stats.agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    return a.crossJoin(F.broadcast(b)).select("files", "rows", "n_files", "n_rows", ((F.col("files") == F.col("n_files")) & (F.col("rows") == F.col("n_rows"))).alias("agree"))


class Queue:
    """A manifest that is kept in a table store: each change is its next numbered document."""

    def __init__(self, store):
        self.store = store

    def _step(self) -> int:
        numbers = self.store._numbers("manifest")
        return numbers[-1] if numbers else 0

    def manifest(self) -> DataFrame:
        step = self._step()
        spark = self.store.spark
        schema = T._parse_datatype_string(ROW)
        if not step:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.store.path}/{self.store.load(f'manifest/{step:012d}.json')['path']}")

    def replace(self, after: int, manifest: DataFrame) -> None:
        """Publish the next manifest, made from the one numbered ``after``; fails if another writer was faster."""
        path = f"manifest-rows/{after + 1:012d}-{uuid.uuid4().hex}"
        manifest.write.parquet(f"{self.store.path}/{path}")
        if not self.store.create(f"manifest/{after + 1:012d}.json", {"path": path, "token": self.store.token}):
            raise Conflict(f"manifest {after + 1} is already published")

    def publish(self, rows: DataFrame) -> None:
        step = self._step()
        self.replace(step, published(self.manifest(), rows))

    def retire(self, done: DataFrame) -> None:
        step = self._step()
        self.replace(step, retired(self.manifest(), done))

