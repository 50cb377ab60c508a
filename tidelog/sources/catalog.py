"""The source's catalog and the registry of table versions: which tables are published, with which columns, since when.

A catalog is a frame of columns: (schema, table, ordinal, column, type, modifier, is_key, comment, published), as a source's system tables tell or a JSON file
holds.  A registry is a frame of versions: (table, version, since, definition), where definition is the fingerprint of a description.  Descriptions are kept once
each, whatever number of statements and versions have them: (definition, columns, comment), with all columns as an array.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions import parsers
from tidelog.plans.types import PlanError, SourceColumn, TablePlan

CATALOG = "schema string, table string, ordinal int, column string, type string, modifier int, is_key boolean, comment string, published boolean"
COLUMNS = "array<struct<ordinal:int,name:string,type:string,modifier:int,is_key:boolean,comment:string>>"
REGISTRY = "table string, version long, since string, definition string"
DEFINITIONS = f"definition string, columns {COLUMNS}, comment string"
#: Frames of up to so many rows are broadcast, which a count checks.
SMALL = 100_000
#: Of tables' names; any fixed identifier serves, as long as it never changes.
NAMESPACE = uuid.UUID("6f1d1c52-8a1e-5b0e-9d3c-0b7c6f3f2a10")
BARE = re.compile(r"^[a-z_][a-z0-9_]*$")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A catalog from JSON lines."""
    return spark.read.schema(CATALOG).json(path)


def tables(catalog: DataFrame) -> DataFrame:
    """(table, columns, n_keys, published) of each table of a catalog, its columns in order.  A table is published if all its columns are."""
    column = F.struct("ordinal", F.col("column").alias("name"), "type", "modifier", "is_key", "comment")
    name = F.concat_ws(".", "schema", "table")
    return catalog.groupBy(name.alias("table")).agg(F.array_sort(F.collect_list(column)).alias("columns"), F.count_if("is_key").alias("n_keys"), F.bool_and(F.coalesce("published", F.lit(False))).alias("published"))


def uncovered(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """(table, why) of wanted tables that cannot be mirrored: absent, not published whole, or without a key.  wanted: (table)."""
    found = tables(catalog)
    why = F.when(F.col("columns").isNull(), "absent").when(~F.col("published"), "not published").when(F.col("n_keys") == 0, "no key")
    return wanted.select("table").distinct().join(found, "table", "left").select("table", why.alias("why")).where("why is not null")


def plan(columns: list) -> TablePlan:
    """The physical plan of a table from its columns, as a registry or :func:`tables` has them."""
    out = []
    for c in sorted(columns, key=lambda c: c["ordinal"]):
        mod = c["modifier"]
        packed = mod - 4 if c["type"] == "numeric" and mod is not None and mod >= 4 else None
        out.append(SourceColumn(c["name"], c["type"], bool(c["is_key"]), None if packed is None else packed >> 16 & 0xFFFF, None if packed is None else packed & 0xFFFF))
    return TablePlan(out)


def describe(catalog: DataFrame) -> DataFrame:
    """``catalog`` with precision and scale of its numeric columns, from their packed modifiers."""
    d = F.when(F.col("type") == "numeric", parsers.numeric_modifier(F.col("modifier")))
    return catalog.withColumn("precision", d["precision"]).withColumn("scale", d["scale"])


def namespace(table: Column) -> Column:
    """The stable internal name of a table: a name-based identifier (version 5) of schema and table, parted by a zero byte."""
    h = F.sha1(F.concat(F.lit(bytearray(NAMESPACE.bytes)), F.encode(F.regexp_replace(table, r"\.", "\0"), "UTF-8")))
    third = F.concat(F.lit("5"), F.substring(h, 14, 3))
    nibble = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), third, F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def latest(registry: DataFrame) -> DataFrame:
    """The latest version of each table."""
    return registry.groupBy("table").agg(F.max_by(F.struct("version", "since", "definition"), "version").alias("v")).select("table", "v.*")


def define(described: DataFrame) -> DataFrame:
    """``described`` (with columns, comment) with ``definition``, the fingerprint that tells descriptions apart."""
    return described.withColumn("definition", F.sha2(F.to_json(F.struct("columns", "comment")), 256))


def described(registry: DataFrame, definitions: DataFrame) -> DataFrame:
    """The registry with columns and comment of each version.  Versions go to the descriptions, not the other way: those are larger by far."""
    r = F.broadcast(registry) if registry.limit(SMALL + 1).count() <= SMALL else registry
    return definitions.join(r, "definition").select(*registry.columns, "columns", "comment")


def conflicts(registry: DataFrame, new: DataFrame) -> DataFrame:
    """(table, version) of ``new`` that the registry holds with other columns.  The same again is no conflict: publishing twice is allowed."""
    r = registry.select("table", "version", F.col("definition").alias("held"))
    return new.select("table", "version", F.col("definition").alias("now")).join(r, ["table", "version"]).where("held <> now").select("table", "version")


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with ``new`` versions put in where they are absent; one that is there with other columns is an error."""
    clash = conflicts(registry, new).limit(5).collect()
    if clash:
        raise PlanError(f"versions that differ from what is registered: {[tuple(r) for r in clash]}")
    return registry.unionByName(new.join(registry.select("table", "version"), ["table", "version"], "left_anti").select(registry.columns))


def captured(audit: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(table, tag, lsn, commit_lsn, definition) of definition changes that took effect: those of committed transactions, without rolled back parts.

    audit: (top_xid, xid, lsn, tag, table, definition), where definition is that of the source's own description right after the statement (see :func:`define`).
    """
    from tidelog.operators.routing import commit_gate

    return commit_gate(audit, outcomes).select("table", "tag", "lsn", F.col("_commit_lsn").alias("commit_lsn"), "definition")


def versions(changes: DataFrame) -> DataFrame:
    """A registry from captured changes: a new version wherever the columns of a table (or its comment) differ from those before; since is its commit.

    Of several statements of one commit the last one counts, as no row can lie between them.
    """
    last = changes.groupBy("table", "commit_lsn").agg(F.max_by("definition", "lsn").alias("definition"))
    w = Window.partitionBy("table").orderBy("commit_lsn")
    changed = last.withColumn("before_", F.lag("definition").over(w)).where("before_ is null or before_ <> definition")
    return changed.select("table", F.row_number().over(w).cast("long").alias("version"), F.col("commit_lsn").alias("since"), "definition")


def version_at(rows: DataFrame, registry: DataFrame, position: str = "_commit_lsn") -> DataFrame:
    """``rows`` (table, position) with the version that held there: the last one since then.

    Rows and versions are put in order together, so a table's number of versions does not multiply with its number of rows.
    """
    from tidelog.operators.routing import running_last

    marks = registry.groupBy("table", F.col("since").alias(position)).agg(F.max("version").alias("version"))
    both = rows.select("table", position, F.struct("*").alias("row_")).unionByName(marks, allowMissingColumns=True)
    return running_last(both, "table", position, F.col("version"), "at_").where("row_ is not null").select("row_.*", F.col("at_").alias("version"))


def quoted(name: str) -> str:
    """A name as an identifier of SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str | None) -> str:
    """A string as a literal of SQL text."""
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def relation(name: str) -> tuple[str, str]:
    """schema and table of a relation's name; both must be bare."""
    parts = name.split(".")
    if len(parts) != 2 or not all(BARE.match(p) for p in parts):
        raise PlanError(f"not a bare schema and table: {name!r}")
    return parts[0], parts[1]
