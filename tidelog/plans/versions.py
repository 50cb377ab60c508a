"""The walk of a table through its schema versions: the rows of a version are applied before its successor's definition is.

A table is a :class:`Table`: mirror, log and names together.  Steps beyond columns (names, comments, the table itself) are here; those of columns are in
:mod:`tidelog.plans.evolution`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import reconcile
from tidelog.plans import evolution
from tidelog.plans.evolution import Quarantine, Step


@dataclass(frozen=True)
class Table:
    name: str
    mirror: DataFrame
    keys: list[str]
    transformed: str
    version: int = 1
    comment: str | None = None
    dropped: bool = False


def rename_column(frame: DataFrame, old: str, new: str) -> DataFrame:
    """An explicit rename, which keeps the values; a comparison of versions never assumes one."""
    if new in frame.columns:
        raise Quarantine(f"{new} is taken")
    return frame.withColumnRenamed(old, new)


def rename_table(table: Table, name: str) -> Table:
    """Another name, of the table and of its view; nothing is written."""
    return replace(table, name=name)


def drop_table(table: Table) -> Table:
    """Nothing is left, whatever comes later under the same name starts anew."""
    return replace(table, mirror=table.mirror.limit(0), dropped=True)


def comment_column(frame: DataFrame, column: str, text: str | None) -> DataFrame:
    """The column's comment, as Spark keeps comments; None takes it off."""
    kept = {k: v for k, v in frame.schema[column].metadata.items() if k != "comment"}
    return frame.withMetadata(column, kept | ({"comment": text} if text is not None else {}))


def comments(frame: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["comment"] for f in frame.schema if "comment" in f.metadata}


def steps(old: dict[str, str], new: dict[str, str], keys: list[str], retained: set[str] = frozenset()) -> list[Step]:
    """What leads from one version to the next, checked.  A key that goes or changes its type loses what rows are told apart by."""
    found = evolution.diff(old, new, retained)
    if bad := [s.column for s in found if s.column in keys and s.kind in ("drop", "retype")]:
        raise Quarantine(f"keys change: {bad}")
    return found


def walk(table: Table, log: DataFrame, versions: list[tuple[int, str, dict[str, str]]], frontier: str) -> Table:
    """Bring a table up to ``frontier``, version by version.

    versions: (version, since, columns) in order, columns by name and Spark type; log: changes with a ``version`` column, in the columns of all versions.  For each
    version from the table's own on, its definition comes first, then its changes, and the watermark moves to the position right before the next one's begin.
    A step that needs a decision stops the walk by raising :class:`Quarantine`; what has been reached before stays.
    """
    plans = {v: columns for v, _, columns in versions}
    for k, (version, since, columns) in enumerate(versions):
        if version < table.version or since > frontier:
            continue
        if version > table.version:
            before = plans[table.version]
            retained = {c for v, p in plans.items() if v < version for c in p} - set(before)
            mirror = evolution.evolve_mirror(table.mirror, steps(before, columns, table.keys, retained))
            table = replace(table, mirror=mirror, version=version)
        upto = versions[k + 1][1] if k + 1 < len(versions) and versions[k + 1][1] <= frontier else None
        mine = log.where((F.col("version") == version) & (F.col("_commit_lsn") <= frontier))
        mine = evolution.conform(mine, {c: t for c, t in columns.items()} | {m: log.schema[m].dataType.simpleString() for m in reconcile.META})
        mirror = reconcile.apply_changes(table.mirror.select(*columns, *reconcile.APPLIED), mine, table.keys, table.transformed)
        table = replace(table, mirror=mirror, transformed=upto or frontier)
    return table
