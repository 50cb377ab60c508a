"""Schema versions: what changed between two, and what that does to the log and the mirror."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Type changes that lose nothing.
WIDENS = {("smallint", "int"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double")}


class Quarantine(ValueError):
    """A change that needs a decision; the table stops until it is made."""


@dataclass(frozen=True)
class Step:
    kind: str  # add, drop, widen, retype
    column: str
    type: str | None = None


def diff(old: dict[str, str], new: dict[str, str], retained: set[str] = frozenset()) -> list[Step]:
    """Steps from one version (column to Spark type, in order) to the next.

    Adding and destroying in one step, another name at a common place, a changed order, and a name the log still holds from a dropped column are quarantined.
    """
    gone, added = [c for c in old if c not in new], [c for c in new if c not in old]
    if gone and added:
        same_place = [a for a, b in zip(old, new, strict=False) if a != b and a in gone and b in added]
        raise Quarantine(f"renamed or replaced: {same_place or gone} by {added}")
    if [c for c in old if c in new] != [c for c in new if c in old]:
        raise Quarantine("columns changed their order")
    if reused := [c for c in added if c in retained]:
        raise Quarantine(f"names still held by the log: {reused}")
    changed = [c for c in new if c in old and old[c] != new[c]]
    steps = [Step("add", c, new[c]) for c in added] + [Step("drop", c) for c in gone]
    steps += [Step("widen" if (old[c], new[c]) in WIDENS else "retype", c, new[c]) for c in changed]
    if added and any(s.kind == "retype" for s in steps):
        raise Quarantine("adds and retypes in one step")
    return steps


def evolve_mirror(mirror: DataFrame, steps: list[Step]) -> DataFrame:
    """A dropped column goes; a retyped one is cast, and a value that does not fit is an error."""
    for s in steps:
        if s.kind == "add":
            mirror = mirror.withColumn(s.column, F.lit(None).cast(s.type))
        elif s.kind == "drop":
            mirror = mirror.drop(s.column)
        elif s.kind == "widen":
            mirror = mirror.withColumn(s.column, F.col(s.column).cast(s.type))
        else:
            if misfits(mirror, s.column, s.type):
                raise Quarantine(f"values of {s.column} do not fit {s.type}")
            mirror = mirror.withColumn(s.column, F.col(s.column).try_cast(s.type))
    return mirror


def misfits(df: DataFrame, column: str, kind: str) -> int:
    """Values that a cast would lose."""
    return df.where(F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()).count()


def evolve_log(log: DataFrame, steps: list[Step]) -> DataFrame:
    """The log keeps dropped columns; a retyped one becomes text and is never cast back."""
    for s in steps:
        if s.kind == "add":
            log = log.withColumn(s.column, F.lit(None).cast(s.type))
        elif s.kind == "widen":
            log = log.withColumn(s.column, F.col(s.column).cast(s.type))
        elif s.kind == "retype":
            log = log.withColumn(s.column, F.col(s.column).cast("string"))
    return log


def conform(file_rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Rows of an older file in the log's present columns; what the file lacks is null."""
    return file_rows.select(*((F.col(c).cast(t) if c in file_rows.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()))
