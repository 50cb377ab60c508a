"""Changes to current state: latest winner per key, guarded merge, truncates, rebuild and retention.

A ``changes`` frame has the source columns and ``_op`` (i, u, d, t), ``_commit_lsn``, ``_lsn`` and ``_omitted``, the names of
columns whose values the source left out.  A mirror has the source columns and ``_applied_commit_lsn``, ``_applied_lsn``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions import lsn

META = ("_op", "_commit_lsn", "_lsn", "_omitted")
APPLIED = ("_applied_commit_lsn", "_applied_lsn")
#: The provenance document of a raw change.
META_SCHEMA = "op string, lsn string, commit_lsn string, commit_ts string, xid long, epoch long, batch_id string, schema_version int, source_schema string, source_table string, kind string, unchanged_toast array<string>, extractor_instance string, extractor_processed_at string"


def promote(raw: DataFrame, meta: str = "meta", commit: str | None = None) -> DataFrame:
    """Columns from the provenance JSON; ``commit`` replaces the commit position of files written before the commit was known."""
    parsed = raw.withColumn("m_", F.from_json(meta, META_SCHEMA))
    return parsed.select(
        *[c for c in raw.columns if c != meta], meta, F.col("m_.op").alias("_op"), (F.lit(commit) if commit else F.col("m_.commit_lsn")).alias("_commit_lsn"),
        F.col("m_.lsn").alias("_lsn"), F.col("m_.extractor_processed_at").alias("_processed_at"), F.coalesce("m_.unchanged_toast", F.array().cast("array<string>")).alias("_omitted"),
    )


def provenance(shared: dict[str, Column], **own: Column) -> Column:
    """The provenance document of a row as JSON, in the fixed order of its fields; null fields are left out.

    shared: what all rows of a file have in common; it is folded to a constant when the query is planned.
    """
    named = shared | own
    order = [f.split()[0] for f in META_SCHEMA.split(", ")]
    if unknown := set(named) - set(order):
        raise ValueError(f"not fields of the provenance: {sorted(unknown)}")
    return F.to_json(F.struct(*(named[f].alias(f) for f in order if f in named)))


def same_key(a: str, b: str, keys: list[str]) -> Column:
    """Null-safe equality of all keys of two aliased frames."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def truncate_boundary(changes: DataFrame, after: str | None = None) -> tuple[str, str] | None:
    """The latest truncate's position, or None.  Inclusive: one right at the watermark still counts."""
    t = changes.where("_op = 't'")
    if after:
        t = t.where(F.col("_commit_lsn") >= after)
    got = t.agg(F.max(lsn.pair()).alias("b")).first()["b"]
    return (got["c"], got["l"]) if got else None


def live(changes: DataFrame, after: str | None = None, boundary: tuple[str, str] | None = None) -> DataFrame:
    """Row changes from the watermark's commit on (it is read again: the guard makes that a no-op) and after the boundary."""
    rows = changes.where("_op <> 't'")
    if after:
        rows = rows.where(F.col("_commit_lsn") >= after)
    if boundary:
        rows = rows.where(lsn.pair() > F.struct(F.lit(boundary[0]).alias("c"), F.lit(boundary[1]).alias("l")))
    return rows


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The winner of each key: greatest position; at one position a row beats a delete.

    Deletes rank too, so an older row never comes back.  What remains tied is settled by a hash of the row.
    """
    plain = [c for c in changes.columns if c not in META]
    w = Window.partitionBy(*keys).orderBy(F.desc("_commit_lsn"), F.desc("_lsn"), (F.col("_op") == "d").cast("int"), F.xxhash64(*plain))
    return changes.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def merge(mirror: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
    """The next mirror: a newer delete drops, a newer row replaces, an unmatched row inserts, all else stays."""
    columns = [c for c in mirror.columns if c not in APPLIED]
    shaped = winners.select(*[F.col(c) for c in columns], F.col("_commit_lsn").alias(APPLIED[0]), F.col("_lsn").alias(APPLIED[1]), "_op")
    m = mirror.select(*keys, F.struct(*mirror.columns).alias("old")).alias("m")
    w = shaped.select(*keys, F.struct(*columns, *APPLIED).alias("new"), "_op").alias("w")
    both = m.join(w, same_key("m", "w", keys), "full_outer").select("old", "new", "_op")
    newer = F.col("old").isNull() | (lsn.pair("new._applied_commit_lsn", "new._applied_lsn") > lsn.pair("old._applied_commit_lsn", "old._applied_lsn"))
    takes = F.col("new").isNotNull() & newer
    out = both.select(F.when(takes & (F.col("_op") == "d"), F.lit(None)).when(takes, F.col("new")).otherwise(F.col("old")).alias("row"))
    return out.where("row is not null").select("row.*")


def empty_mirror(changes: DataFrame) -> DataFrame:
    columns = [c for c in changes.columns if c not in META]
    return changes.select(*columns, F.lit(lsn.ZERO).alias(APPLIED[0]), F.lit(lsn.ZERO).alias(APPLIED[1])).limit(0)


def apply_changes(mirror: DataFrame, changes: DataFrame, keys: list[str], after: str | None = None, history: DataFrame | None = None, lookup: DataFrame | None = None) -> DataFrame:
    """One incremental step: truncates, winners, omitted values, guarded merge.

    The mirror may be the part of it that holds the changed keys; ``lookup`` is then all of it, for values that come from a key's old name.
    """
    from tidelog.operators import omitted

    boundary = truncate_boundary(changes, after)
    if boundary:
        mirror, lookup = mirror.limit(0), None
    winners = latest(live(changes, after, boundary), keys)
    scope = live(history if history is not None else changes, None, boundary)
    return merge(mirror, omitted.fill(winners, scope, keys, mirror if lookup is None else lookup), keys)


def as_changes(mirror: DataFrame) -> DataFrame:
    """A mirror as baseline insert rows at their applied positions."""
    columns = [c for c in mirror.columns if c not in APPLIED]
    return mirror.select(*columns, F.lit("i").alias("_op"), F.col(APPLIED[0]).alias("_commit_lsn"), F.col(APPLIED[1]).alias("_lsn"), F.array().cast("array<string>").alias("_omitted"))


def rebuild(changes: DataFrame, mirror: DataFrame, keys: list[str]) -> DataFrame:
    """The mirror anew from all retained changes and the old mirror as a baseline."""
    from tidelog.operators import omitted

    base = as_changes(mirror)
    boundary = truncate_boundary(changes)
    both = live(changes.select(base.columns).unionByName(base), None, boundary)
    rows = omitted.fill(latest(both, keys), both, keys, None).where("_op <> 'd'")
    columns = [c for c in mirror.columns if c not in APPLIED]
    return rows.select(*columns, F.col("_commit_lsn").alias(APPLIED[0]), F.col("_lsn").alias(APPLIED[1]))


def frontier(changes: DataFrame, after: str = lsn.ZERO) -> str | None:
    return changes.where(F.col("_commit_lsn") >= after).agg(F.max("_commit_lsn")).first()[0]


def prune(changes: DataFrame, transformed: str, lag: int) -> DataFrame:
    """Changes from the retention floor on."""
    return changes.where(F.col("_commit_lsn") >= lsn.minus(F.lit(transformed), lag))


def current(mirror: DataFrame) -> DataFrame:
    """What readers see: the mirror without its guard columns."""
    return mirror.drop(*APPLIED)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one frame and not the other, as multisets, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
