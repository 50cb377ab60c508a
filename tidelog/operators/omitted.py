"""Values the source left out: taken from the key's history, across renames of the key, or from the mirror.

Set-based: all winners with an omitted column take one step along their lineage at a time.  A step finds the latest
rename onto the key and the latest change that set the column since then; if there is none, the mirror's row (only if
it is not older than the rename: an earlier occupant's value must not leak); else the search goes on with the
old key just before the rename.  Positions fall at each step, so it ends; rounds are as many as the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import lsn
from tidelog.plans.scratch import cut


def renames(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(new_key, old_key, at): a delete and an update at one position with different keys."""
    u = changes.where("_op = 'u'").select("_commit_lsn", "_lsn", F.struct(*keys).alias("new_key"))
    d = changes.where("_op = 'd'").select("_commit_lsn", "_lsn", F.struct(*keys).alias("old_key"))
    return u.join(d, ["_commit_lsn", "_lsn"]).where(~F.col("new_key").eqNullSafe(F.col("old_key"))).select("new_key", "old_key", lsn.pair().alias("at")).distinct()


def fill(winners: DataFrame, history: DataFrame, keys: list[str], mirror: DataFrame | None = None) -> DataFrame:
    """``winners`` with every omitted column filled; null where nothing is found."""
    listed = winners.where("_op <> 'd'").agg(F.array_distinct(F.flatten(F.collect_set("_omitted"))).alias("c")).first()["c"] or []
    columns = [c for c in winners.columns if c in listed and c not in keys]
    if not columns:
        return winners
    edges = cut(renames(history, keys))
    key = F.struct(*keys)
    history, mirror = _lineage(winners, history, keys, mirror, edges, columns)
    for column in columns:
        found = _lookup(winners, history, keys, mirror, edges, column)
        w = winners.withColumn("k_", key)
        joined = w.join(found, F.col("k_").eqNullSafe(F.col("winner")), "left")
        value = F.when(F.array_contains("_omitted", column) & (F.col("_op") != "d"), F.col("found.value")).otherwise(F.col(column))
        winners = joined.withColumn(column, value).drop("k_", "winner", "found")
    return winners


def _lineage(winners, history, keys, mirror, edges, columns) -> tuple[DataFrame, DataFrame | None]:
    """What of history and mirror belongs to keys that omitted values may come from: read once, for all columns and rounds."""
    key = F.struct(*keys)
    reach = cut(winners.where("_op <> 'd'").where(F.size("_omitted") > 0).select(key.alias("key")).distinct())
    seen = reach
    while reach.limit(1).count():
        reach = cut(reach.join(edges, F.col("key").eqNullSafe(F.col("new_key"))).select(F.col("old_key").alias("key")).distinct().join(seen.select(F.col("key").alias("k_")), F.col("key").eqNullSafe(F.col("k_")), "left_anti"))
        seen = cut(seen.union(reach))
    mine = lambda rows: rows.withColumn("l_", key).join(seen, F.col("l_").eqNullSafe(F.col("key")), "left_semi").drop("l_")
    setters = cut(mine(history.where("_op in ('i', 'u')").select(*dict.fromkeys([*keys, *columns]), "_op", "_commit_lsn", "_lsn", "_omitted")))
    return setters, None if mirror is None else cut(mine(mirror))


def _lookup(winners, history, keys, mirror, edges, column) -> DataFrame:
    """(winner, found): found is struct(value), so that a null that was set is told from nothing found."""
    key = F.struct(*keys)
    need = cut(winners.where("_op <> 'd'").where(F.array_contains("_omitted", column)).select(key.alias("winner"), key.alias("key"), lsn.pair().alias("upto")))
    setters = history.where("_op in ('i', 'u')").where(~F.array_contains("_omitted", column)).select(key.alias("s_key"), lsn.pair().alias("s_at"), F.struct(F.col(column).alias("value")).alias("value"))
    if mirror is not None:
        old = mirror.select(key.alias("m_key"), lsn.pair("_applied_commit_lsn", "_applied_lsn").alias("m_at"), F.struct(F.col(column).alias("value")).alias("m_value"))
    out, first = None, True
    while need.limit(1).count():
        before = (F.col("at") <= F.col("upto")) if first else (F.col("at") < F.col("upto"))
        step = need.join(edges, F.col("key").eqNullSafe(F.col("new_key")) & before, "left")
        step = step.groupBy("winner", "key", "upto").agg(F.max(F.when(F.col("at").isNotNull(), F.struct("at", "old_key"))).alias("edge"))
        since = F.col("edge").isNull() | (F.col("s_at") >= F.col("edge.at"))
        step = step.join(setters, F.col("key").eqNullSafe(F.col("s_key")) & (F.col("s_at") <= F.col("upto")) & since, "left")
        step = step.groupBy("winner", "key", "upto", "edge").agg(F.max_by("value", "s_at").alias("found"))
        if mirror is not None:
            alive = F.col("edge").isNull() | (F.col("m_at") >= F.col("edge.at"))
            step = step.join(old, F.col("key").eqNullSafe(F.col("m_key")) & alive, "left").withColumn("found", F.coalesce("found", "m_value"))
        step = cut(step.select("winner", "edge", "found"))
        done = step.where("found is not null").select("winner", "found")
        out = done if out is None else out.unionByName(done)
        need = cut(step.where("found is null and edge is not null").select("winner", F.col("edge.old_key").alias("key"), F.col("edge.at").alias("upto")))
        first = False
    return out if out is not None else need.select("winner", F.lit(None).cast(setters.schema["value"].dataType).alias("found"))
