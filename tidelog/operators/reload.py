"""Reload: a whole table anew, beside the running mirror."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import reconcile

STATES = {"requested": {"exporting", "failed"}, "exporting": {"export_complete", "requested", "failed"}, "export_complete": {"publishing", "failed"}, "publishing": {"complete", "failed"}, "complete": set(), "failed": set()}


def advance(state: str, to: str) -> str:
    if to not in STATES[state]:
        raise ValueError(f"no way from {state} to {to}")
    return to


def stamp(rows: DataFrame, fence: str) -> DataFrame:
    """A table scan as baseline inserts at the fence."""
    return rows.select("*", F.lit("i").alias("_op"), F.lit(fence).alias("_commit_lsn"), F.lit(fence).alias("_lsn"), F.array().cast("array<string>").alias("_omitted"))


def shadow(baseline: DataFrame, fence: str, changes: DataFrame | None, keys: list[str]) -> DataFrame:
    """The table at the fence with the changes after it; history at or before the fence is not used.

    An empty baseline clears the table.
    """
    base = stamp(baseline, fence)
    mirror = reconcile.merge(reconcile.empty_mirror(base), base, keys)
    if changes is None:
        return mirror
    return reconcile.apply_changes(mirror, changes.where(F.col("_commit_lsn") > fence), keys)


def route_file(kind: str, reload_state: str | None, lsn_end: str, fence: str | None) -> str:
    """Where a staged file goes: live, shadow, retire or superseded."""
    if kind == "reload":
        return "shadow" if reload_state in ("export_complete", "publishing") else "retire"
    if fence is not None and lsn_end <= fence:
        return "superseded"
    return "shadow" if reload_state in ("export_complete", "publishing") else "live"


def requested(requests: DataFrame, published: DataFrame, live: DataFrame) -> DataFrame:
    """(table, requested_at, asked) of the reloads to begin: one for each table, whoever asked how often.

    requests: (table, requested_at), where a null table asks for all published ones; published: (table); live: (table) under a reload already, which begin none.
    """
    every = requests.where("table is null").select("requested_at").crossJoin(F.broadcast(published.select("table").distinct()))
    named = requests.where("table is not null").select("requested_at", "table").join(published.select("table").distinct(), "table", "left_semi").select("requested_at", "table")
    asked = named.unionByName(every).groupBy("table").agg(F.min("requested_at").alias("requested_at"), F.count("*").alias("asked"))
    return asked.join(live.select("table").distinct(), "table", "left_anti")


def next_state(state: Column, exported: Column, sealed: Column, lost: Column, tries: Column, most: int = 3) -> Column:
    """What a reload does next.  A snapshot that is lost, or a definition that changed meanwhile, restarts it, ``most`` times."""
    again = F.when(tries < most, "requested").otherwise("failed")
    ended = state.isin("complete", "failed")
    return (
        F.when(ended, state).when(lost & state.isin("exporting", "export_complete"), again).when(state == "requested", "exporting")
        .when((state == "exporting") & exported & sealed, "export_complete").when((state == "exporting") & exported, again).when(state == "export_complete", "publishing").when(state == "publishing", "complete").otherwise(state)
    )


def markers(exports: DataFrame, appended: DataFrame) -> DataFrame:
    """(reload_id, table, fence, end, ready): the end fence is the greatest position any worker saw when it ended; a reload may be published once the log
    has been appended up to it, so that no change between the two fences is missing.

    exports: (reload_id, table, fence, worker_end); appended: (table, raw_appended).
    """
    end = exports.groupBy("reload_id", "table").agg(F.max("fence").alias("fence"), F.max("worker_end").alias("end"))
    return end.join(appended, "table", "left").select("reload_id", "table", "fence", F.greatest("end", "fence").alias("end"), F.coalesce(F.col("raw_appended") >= F.greatest("end", "fence"), F.lit(False)).alias("ready"))


def route_files(files: DataFrame, reloads: DataFrame) -> DataFrame:
    """``files`` (table, kind, lsn_end) with route: live, shadow, retire or superseded.  reloads: (table, state, fence), one a table."""
    r = reloads.select(F.col("table").alias("t_"), F.col("state").alias("s_"), "fence")
    shadow = F.coalesce(F.col("s_").isin("export_complete", "publishing"), F.lit(False))
    route = F.when((F.col("kind") == "reload") & shadow, "shadow").when(F.col("kind") == "reload", "retire").when(F.col("lsn_end") <= F.col("fence"), "superseded").when(shadow, "shadow").otherwise("live")
    return files.join(r, F.col("table") == F.col("t_"), "left").withColumn("route", route).drop("t_", "s_", "fence")
