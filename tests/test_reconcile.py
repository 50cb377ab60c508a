import pytest
from pyspark.sql import functions as F

from tidelog.operators import omitted, reconcile, reload

SCHEMA = "id int, status string, _op string, _commit_lsn string, _lsn string, _omitted array<string>"


def changes(spark, *rows):
    """rows: (id, op, commit, lsn, status[, omitted])."""
    return spark.createDataFrame([(r[0], r[4], r[1], f"{r[2]:016X}", f"{r[3]:016X}", list(r[5]) if len(r) > 5 else []) for r in rows], SCHEMA)


def state(df):
    return sorted((r["id"], r["status"]) for r in reconcile.current(df).collect())


def once(spark, *rows, keys=("id",)):
    ch = changes(spark, *rows)
    return reconcile.apply_changes(reconcile.empty_mirror(ch), ch, list(keys))


def test_lifecycle(spark):
    assert state(once(spark, (1, "i", 1, 1, "a"), (1, "d", 2, 2, None), (1, "i", 3, 3, "b"), (2, "i", 1, 1, "x"), (2, "d", 4, 4, None), (3, "d", 5, 5, None))) == [(1, "b")]


def test_older_row_never_returns(spark):
    first = once(spark, (1, "i", 1, 1, "a"), (1, "u", 5, 5, "new"))
    assert state(reconcile.apply_changes(first, changes(spark, (1, "u", 4, 4, "stale")), ["id"])) == [(1, "new")]
    assert state(once(spark, (1, "d", 9, 9, None), (1, "u", 8, 8, "old"))) == []


def test_tie_prefers_row(spark):
    assert state(once(spark, (1, "d", 2, 2, None), (1, "u", 2, 2, "kept"))) == [(1, "kept")]


def test_same_batch_twice_is_a_no_op(spark):
    ch = changes(spark, (1, "i", 1, 1, "a"), (1, "u", 2, 2, None, ["status"]), (2, "i", 3, 3, "b"), (2, "d", 4, 4, None))
    one = reconcile.apply_changes(reconcile.empty_mirror(ch), ch, ["id"])
    assert sorted(one.collect()) == sorted(reconcile.apply_changes(one, ch, ["id"]).collect())


def test_truncate(spark):
    assert state(once(spark, (1, "i", 1, 1, "a"), (None, "t", 2, 2, None), (2, "i", 2, 3, "same commit"), (3, "i", 3, 4, "later"))) == [(2, "same commit"), (3, "later")]
    assert reconcile.truncate_boundary(changes(spark, (None, "t", 2, 2, None)), f"{2:016X}") == (f"{2:016X}", f"{2:016X}")


def test_omitted_value_from_batch_mirror_and_real_null(spark):
    assert state(once(spark, (1, "i", 1, 1, "a"), (1, "u", 2, 2, None, ["status"]))) == [(1, "a")]
    assert state(once(spark, (1, "i", 1, 1, "a"), (1, "u", 2, 2, None), (1, "u", 3, 3, None, ["status"]))) == [(1, None)]
    first = once(spark, (1, "i", 1, 1, "a"))
    tail = changes(spark, (1, "u", 2, 2, None, ["status"]))
    assert state(reconcile.apply_changes(first, tail, ["id"])) == [(1, "a")]


def test_rename_chain_of_three_and_key_reuse(spark):
    rows = [(1, "i", 1, 1, "deep")]
    for n in (1, 2, 3):
        rows += [(n, "d", n + 1, n + 1, None), (n + 1, "u", n + 1, n + 1, None, ["status"])]
    assert state(once(spark, *rows)) == [(4, "deep")]
    # Key 2 was another row before: its value must not leak into the renamed one, from the log or from the mirror.
    old = once(spark, (2, "i", 1, 1, "other"))
    tail = changes(spark, (2, "d", 2, 2, None), (1, "d", 3, 3, None), (2, "u", 3, 3, None, ["status"]))
    assert state(reconcile.apply_changes(old, tail, ["id"])) == [(2, None)]
    assert omitted.renames(tail, ["id"]).count() == 1


def test_rebuild_equals_incremental_after_pruning(spark):
    ch = changes(spark, (1, "i", 1, 1, "a"), (2, "i", 2, 2, "b"), (1, "u", 20, 20, None, ["status"]), (2, "d", 21, 21, None), (3, "i", 22, 22, "c"))
    mirror = reconcile.apply_changes(reconcile.empty_mirror(ch), ch, ["id"])
    kept = reconcile.prune(ch, f"{22:016X}", 2)
    assert kept.count() == 3
    assert state(reconcile.rebuild(kept, mirror, ["id"])) == state(mirror) == [(1, "a"), (3, "c")]


def test_null_key_and_all_key_table(spark):
    ch = changes(spark, (None, "i", 1, 1, "n"), (None, "u", 2, 2, "m"))
    one = reconcile.apply_changes(reconcile.empty_mirror(ch), ch, ["id"])
    assert [(r["id"], r["status"]) for r in one.collect()] == [(None, "m")]
    wide = reconcile.apply_changes(reconcile.empty_mirror(ch), ch, ["id", "status"])
    assert wide.count() == 2


def test_parity_and_reload(spark):
    a = once(spark, (1, "i", 1, 1, "a"), (2, "i", 1, 1, "b"))
    assert reconcile.differences(reconcile.current(a), reconcile.current(a)).count() == 0
    base = spark.createDataFrame([(7, "base"), (8, "base")], "id int, status string")
    after = changes(spark, (7, "d", 4, 4, None), (9, "i", 6, 6, "late"), (8, "d", 11, 11, None))
    got = reload.shadow(base, f"{5:016X}", after, ["id"])
    assert state(got) == [(7, "base"), (9, "late")]
    assert reload.shadow(base.limit(0), f"{5:016X}", None, ["id"]).count() == 0
    assert reload.route_file("stream", None, f"{4:016X}", f"{5:016X}") == "superseded"
    with pytest.raises(ValueError):
        reload.advance("complete", "exporting")


def test_winner_plan_limits_groups(spark):
    ch = changes(spark, (1, "i", 1, 1, "a"))
    plan = reconcile.latest(ch, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_promote(spark):
    raw = spark.createDataFrame([(1, '{"op":"u","lsn":"A","commit_lsn":"B","unchanged_toast":["x"]}')], "id int, meta string")
    r = reconcile.promote(raw).first()
    assert (r["_op"], r["_commit_lsn"], r["_omitted"]) == ("u", "B", ["x"])
    assert reconcile.promote(raw, commit="C").select(F.col("_commit_lsn")).first()[0] == "C"
