"""Queries over events against their SQL, on tables that show what the smallest ones do not."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidelog.operators import routing
from tidelog.sources import catalog


def against_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got, want = entry.engine.QUERIES[name](spark, str(folder)), con.sql(entry.engine.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda row: tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)
    found = sorted(key(r[c] for c in cols) for r in got.collect())
    assert found == sorted(key(r) for r in want.select(*(f'"{c}"' for c in cols)).fetchall())
    return found


def write_events(spark, folder, n, user):
    kinds = "'signup', 'click', 'purchase', 'view', 'error'"
    spark.range(n).selectExpr("id AS event_id", f"{user} AS user_id", f"element_at(array({kinds}), int(id * 7 % 5) + 1) AS event_type", "id % 1000 / 4.0D AS value", "concat('p', id) AS props").coalesce(1).write.parquet(f"{folder}/events.parquet")


def shuffled(spark, work):
    """Bytes that ``work`` writes to shuffles."""

    def so_far():
        time.sleep(1)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = so_far()
    work()
    return so_far() - before


@pytest.mark.parametrize("name", ["schema_capture", "schema_latest_version", "schema_version_at"])
def test_shuffles_of_definitions_grow_with_the_input(spark, tmp_path, name):
    """Four times the events have four times the statements, with four times the columns each."""
    bytes_of = []
    for n in (16_000, 64_000):
        write_events(spark, tmp_path / str(n), n, "id * 31 % 1499")
        bytes_of.append(shuffled(spark, lambda: against_sql(spark, tmp_path / str(n), name)))  # noqa: B023
    assert 0 < bytes_of[1] < 8 * bytes_of[0]


@pytest.mark.parametrize("name", ["schema_walk", "stream_files_to_mirror"])
def test_truncates_are_no_rows(spark, tmp_path, name):
    """The event that stands for a truncate is the only one of its user."""
    write_events(spark, tmp_path, 3020, "CASE WHEN id = 2999 THEN 777777 ELSE id % 150 END")
    assert against_sql(spark, tmp_path, name)


def test_version_at_by_order(spark):
    """The last version since then, for tables of many versions without comparing each row to each; rows without a version or without a table stay."""
    registry = spark.createDataFrame([("a", 1, "02", "x"), ("a", 2, "05", "y"), ("b", 1, "04", "x")], catalog.REGISTRY)
    rows = spark.createDataFrame([(i, t, at) for i, (t, at) in enumerate([("a", "01"), ("a", "02"), ("a", "04"), ("a", "05"), ("a", "09"), ("b", "03"), ("b", "09"), ("c", "09"), (None, "09"), ("a", None), ("a", "02")])], "i long, table string, _commit_lsn string")
    got = catalog.version_at(rows, registry)
    assert got.columns == ["i", "table", "_commit_lsn", "version"]
    assert [r["version"] for r in got.orderBy("i").collect()] == [None, 1, 1, 2, 2, None, 1, None, None, None, 1]
    assert not any(sign in got._jdf.queryExecution().optimizedPlan().toString() for sign in (">= since", "< until_"))


def test_relations_by_order(spark):
    """Rows find the last description of their own relation before them, in their own slot, by equality alone."""
    column = lambda *names: [(n, 25, -1, n == names[0]) for n in names]
    tagged = lambda *values: [("t", v) for v in values]
    said = lambda slot, seq, oid, name, *names: (slot, seq, "relation", None, None, None, [oid], None, None, None, name, column(*names), None)
    row = lambda slot, seq, oid, *values: (slot, seq, "insert", 1, None, None, [oid], None, None, tagged(*values), None, None, None)
    wiped = ("a", 9, "truncate", 1, None, None, [1, 2], None, None, None, None, None, None)
    messages = [said("a", 1, 1, "p.one", "x"), said("a", 2, 2, "p.two", "y"), row("a", 3, 1, "1"), said("a", 4, 1, "p.one", "x", "z"), row("a", 5, 1, "2", "3"), row("a", 6, 2, "4"), said("b", 1, 1, "p.other", "w"), row("b", 5, 1, "5"), wiped]
    got = routing.changes(spark.createDataFrame(messages, "slot string, " + routing.DECODED))
    found = sorted((r["lsn"], r["op"], r["relation"], r["version"], tuple(sorted((r["new"] or {}).items()))) for r in got.collect())
    at = lambda n: f"{n:016X}"
    assert found == [
        (at(3), "i", "p.one", 1, (("x", "1"),)), (at(5), "i", "p.one", 2, (("x", "2"), ("z", "3"))), (at(5), "i", "p.other", 1, (("w", "5"),)),
        (at(6), "i", "p.two", 1, (("y", "4"),)), (at(9), "t", "p.one", 2, ()), (at(9), "t", "p.two", 1, ()),
    ]
    assert not any(sign in got._jdf.queryExecution().optimizedPlan().toString() for sign in ("> since", "< until"))


def test_running_last_keeps_rows_without_a_slot(spark):
    """They are a slot of their own, across ranges."""
    frame = spark.range(400).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' END AS slot", "id AS seq", "CASE WHEN id IN (1, 20, 151) THEN id END AS v")
    got = routing.running_last(frame, "slot", "seq", F.col("v"), "last").collect()
    assert sorted((r["seq"], r["last"]) for r in got) == [(i, (None if i < 20 else 20) if i % 2 == 0 else None if i < 1 else 1 if i < 151 else 151) for i in range(400)]
