import struct

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.operators import claim, reconcile, routing
from tidelog.sources import lease, staging, store
from tidelog.streaming import apply, metrics

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", sorted(entry.engine.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = entry.engine.QUERIES[name](spark, DATA), con.sql(entry.engine.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda row: tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(key(r[c] for c in cols) for r in got.collect()) == sorted(key(r) for r in want.select(*(f'"{c}"' for c in cols)).fetchall())


SCHEMA = "id int, status string, _op string, _commit_lsn string, _lsn string, _omitted array<string>"


def rows(spark, *r):
    return spark.createDataFrame([(i, s, op, f"{c:016X}", f"{c:016X}", []) for i, op, c, s in r], SCHEMA)


def test_store_steps_replay_conflict_and_clean(spark, tmp_path):
    t = store.TableStore(spark, f"file://{tmp_path}/t")
    one = rows(spark, (1, "i", 1, "a"), (2, "i", 2, "b"))
    t.append({"f1": one}, f"{2:016X}")
    t.transform(["id"])
    before = t.state()
    assert t.append({"f1": one}, f"{2:016X}") == before == t.transform(["id"])  # a replay after a crash
    t.append({"f1": one, "f2": rows(spark, (1, "d", 3, None), (3, "i", 4, "c"))}, f"{4:016X}")
    t.transform(["id"])
    assert sorted(r["id"] for r in t.mirror().collect()) == [2, 3]
    with pytest.raises(store.Conflict):
        t.publish(before)
    t.rebuild(["id"], lag=0)
    assert sorted(r["id"] for r in t.mirror().collect()) == [2, 3]
    assert t.clean() and t.mirror().count() == 2
    t.publish_view("readers")
    assert spark.table("readers").columns == ["id", "status"]
    t.replace(spark.createDataFrame([(9, "z")], "id int, status string"), f"{9:016X}", ["id"])
    assert [r["id"] for r in t.mirror().collect()] == [9]
    assert t.bump_epoch()["epoch"] == 2 and t.mirror() is None


def test_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows(spark, (1, "i", 1, "a")).write.parquet(src)
    t = store.TableStore(spark, f"file://{tmp_path}/t")
    for extra in (None, rows(spark, (1, "u", 2, "b"), (2, "i", 3, "c"))):
        if extra is not None:
            extra.write.mode("append").parquet(src)
        q = apply.mirror_stream(apply.watch(spark, src, extra.schema if extra is not None else rows(spark, (1, "i", 1, "a")).schema), t, ["id"], f"{tmp_path}/ck")
        q.awaitTermination()
    assert sorted((r["id"], r["status"]) for r in t.mirror().collect()) == [(1, "b"), (2, "c")]


def test_staging(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"op":"i","lsn":"000000000000000A","commit_lsn":"000000000000000B","epoch":1,"schema_version":1,"source_schema":"s","source_table":"t","kind":"stream"}')], "id int, meta string")
    ok = staging.Expectation("s.t", 1, 1, "stream", 1, "0" * 16, "F" * 16)
    staging.validate(df, ok)
    with pytest.raises(staging.IntegrityError, match="epoch"):
        staging.validate(df, staging.Expectation("s.t", 2, 1, "stream", 1, "0" * 16, "F" * 16))
    path = staging.stage(df, f"file://{tmp_path}", 1, "s.t")
    manifest = staging.fingerprints(spark, [path])
    staging.verify(spark, manifest.where("uri like '%.parquet'"))
    with pytest.raises(staging.IntegrityError):
        staging.verify(spark, manifest.where("uri like '%.parquet'").selectExpr("uri", "size + 1 AS size", "sha256"))
    assert staging.same_shape(df.schema, df.select("meta", "id").schema)


def test_claim_helpers():
    assert claim.scan_ranges(10, 1, 4) == [(0, 2), (2, 5), (5, 7), (7, None)]
    workers = [f"w{i}" for i in range(5)]
    moved = [t for t in map(str, range(200)) if claim.owner(t, workers) != claim.owner(t, workers[:-1])]
    assert all(claim.owner(t, workers) == "w4" for t in moved) and moved
    b = claim.Backpressure(100)
    assert [b.update(x) for x in (84, 85, 80, 75, 74, 80)] == [False, True, True, True, False, False]


def frame(kind, *parts):
    return kind.encode() + b"".join(parts)


def tup(*values):
    out = struct.pack(">H", len(values))
    for v in values:
        out += b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">i", len(v)) + v.encode()
    return out


def test_decode(spark):
    rel = struct.pack(">I", 7)
    frames = [
        frame("R", rel, b"public\0t\0d", struct.pack(">H", 2), b"\1id\0", struct.pack(">Ii", 23, -1), b"\0v\0", struct.pack(">Ii", 25, -1)),
        frame("B", struct.pack(">QqI", 100, 0, 5)), frame("I", rel, b"N", tup("1", "a")), frame("U", rel, b"K", tup("1", None), b"N", tup("2", ...)), frame("C", struct.pack(">BQQq", 0, 90, 100, 0)),
        frame("S", struct.pack(">IB", 9, 1)), frame("D", struct.pack(">I", 10), rel, b"K", tup("2", None)), frame("E"), frame("A", struct.pack(">II", 9, 10)), frame("c", struct.pack(">IBQQq", 9, 0, 120, 130, 0)),
        frame("T", struct.pack(">IBI", 1, 0, 7)),
    ]
    got = routing.decode(spark.createDataFrame(list(enumerate(map(bytearray, frames))), "seq long, data binary")).orderBy("seq").collect()
    assert [r["kind"] for r in got] == ["relation", "begin", "insert", "update", "commit", "stream_start", "delete", "stream_stop", "stream_abort", "stream_commit", "truncate"]
    assert got[0]["name"] == "public.t" and got[0]["columns"][0]["is_key"]
    assert [x["tag"] for x in got[3]["new"]] == ["t", "u"] and got[3]["xid"] == 5
    assert got[6]["sub_xid"] == 10 and got[4]["lsn"] == f"{90:016X}"
    with pytest.raises(ValueError):
        routing.decode_frame(frames[2][:-1], False)
    with pytest.raises(ValueError):
        routing.decode_frame(b"?", False)


def test_route_key_change_and_truncate(spark):
    m = spark.createDataFrame(
        [("u", "a", 1, 1, "01", {"id": "1", "v": None}, {"id": "2"}, ["v"]), ("u", "a", 1, 1, "02", {"id": "2"}, {"v": "x"}, ["id"]), ("t", "a,b", 1, 1, "03", None, None, [])], routing.MESSAGE
    )
    got = [(r["relation"], r["_op"], r["image"] and r["image"].get("id"), r["_omitted"]) for r in routing.route(m, ["id"]).orderBy("_lsn", "_op", "relation").collect()]
    assert got == [("a", "d", "1", []), ("a", "u", "2", ["v"]), ("a", "u", "2", []), ("a", "t", None, []), ("b", "t", None, [])]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert reconcile.APPLIED[0] in entry.entry(spark).columns


def test_lease_fences_the_writer_that_lost_it(spark, tmp_path):
    a, b = (store.TableStore(spark, f"file://{tmp_path}/t") for _ in range(2))
    first = lease.acquire(a, "a", 10, now=0)
    assert first.token == 1 and lease.acquire(b, "b", 10, now=5) is None
    assert lease.acquire(a, "a", 10, now=5).token == 1
    a.publish(a.state())
    taken = lease.acquire(b, "b", 10, now=15)
    assert taken.token == 2 and lease.acquire(a, "a", 10, now=16) is None
    b.publish(b.state())
    with pytest.raises(store.Conflict, match="later lease"):
        a.publish(a.state())
    assert not lease.release(a, first, now=17) and lease.release(b, taken, now=17)
    assert lease.acquire(a, "a", 10, now=18).token == 3
    assert a.publish(a.state())["step"] == 3


def test_metrics(spark, tmp_path):
    m = metrics.Metrics()
    df, seen = metrics.observed(rows(spark, (1, "i", 1, "a"), (1, "u", 2, "b"), (2, "i", 3, "c")))
    df.write.format("noop").mode("overwrite").save()
    metrics.record(m, 'x"y', seen)
    metrics.lags(m, spark.createDataFrame([("t", 7)], "table string, lag long"))
    m.write(f"{tmp_path}/m")
    text = open(f"{tmp_path}/m").read().splitlines()
    assert "# TYPE changes_total counter" in text and 'changes_total{op="insert",table="x\\"y"} 2' in text and 'table_lag_bytes{table="t"} 7' in text
    with pytest.raises(ValueError):
        m.gauge("changes_total", 1)
    with pytest.raises(ValueError):
        m.count("changes_total", -1)


def test_unknown_relation_and_width_are_errors(spark):
    from pyspark.errors import PySparkException

    rel = struct.pack(">I", 7)
    head = [frame("R", rel, b"public\0t\0d", struct.pack(">H", 1), b"\1id\0", struct.pack(">Ii", 23, -1)), frame("B", struct.pack(">QqI", 100, 0, 5))]
    for bad in (frame("I", struct.pack(">I", 8), b"N", tup("1")), frame("I", rel, b"N", tup("1", "2"))):
        m = routing.decode(spark.createDataFrame(list(enumerate(map(bytearray, [*head, bad]))), "seq long, data binary"))
        with pytest.raises(PySparkException):
            routing.changes(m).collect()
    more = [frame("Y", rel, b"public\0mood\0"), frame("O", struct.pack(">Q", 3), b"far\0"), frame("M", b"\0", struct.pack(">Q", 4), b"note\0", struct.pack(">I", 2), b"hi"), frame("b", struct.pack(">QQqI", 1, 2, 0, 9), b"g\0"), frame("P", b"\0", struct.pack(">QQqI", 1, 2, 0, 9), b"g\0"), frame("K", b"\0", struct.pack(">QQqI", 1, 2, 0, 9), b"g\0"), frame("r", b"\0", struct.pack(">QQqqI", 1, 2, 0, 0, 9), b"g\0"), frame("p", b"\0", struct.pack(">QQqI", 1, 2, 0, 9), b"g\0")]
    got = routing.decode(spark.createDataFrame(list(enumerate(map(bytearray, more))), "seq long, data binary")).orderBy("seq").collect()
    assert [(r["kind"], r["name"]) for r in got] == [("type", "public.mood"), ("origin", "far"), ("message", "note"), ("begin_prepare", "g"), ("prepare", "g"), ("commit_prepared", "g"), ("rollback_prepared", "g"), ("stream_prepare", "g")]
    assert got[2]["content"] == b"hi".hex()


def test_store_refuses_other_content_and_parts_of_groups(spark, tmp_path):
    t = store.TableStore(spark, f"file://{tmp_path}/t", buckets=2)
    one = rows(spark, (1, "i", 1, "a"))
    t.append({"a": one}, f"{1:016X}", {"a": "x"}, {"a": "g"})
    with pytest.raises(store.Conflict):
        t.append({"a": one}, f"{1:016X}", {"a": "y"})
    with pytest.raises(store.Conflict):
        t.append({"a": one, "b": one}, f"{1:016X}", groups={"a": "g", "b": "g"})
    step = t.state()["step"]
    assert t.create(f"pointer/{step + 1:012d}.json", {"x": 1}) and not t.create(f"pointer/{step + 1:012d}.json", {"x": 2})
    assert t.load(f"pointer/{step + 1:012d}.json") == {"x": 1}


def test_manifest_conflicts(spark, tmp_path):
    from tidelog.sources import manifest

    q = manifest.Queue(store.TableStore(spark, f"file://{tmp_path}/t"))
    row = (1, 1, "a.b", "stream", "u", 5, 9, "h", "0" * 16, "1" * 16, 1, "g", 0, 2, None, "ready")
    one = spark.createDataFrame([row], manifest.ROW)
    q.publish(one)
    q.publish(one)
    assert q.manifest().count() == 1
    with pytest.raises(store.Conflict):
        q.publish(spark.createDataFrame([(*row[:7], "other", *row[8:])], manifest.ROW))
    with pytest.raises(store.Conflict):
        q.retire(spark.createDataFrame([("a.b", "gg")], "table string, unit string"))
    with pytest.raises(store.Conflict):
        q.replace(0, q.manifest())


def test_walk_stops_for_a_decision_and_cancelled_steps_publish_nothing(spark, tmp_path):
    import threading
    import time

    from pyspark.sql import functions as F

    from tidelog.plans import evolution, versions
    from tidelog.sources.failures import Repairs

    log = rows(spark, (1, "i", 1, "a")).withColumn("version", F.lit(1))
    t = versions.Table("a.b", reconcile.empty_mirror(log.drop("version")), ["id"], "0" * 16)
    with pytest.raises(evolution.Quarantine):
        versions.walk(t, log, [(1, "0" * 16, {"id": "int", "status": "string"}), (2, f"{2:016X}", {"id": "int", "state": "string"})], "F" * 16)
    r = Repairs(2)
    assert [r.failed("a") for _ in range(3)] == ["resnapshot", "resnapshot", "quarantine"] and r.failed("b") == "resnapshot"
    slow = lambda: spark.range(4).mapInPandas(lambda it: (time.sleep(60) or b for b in it), "id long").count()
    threading.Timer(4, lambda: apply.cancel(spark, "rebuild")).start()
    began = time.time()
    assert apply.cancellable(spark, "rebuild", slow) is None and time.time() - began < 50
    s = store.TableStore(spark, f"file://{tmp_path}/s")
    state = apply.cycle(s, ["id"], {"f": rows(spark, (1, "i", 1, "a"))}, f"{1:016X}", {"status": "what"})
    assert apply.cycle(s, ["id"], {"f": rows(spark, (1, "i", 1, "a"))}, f"{1:016X}", {"status": "what"}) == state
    assert s.mirror().schema["status"].metadata == {"comment": "what"}
