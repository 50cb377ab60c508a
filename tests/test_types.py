import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidelog.functions import lsn, parsers
from tidelog.plans import evolution, types


def one(spark, f, text):
    v = spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]
    return tuple(v) if hasattr(v, "__fields__") else v


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (parsers.interval, "1 year 2 mons 3 days 04:05:06.5", (14, 3, 14706500000)), (parsers.interval, "1 mon", (1, 0, 0)), (parsers.interval, "30 days", (0, 30, 0)), (parsers.interval, "720:00:00", (0, 0, 2592000000000)),
        (parsers.interval, "-00:00:01", (0, 0, -1000000)), (parsers.interval, "@ 1 year ago", (-12, 0, 0)),
        (parsers.timetz, "12:34:56.789+05:30", (45296789000, 19800)), (parsers.timetz, "12:34:56-08", (45296000000, -28800)),
        (lambda c: parsers.range_(c, "int"), "[1,10)", (1, 10, True, False, False)), (lambda c: parsers.range_(c, "int"), "(,5]", (None, 5, False, True, False)), (parsers.range_, "empty", (None, None, False, False, True)),
        (parsers.range_, '["a,b","c""d"]', ("a,b", 'c"d', True, True, False)),
        (parsers.point, "(1.5,-2)", (1.5, -2.0)), (parsers.circle, "<(1,2),3>", (1.0, 2.0, 3.0)), (parsers.line, "{1,2,3}", (1.0, 2.0, 3.0)),
        (parsers.boolean, "t", True), (parsers.bytea, "\\x00ff", bytearray(b"\x00\xff")), (parsers.uuid, "A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"),
        (parsers.time_micros, "01:02:03.1234567", 3723123456), (parsers.timestamptz, "2024-01-02 03:04:05+02", dt.datetime(2024, 1, 2, 1, 4, 5)), (parsers.date, "2024-02-29", dt.date(2024, 2, 29)),
    ],
)
def test_parse(spark, f, text, want):
    assert one(spark, f, text) == want


def test_multirange_and_path(spark):
    assert [tuple(x) for x in one(spark, lambda c: parsers.multirange(c, "int"), "{[1,4),[7,9)}")] == [(1, 4, True, False), (7, 9, True, False)]
    assert one(spark, parsers.multirange, "{}") == []
    assert one(spark, parsers.path, "[(1,2),(3,4)]")[0] is False
    assert one(spark, parsers.path, "((1,2),(3,4))")[0] is True
    assert len(one(spark, parsers.polygon, "((0,0),(1,0),(1,1))")) == 3


@pytest.mark.parametrize(("f", "text"), [(parsers.boolean, "yes"), (parsers.timetz, "12:00:00"), (lambda c: parsers.decimal(c, 10, 2), "19.999"), (parsers.uuid, "x"), (parsers.range_, "[1,2"), (parsers.interval, "soon")])
def test_malformed(spark, f, text):
    with pytest.raises(PySparkException):
        one(spark, f, text)


def test_null_stays_null(spark):
    for f in (parsers.interval, parsers.range_, parsers.multirange, parsers.point, parsers.boolean):
        assert one(spark, f, None) is None


def test_lsn(spark):
    assert one(spark, lsn.canonical, "0/199BAC8") == "000000000199BAC8"
    assert one(spark, lsn.canonical, "zz") is None
    assert one(spark, lambda c: lsn.display(lsn.canonical(c)), "1/0A") == "1/A"
    assert one(spark, lambda c: lsn.minus(c, 100), f"{50:016X}") == lsn.ZERO


def test_plan():
    plan = types.TablePlan([types.SourceColumn("id", "int4", True), types.SourceColumn("span", "int4range", True), types.SourceColumn("w", "interval")])
    assert plan.keys == ["id", "span_lower", "span_upper", "span_lower_inc", "span_upper_inc", "span_empty"]
    for bad in ([types.SourceColumn("_op", "text", True)], [types.SourceColumn("A b", "text", True)], [types.SourceColumn("a", "text")]):
        with pytest.raises(types.PlanError):
            types.TablePlan(bad)
    with pytest.raises(types.PlanError):
        types.emit(types.SourceColumn("m", "money"))


def test_typed(spark):
    plan = types.TablePlan([types.SourceColumn("id", "int4", True), types.SourceColumn("n", "numeric", precision=10, scale=2), types.SourceColumn("w", "interval")])
    got = plan.typed(spark.createDataFrame([("1", "2.50", "1 mon", "i")], "id string, n string, w string, _op string")).first()
    assert (got["id"], str(got["n"]), got["w_months"], got["_op"]) == (1, "2.50", 1, "i")


def test_evolution(spark):
    old = {"id": "int", "a": "string"}
    assert evolution.diff(old, {"id": "bigint", "a": "string", "b": "date"}) == [evolution.Step("add", "b", "date"), evolution.Step("widen", "id", "bigint")]
    for new, held in (({"id": "int", "b": "string"}, set()), ({"a": "string", "id": "int"}, set()), ({**old, "c": "int"}, {"c"})):
        with pytest.raises(evolution.Quarantine):
            evolution.diff(old, new, held)
    df = spark.createDataFrame([(1, "x"), (2, "7")], "id int, a string")
    with pytest.raises(evolution.Quarantine):
        evolution.evolve_mirror(df, [evolution.Step("retype", "a", "int")])
    assert dict(evolution.evolve_log(df, [evolution.Step("retype", "id", "date"), evolution.Step("drop", "a")]).dtypes) == {"id": "string", "a": "string"}
    assert evolution.conform(df, {"id": "bigint", "z": "int"}).first()["z"] is None
