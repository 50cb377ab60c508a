"""Change streams derived from the driver's tables by a fixed formula, and the same formula in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import lsn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_changes(spark: SparkSession, sf_dir: str, truncate_every: int = 3000) -> DataFrame:
    """Changes of a table (id, props, value) keyed by user, one for each event; purchases rename keys, views leave out props."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    at = [lsn.from_long(F.floor(eid / 10) * 10 + 10).alias("_commit_lsn"), lsn.from_long(eid + 1).alias("_lsn")]
    none = F.array().cast("array<string>")
    row = lambda op, i, p, v, o: F.struct(F.lit(op).alias("_op"), i.cast("bigint").alias("id"), p.cast("string").alias("props"), v.cast("double").alias("value"), o.alias("_omitted"))
    null, props, value, user = F.lit(None), F.col("props"), F.col("value"), F.col("user_id")
    left = F.array(F.lit("props"))
    kind = F.col("event_type")
    rows = (
        F.when(eid % truncate_every == truncate_every - 1, F.array(row("t", null, null, null, none)))
        .when(kind == "signup", F.array(row("i", user, props, value, none)))
        .when(kind == "error", F.array(row("d", user, null, null, none)))
        .when((kind == "purchase") & (eid % 7 == 0), F.array(row("d", user, null, null, none), row("u", user + 1000, null, value, left)))
        .when(kind == "view", F.array(row("u", user, null, value, left)))
        .otherwise(F.array(row("u", user, props, value, none)))
    )
    return e.select(*at, F.explode(rows).alias("r")).select("r.id", "r.props", "r.value", "r._op", "_commit_lsn", "_lsn", "r._omitted")


EVENT_CHANGES = """
 hexed AS (SELECT *, printf('%016X', (event_id // 10) * 10 + 10) AS c, printf('%016X', event_id + 1) AS l FROM events),
 changes AS (
  SELECT NULL::BIGINT AS id, NULL::VARCHAR AS props, NULL::DOUBLE AS value, 't' AS op, c, l, false AS om FROM hexed WHERE event_id % 3000 = 2999
  UNION ALL SELECT user_id, CASE WHEN event_type IN ('signup', 'click', 'purchase') THEN props END, CASE WHEN event_type <> 'error' THEN value END,
   CASE event_type WHEN 'signup' THEN 'i' WHEN 'error' THEN 'd' ELSE 'u' END, c, l, event_type = 'view'
   FROM hexed WHERE event_id % 3000 <> 2999 AND NOT (event_type = 'purchase' AND event_id % 7 = 0)
  UNION ALL SELECT user_id, NULL, NULL, 'd', c, l, false FROM hexed WHERE event_id % 3000 <> 2999 AND event_type = 'purchase' AND event_id % 7 = 0
  UNION ALL SELECT user_id + 1000, NULL, value, 'u', c, l, true FROM hexed WHERE event_id % 3000 <> 2999 AND event_type = 'purchase' AND event_id % 7 = 0)
"""


def lineitem_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a table with a composite key: every row of lineitem, whose keys repeat; the position follows from the row's own columns."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_partkey") * 1000 + F.col("l_suppkey") * 7 + F.col("l_quantity").cast("bigint")
    op = F.when(F.col("l_returnflag") == "R", "d").when(F.col("l_returnflag") == "A", "u").otherwise("i")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", op.alias("_op"), lsn.from_long(F.floor(n / 100) * 100 + 100).alias("_commit_lsn"), lsn.from_long(n * 100_000 + F.pmod(F.floor(F.col("l_extendedprice") * 100), F.lit(100_000))).alias("_lsn"), F.array().cast("array<string>").alias("_omitted"))


LINEITEM_CHANGES = """
 numbered AS (SELECT *, l_partkey * 1000 + l_suppkey * 7 + CAST(l_quantity AS BIGINT) AS n FROM lineitem),
 changes AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, CASE l_returnflag WHEN 'R' THEN 'd' WHEN 'A' THEN 'u' ELSE 'i' END AS op,
  printf('%016X', (n // 100) * 100 + 100) AS c, printf('%016X', n * 100000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000) AS l FROM numbered)
"""
