"""The engine's registered queries, one or more for each operator, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import fixtures
from tidelog.fixtures import EVENT_CHANGES, LINEITEM_CHANGES
from tidelog.functions import lsn, parsers
from tidelog.operators import claim, omitted, reconcile, reload, routing
from tidelog.plans import evolution

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WITH = "WITH RECURSIVE" + EVENT_CHANGES
#: The latest truncate's position and the changes after it.
LIVE = ", bound AS (SELECT max(c || l) AS b FROM changes WHERE op = 't'), live AS (SELECT *, c || l AS t FROM changes WHERE op <> 't' AND (c || l) > coalesce((SELECT b FROM bound), ''))"
WINNERS = ", winners AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, l DESC, CASE op WHEN 'd' THEN 1 ELSE 0 END) = 1)"
KEYS = ["id"]


@query(WITH + WINNERS.replace("live", "(SELECT * FROM changes WHERE op <> 't')") + " SELECT id, props, value, op, c AS commit_lsn, l AS lsn FROM winners")
def cdc_latest_winner(spark, sf_dir):
    rows = reconcile.latest(reconcile.live(fixtures.event_changes(spark, sf_dir)), KEYS)
    return rows.select("id", "props", "value", F.col("_op").alias("op"), F.col("_commit_lsn").alias("commit_lsn"), F.col("_lsn").alias("lsn"))


@query(WITH + LIVE + WINNERS + " SELECT id, value, c AS commit_lsn, l AS lsn FROM winners WHERE op <> 'd'")
def cdc_truncate_boundary(spark, sf_dir):
    changes = fixtures.event_changes(spark, sf_dir)
    rows = reconcile.latest(reconcile.live(changes, None, reconcile.truncate_boundary(changes)), KEYS).where("_op <> 'd'")
    return rows.select("id", "value", F.col("_commit_lsn").alias("commit_lsn"), F.col("_lsn").alias("lsn"))


LINEAGE = (
    LIVE + WINNERS + """,
 edges AS (SELECT DISTINCT u.id AS nk, d.id AS ok, u.t FROM live u JOIN live d ON u.t = d.t AND u.op = 'u' AND d.op = 'd' AND u.id IS DISTINCT FROM d.id),
 setters AS (SELECT id, t, props FROM live WHERE op IN ('i', 'u') AND NOT om),
 chain(wid, key, upto, depth) AS (
  SELECT id, id, t, 0 FROM winners WHERE op <> 'd' AND om
  UNION ALL SELECT n.wid, e.ok, e.t, n.depth + 1 FROM chain n JOIN edges e ON e.nk = n.key AND (e.t < n.upto OR (n.depth = 0 AND e.t = n.upto))
   WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.nk = n.key AND f.t > e.t AND (f.t < n.upto OR (n.depth = 0 AND f.t = n.upto)))
    AND NOT EXISTS (SELECT 1 FROM setters s WHERE s.id = n.key AND s.t <= n.upto AND s.t >= e.t)),
 low AS (SELECT n.*, (SELECT max(e.t) FROM edges e WHERE e.nk = n.key AND (e.t < n.upto OR (n.depth = 0 AND e.t = n.upto))) AS edge FROM chain n),
 found AS (SELECT n.wid, arg_max(struct_pack(v := s.props), s.t) AS p FROM low n JOIN setters s ON s.id = n.key AND s.t <= n.upto AND (n.edge IS NULL OR s.t >= n.edge) GROUP BY n.wid),
 filled AS (SELECT w.id, CASE WHEN w.om THEN f.p.v ELSE w.props END AS props, w.value, w.c, w.l FROM winners w LEFT JOIN found f ON f.wid = w.id WHERE w.op <> 'd')"""
)


@query(WITH + LINEAGE + " SELECT id, props, value, c AS _applied_commit_lsn, l AS _applied_lsn FROM filled")
def cdc_omitted_value_lineage(spark, sf_dir):
    changes = fixtures.event_changes(spark, sf_dir)
    return reconcile.apply_changes(reconcile.empty_mirror(changes), changes, KEYS)


def _half(changes: DataFrame) -> tuple[DataFrame, str]:
    at = f"{5000:016X}"
    return changes.where(F.col("_commit_lsn") <= at), at


@query(WITH + LINEAGE + " SELECT id, props, value, c AS _applied_commit_lsn, l AS _applied_lsn FROM filled")
def cdc_incremental_apply(spark, sf_dir):
    """In two steps over a live mirror, the boundary commit read twice: the same as at once."""
    from tidelog.plans.scratch import cut

    changes = fixtures.event_changes(spark, sf_dir)
    head, at = _half(changes)
    mirror = cut(reconcile.apply_changes(reconcile.empty_mirror(changes), head, KEYS))
    return reconcile.apply_changes(mirror, changes.where(F.col("_commit_lsn") >= at), KEYS, at, changes)


@query(WITH + LINEAGE + " SELECT id, props, value, c AS _applied_commit_lsn, l AS _applied_lsn FROM filled")
def cdc_full_rebuild(spark, sf_dir):
    from tidelog.plans.scratch import cut

    changes = fixtures.event_changes(spark, sf_dir)
    head, _ = _half(changes)
    mirror = cut(reconcile.apply_changes(reconcile.empty_mirror(changes), head, KEYS))
    return reconcile.rebuild(changes, mirror, KEYS)


@query(WITH + LINEAGE + " SELECT id, props, value FROM filled")
def cdc_current_view(spark, sf_dir):
    return reconcile.current(cdc_omitted_value_lineage(spark, sf_dir))


@query("WITH" + LINEITEM_CHANGES + " SELECT l_orderkey, l_linenumber, max(c || l) AS at FROM changes WHERE op <> 't' GROUP BY ALL")
def cdc_lineitem_frontier(spark, sf_dir):
    ch = fixtures.lineitem_changes(spark, sf_dir)
    return ch.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.concat("_commit_lsn", "_lsn")).alias("at"))


# Positions that several rows of a key share leave no defined winner, so such keys are compared by their winners' common part.
LI_WIN = ", ranked AS (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY c DESC, l DESC, CASE op WHEN 'd' THEN 1 ELSE 0 END) AS r FROM changes), one AS (SELECT l_orderkey, l_linenumber, any_value(op) AS op, any_value(c) AS c, any_value(l) AS l FROM ranked WHERE r = 1 GROUP BY ALL HAVING min(op = 'd') = max(op = 'd'))"


@query("WITH" + LINEITEM_CHANGES + LI_WIN + " SELECT l_orderkey, l_linenumber, c AS _applied_commit_lsn, l AS _applied_lsn FROM one WHERE op <> 'd'")
def cdc_composite_key_merge(spark, sf_dir):
    """Guarded merge on a composite key: a mirror of one half of the log, then the other half."""
    keys = ["l_orderkey", "l_linenumber"]
    ch = fixtures.lineitem_changes(spark, sf_dir).drop("l_extendedprice", "l_shipdate", "l_quantity")
    first = reconcile.latest(ch.where("l_orderkey % 2 = 0 or l_linenumber > 3"), keys)
    mirror = reconcile.merge(reconcile.empty_mirror(ch), first, keys)
    return reconcile.merge(mirror, reconcile.latest(ch, keys), keys)


@query(WITH + " SELECT id, op, c AS commit_lsn, l AS lsn FROM changes WHERE c >= printf('%016X', greatest((SELECT max(event_id) FROM events) - 1000, 0)) AND op <> 't'")
def cdc_prune_retention(spark, sf_dir):
    ch = fixtures.event_changes(spark, sf_dir)
    top = fixtures.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    kept = reconcile.prune(ch, f"{top:016X}", 1000).where("_op <> 't'")
    return kept.select("id", F.col("_op").alias("op"), F.col("_commit_lsn").alias("commit_lsn"), F.col("_lsn").alias("lsn"))


@query(WITH + " SELECT DISTINCT u.id AS new_id, d.id AS old_id, u.c || u.l AS at FROM changes u JOIN changes d ON u.c = d.c AND u.l = d.l AND u.op = 'u' AND d.op = 'd' AND u.id <> d.id")
def cdc_rename_edges(spark, sf_dir):
    e = omitted.renames(fixtures.event_changes(spark, sf_dir), KEYS)
    return e.select(F.col("new_key.id").alias("new_id"), F.col("old_key.id").alias("old_id"), F.concat("at.c", "at.l").alias("at"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'i' WHEN 'error' THEN 'd' ELSE 'u' END AS op, printf('%016X', event_id + 1) AS lsn, '00000000000003E8' AS commit_lsn, event_type = 'view' AS omits FROM events")
def cdc_promote_metadata(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "i").when(F.col("event_type") == "error", "d").otherwise("u")
    left = F.when(F.col("event_type") == "view", F.array(F.lit("props"))).otherwise(F.array().cast("array<string>"))
    raw = e.select("event_id", F.to_json(F.struct(op.alias("op"), lsn.from_long(F.col("event_id") + 1).alias("lsn"), left.alias("unchanged_toast"))).alias("meta"))
    return reconcile.promote(raw, commit=f"{1000:016X}").select("event_id", F.col("_op").alias("op"), F.col("_lsn").alias("lsn"), F.col("_commit_lsn").alias("commit_lsn"), F.array_contains("_omitted", "props").alias("omits"))


TXN = "WITH m AS (SELECT *, event_id // 20 AS top, event_id // 5 + 1000000 AS sub, printf('%016X', event_id + 1) AS l FROM events), kept AS (SELECT * FROM m WHERE top % 4 <> 3 AND sub % 5 <> 2)"


@query(TXN + " SELECT user_id AS id, CASE event_type WHEN 'signup' THEN 'i' WHEN 'error' THEN 'd' ELSE 'u' END AS op, l AS lsn, printf('%016X', top * 20 + 40) AS commit_lsn FROM kept WHERE event_type <> 'purchase' UNION ALL SELECT user_id, 'd', l, printf('%016X', top * 20 + 40) FROM kept WHERE event_type = 'purchase' UNION ALL SELECT user_id + 1000, 'u', l, printf('%016X', top * 20 + 40) FROM kept WHERE event_type = 'purchase'")
def cdc_transaction_gate(spark, sf_dir):
    """Routing with key changes, aborted transactions and savepoints, and commit stamping."""
    e = fixtures.table(spark, sf_dir, "events").withColumn("top", F.floor(F.col("event_id") / 20)).withColumn("sub", F.floor(F.col("event_id") / 5) + 1_000_000)
    kind = F.col("event_type")
    image = lambda c: F.create_map(F.lit("id"), c.cast("string"))
    op = F.when(kind == "signup", "i").when(kind == "error", "d").otherwise("u")
    old = F.when(kind.isin("error", "purchase"), image(F.col("user_id")))
    new = F.when(kind != "error", image(F.col("user_id") + F.when(kind == "purchase", 1000).otherwise(0)))
    messages = e.select(op.alias("op"), F.lit("events").alias("relation"), F.col("sub").alias("xid"), F.col("top").alias("top_xid"), lsn.from_long(F.col("event_id") + 1).alias("lsn"), old.alias("old"), new.alias("new"), F.array().cast("array<string>").alias("omitted"))
    tops, subs = e.select("top").distinct(), e.select("top", "sub").distinct()
    outcomes = tops.select(F.when(F.col("top") % 4 == 3, "abort").otherwise("commit").alias("kind"), F.col("top").alias("top_xid"), F.col("top").alias("xid"), lsn.from_long(F.col("top") * 20 + 40).alias("commit_lsn"))
    outcomes = outcomes.union(subs.where("sub % 5 = 2").select(F.lit("abort"), "top", "sub", F.lit(None).cast("string")))
    rows = routing.commit_gate(routing.route(messages, KEYS), outcomes)
    return routing.project(rows, "events", {"id": "bigint"}).select("id", F.col("_op").alias("op"), F.col("_lsn").alias("lsn"), F.col("_commit_lsn").alias("commit_lsn"))


def _files(spark, sf_dir) -> DataFrame:
    """A queue of staged files from orders: single files, and groups of three of which some are broken."""
    o = fixtures.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("g", F.floor(F.col("o_orderkey") / 3))
    grouped = F.col("g") % 2 == 0
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("t"), (F.col("g") % 5).cast("string")).alias("table"), F.when(F.col("g") % 11 == 0, "reload").otherwise("stream").alias("kind"), lsn.from_long(F.col("g") * 10).alias("lsn_end"),
        (F.col("o_custkey") % 50 + 1).cast("bigint").alias("row_count"), F.when(grouped, F.col("g")).alias("group_id"), (F.col("o_orderkey") % 3).cast("int").alias("ordinal"), F.lit(3).alias("group_files"),
        F.when(F.col("o_orderkey") % 401 == 17, "pending").otherwise("ready").alias("status"), F.concat(F.lit("file-"), F.col("o_orderkey").cast("string")).alias("uri"),
    )


FILES = "WITH o AS (SELECT o_orderkey AS id, o_orderkey // 3 AS g, o_custkey FROM orders), files AS (SELECT id, 't' || (g % 5) AS tab, CASE WHEN g % 11 = 0 THEN 'reload' ELSE 'stream' END AS kind, printf('%016X', g * 10) AS lsn_end, o_custkey % 50 + 1 AS row_count, CASE WHEN g % 2 = 0 THEN g END AS group_id, id % 3 AS ordinal, CASE WHEN id % 401 = 17 THEN 'pending' ELSE 'ready' END AS status FROM o)"
UNITS = ", units AS (SELECT tab, coalesce('g' || group_id, 'f' || id) AS unit, min(id) AS first_id, max(lsn_end) AS lsn_end, min(kind) AS kind, count(*) AS n_files, sum(row_count)::BIGINT AS n_rows, bool_and(status = 'ready') AND (any_value(group_id) IS NULL OR (min(ordinal) = 0 AND max(ordinal) = count(*) - 1 AND count(DISTINCT ordinal) = count(*) AND count(*) = 3)) AS valid FROM files GROUP BY 1, 2)"


@query(FILES + UNITS + " SELECT tab AS \"table\", unit, lsn_end, n_files, n_rows, valid FROM units")
def control_group_validation(spark, sf_dir):
    return claim.units(_files(spark, sf_dir)).select("table", "unit", "lsn_end", "n_files", "n_rows", "valid")


@query(FILES + UNITS + ", o2 AS (SELECT *, coalesce(sum(n_files) OVER w, 0) AS fb, coalesce(sum(n_rows) OVER w, 0) AS rb, bool_or(NOT valid) OVER (PARTITION BY tab ORDER BY lsn_end, kind, first_id ROWS UNBOUNDED PRECEDING) AS blocked FROM units WHERE tab <> 't4' WINDOW w AS (PARTITION BY tab ORDER BY lsn_end, kind, first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT tab AS \"table\", unit, lsn_end, n_files, n_rows FROM o2 WHERE NOT blocked AND (fb = 0 OR (fb + n_files <= 40 AND rb + n_rows <= 900))")
def control_claim_budget(spark, sf_dir):
    return claim.claim(_files(spark, sf_dir), 40, 900, spark.createDataFrame([("t4",)], "table string"))


@query(FILES + " SELECT id, tab AS \"table\" FROM files WHERE tab IN ('t1', 't3') AND kind <> 'reload' AND lsn_end <= CASE tab WHEN 't1' THEN printf('%016X', 5000) ELSE printf('%016X', 9000) END")
def control_superseded(spark, sf_dir):
    return claim.superseded(_files(spark, sf_dir), spark.createDataFrame([("t1", f"{5000:016X}"), ("t3", f"{9000:016X}")], "table string, fence string"))


@query(FILES + " SELECT id FROM files WHERE id % 4 <> 1")
def control_ledger_antijoin(spark, sf_dir):
    files = _files(spark, sf_dir)
    return claim.unseen(files, files.where("id % 4 = 1").select("uri")).select("id")


@query(FILES + ", f AS (SELECT tab, max(('0x' || lsn_end)::BIGINT) AS h FROM files WHERE status = 'ready' GROUP BY 1) SELECT tab AS \"table\", greatest(h - 4096, 0)::BIGINT AS lag FROM f")
def control_backlog_lag(spark, sf_dir):
    files = _files(spark, sf_dir)
    return claim.lag(files, files.select("table").distinct().withColumn("raw_appended", F.lit(f"{4096:016X}")))


@query("WITH f AS (SELECT o_custkey % 20 AS reload_id, count(*) AS n, sum(o_orderkey % 7)::BIGINT AS r FROM orders GROUP BY 1) SELECT reload_id, n + (reload_id % 3 = 0)::INT AS n_files, r AS n_rows, reload_id % 3 <> 0 AND reload_id % 5 <> 0 AS sealed FROM f")
def reload_seal(spark, sf_dir):
    files = fixtures.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("reload_id"), (F.col("o_orderkey") % 7).alias("row_count"))
    ranges = files.groupBy("reload_id").agg((F.count("*") + (F.first("reload_id") % 3 == 0).cast("int")).alias("n_files"), F.sum("row_count").alias("n_rows")).withColumn("done", F.col("reload_id") % 5 != 0)
    return claim.seal(files, ranges)


FENCE = f"{4000:016X}"


@query(WITH + LIVE.replace("changes WHERE op = 't'", f"changes WHERE op = 't' AND c > '{FENCE}'").replace("WHERE op <> 't' AND", f"WHERE op <> 't' AND c > '{FENCE}' AND") + WINNERS + f", base AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 2 = 0) SELECT id, value FROM winners WHERE op <> 'd' UNION ALL SELECT id, id::DOUBLE FROM base WHERE (SELECT b FROM bound) IS NULL AND id NOT IN (SELECT id FROM winners)")
def reload_shadow_publish(spark, sf_dir):
    changes = fixtures.event_changes(spark, sf_dir)
    base = fixtures.table(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("id")).distinct().select("id", F.lit("x").alias("props"), F.col("id").cast("double").alias("value"))
    return reload.shadow(base, FENCE, changes, KEYS).select("id", "value")


@query("SELECT 'left' AS side, c_custkey, c_name FROM (SELECT c_custkey, c_name FROM customer EXCEPT ALL SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) || '!' ELSE c_name END FROM customer) UNION ALL SELECT 'right', * FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) || '!' ELSE c_name END FROM customer EXCEPT ALL SELECT c_custkey, c_name FROM customer)")
def parity_differences(spark, sf_dir):
    c = fixtures.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    changed = c.withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")))
    return reconcile.differences(c, changed)


@query("SELECT c_custkey::BIGINT AS id, c_nationkey::BIGINT AS nation, NULL::VARCHAR AS note FROM customer")
def schema_add_and_widen(spark, sf_dir):
    c = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("int").alias("nation"))
    return evolution.evolve_mirror(c, evolution.diff({"id": "bigint", "nation": "int"}, {"id": "bigint", "nation": "bigint", "note": "string"}))


@query("SELECT c_custkey::VARCHAR AS id FROM customer")
def schema_drop_and_retype(spark, sf_dir):
    c = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return evolution.evolve_mirror(evolution.evolve_mirror(c, [evolution.Step("drop", "c_name")]), evolution.diff({"id": "bigint"}, {"id": "string"}))


@query("SELECT event_id, (user_id % 9)::INT * 12 + 2 AS months, (event_id % 31)::INT AS days, (event_id % 24) * 3600000000 + 90500000 AS micros FROM events")
def type_interval_parse(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "events")
    text = F.concat((F.col("user_id") % 9).cast("string"), F.lit(" years 2 mons "), (F.col("event_id") % 31).cast("string"), F.lit(" days "), F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), F.lit(":01:30.5"))
    return e.select("event_id", parsers.interval(text).alias("v")).select("event_id", "v.*")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id::INT END AS lower, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (user_id + 10)::INT END AS upper, event_id % 5 <> 0 AS lower_inc, false AS upper_inc, false AS empty FROM events WHERE event_id % 11 <> 0 UNION ALL SELECT event_id, NULL, NULL, false, false, true FROM events WHERE event_id % 11 = 0")
def type_range_parse(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "events")
    i = F.col("event_id")
    low, high = F.when(i % 5 == 0, "").otherwise(F.col("user_id").cast("string")), F.when(i % 7 == 0, "").otherwise((F.col("user_id") + 10).cast("string"))
    text = F.when(i % 11 == 0, "empty").otherwise(F.concat(F.lit("["), low, F.lit(","), high, F.lit(")")))
    return e.select("event_id", parsers.range_(text, "int").alias("v")).select("event_id", "v.*")


@query("SELECT event_id, (event_id % 24) * 3600000000 + 61000000 AS micros, (event_id % 12)::INT * -3600 AS offset_seconds FROM events")
def type_timetz_parse(spark, sf_dir):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(two(F.col("event_id") % 24), F.lit(":01:01-"), two(F.col("event_id") % 12))
    return fixtures.table(spark, sf_dir, "events").select("event_id", parsers.timetz(text).alias("v")).select("event_id", "v.*")


@query("SELECT p_partkey, p_retailprice::DECIMAL(12,2) AS price, p_size::DOUBLE AS x, -p_size::DOUBLE AS y FROM part")
def type_decimal_and_point(spark, sf_dir):
    p = fixtures.table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    pt = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(",-"), F.col("p_size").cast("string"), F.lit(")"))
    return p.select("p_partkey", parsers.decimal(price, 12, 2).alias("price"), parsers.point(pt).alias("pt")).select("p_partkey", "price", "pt.x", "pt.y")


@query("SELECT event_id, printf('%016X', event_id * 65537) AS canonical, event_id * 65537 AS n, printf('%016X', greatest(event_id * 65537 - 1000000, 0)) AS floor FROM events")
def lsn_roundtrip(spark, sf_dir):
    n = F.col("event_id") * 65537
    at = lsn.canonical(lsn.display(lsn.from_long(n)))
    return fixtures.table(spark, sf_dir, "events").select("event_id", at.alias("canonical"), lsn.to_decimal(at).cast("bigint").alias("n"), lsn.minus(at, 1_000_000).alias("floor"))
