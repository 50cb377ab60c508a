"""Source messages to change rows: routing, transaction gate, and the binary frame decoder."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.plans.scratch import cut

#: One decoded row message: old and new images (map of column to value; null for null), and names omitted from the new image.
MESSAGE = "op string, relation string, xid long, top_xid long, lsn string, old map<string,string>, new map<string,string>, omitted array<string>"


def route(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Change rows of insert, update, delete and truncate messages.

    An update that changes a key becomes a delete of the old key and an update of the new one, at one position.  A key
    the new image omits is unchanged and is taken from the old one.  A truncate of several relations is a row for each.
    """
    old_key = lambda k: F.try_element_at("old", F.lit(k))
    new_key = lambda k: F.when(F.array_contains("omitted", k), old_key(k)).otherwise(F.try_element_at("new", F.lit(k)))
    moved = F.lit(False)
    for k in keys:
        moved = moved | (~F.array_contains("omitted", k) & ~old_key(k).eqNullSafe(F.try_element_at("new", F.lit(k))))
    moved = (F.col("op") == "u") & F.col("old").isNotNull() & moved
    key_map = lambda f: F.map_from_arrays(F.array(*(F.lit(k) for k in keys)), F.array(*(f(k) for k in keys)))
    filled = F.when(F.col("new").isNotNull(), F.map_concat(F.map_filter("new", lambda n, v: ~n.isin(*keys)), key_map(new_key)))
    left = F.array_except(F.col("omitted"), F.array(*(F.lit(k) for k in keys)))
    none = F.array().cast("array<string>")
    blank = F.lit(None).cast("map<string,string>")
    row = lambda op, image, om: F.struct(F.lit(op).alias("_op"), image.alias("image"), om.alias("_omitted"))
    gone, kept = row("d", key_map(old_key), none), row("u", filled, left)
    rows = (
        F.when(F.col("op") == "i", F.array(row("i", filled, left)))
        .when(moved, F.array(gone, kept))
        .when(F.col("op") == "u", F.array(kept))
        .when(F.col("op") == "d", F.array(gone))
        .otherwise(F.array(row("t", blank, none)))
    )
    return messages.select("*", F.explode(rows).alias("r")).select(F.explode(F.split("relation", ",")).alias("relation"), "xid", "top_xid", F.col("lsn").alias("_lsn"), "r._op", "r.image", "r._omitted")


def commit_gate(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows of committed transactions, stamped with their commit.

    outcomes: (kind, top_xid, xid, commit_lsn): ``commit`` or ``abort`` of a whole transaction (xid = top_xid), or the abort of a savepoint
    (xid <> top_xid), which drops exactly that part.  Nothing shows before its commit.
    """
    commits = outcomes.where("kind = 'commit'").select(F.col("top_xid").alias("t_"), F.col("commit_lsn").alias("_commit_lsn"))
    whole = outcomes.where("kind = 'abort' and xid = top_xid").select(F.col("top_xid").alias("t_"))
    parts = outcomes.where("kind = 'abort' and xid <> top_xid").select(F.col("top_xid").alias("t_"), F.col("xid").alias("x_")).distinct()
    kept = rows.join(whole, F.col("top_xid") == F.col("t_"), "left_anti").join(parts, (F.col("top_xid") == F.col("t_")) & (F.col("xid") == F.col("x_")), "left_anti")
    return kept.join(commits, F.col("top_xid") == F.col("t_")).drop("t_")


def project(rows: DataFrame, relation: str, columns: dict[str, str]) -> DataFrame:
    """A relation's change rows with typed columns (name to type)."""
    return rows.where(F.col("relation") == relation).select(*(F.try_element_at("image", F.lit(c)).cast(t).alias(c) for c, t in columns.items()), "_op", "_commit_lsn", "_lsn", "_omitted")


class Reader:
    """Bounded reads from one frame."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError(f"frame ends at {len(self.data)}, {n} bytes wanted at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack(">" + form, self.take(struct.calcsize(form)))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ValueError("string without end")
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out

    def tuple_(self) -> list[tuple[str, str | None]]:
        """(tag, value) of each column: n null, u unchanged and left out, t text, b binary (as hexadecimal)."""
        out: list[tuple[str, str | None]] = []
        for _ in range(self.number("H")):
            tag = chr(self.number("B"))
            if tag in "nu":
                out.append((tag, None))
            elif tag in "tb":
                raw = self.take(self.number("i"))
                out.append((tag, raw.decode() if tag == "t" else "\\x" + raw.hex()))
            else:
                raise ValueError(f"unknown tuple tag {tag!r}")
        return out


#: What :func:`decode` returns: kind is begin, commit, insert, update, delete, truncate, stream_start, stream_stop, stream_commit, stream_abort, relation, type, message,
#: origin, or one of the five of two-phase commits.
DECODED = "seq long, kind string, xid long, sub_xid long, lsn string, relations array<long>, old array<struct<tag:string,value:string>>, old_kind string, new array<struct<tag:string,value:string>>, name string, columns array<struct<name:string,type:long,modifier:int,is_key:boolean>>, content string"


def decode_frame(data: bytes, streaming: bool) -> dict:
    """One logical-replication message.  Inside a streamed block, row messages begin with their transaction's number."""
    r = Reader(data)
    kind = chr(r.number("B"))
    out: dict = {"kind": None}
    hexed = lambda n: f"{n:016X}"
    if streaming and kind in "RYIUDTM":
        out["sub_xid"] = r.number("I")
    if kind == "B":
        out |= {"kind": "begin", "lsn": hexed(r.number("Q"))}
        r.number("q")
        out["xid"] = r.number("I")
    elif kind in "Cc":
        if kind == "c":
            out["xid"] = r.number("I")
        r.number("B")
        out |= {"kind": "commit" if kind == "C" else "stream_commit", "lsn": hexed(r.number("Q"))}
        r.number("Q"), r.number("q")
    elif kind == "S":
        out |= {"kind": "stream_start", "xid": r.number("I")}
        r.number("B")
    elif kind == "E":
        out["kind"] = "stream_stop"
    elif kind == "A":
        out |= {"kind": "stream_abort", "xid": r.number("I"), "sub_xid": r.number("I")}
    elif kind == "R":
        out["relations"] = [r.number("I")]
        name = f"{r.text()}.{r.text()}"
        r.number("B")
        columns = [{"is_key": bool(r.number("B") & 1), "name": r.text(), "type": r.number("I"), "modifier": r.number("i")} for _ in range(r.number("H"))]
        out |= {"kind": "relation", "name": name, "columns": columns}
    elif kind in "IUD":
        out |= {"kind": {"I": "insert", "U": "update", "D": "delete"}[kind], "relations": [r.number("I")]}
        tag = chr(r.number("B"))
        if tag in "KO":
            out |= {"old_kind": tag, "old": r.tuple_()}
            tag = chr(r.number("B")) if kind == "U" else ""
        if tag == "N":
            out["new"] = r.tuple_()
        elif tag:
            raise ValueError(f"unknown image tag {tag!r}")
    elif kind == "T":
        n = r.number("I")
        r.number("B")
        out |= {"kind": "truncate", "relations": [r.number("I") for _ in range(n)]}
    elif kind == "Y":
        out |= {"kind": "type", "relations": [r.number("I")]}
        out["name"] = f"{r.text()}.{r.text()}"
    elif kind == "M":
        r.number("B")
        out |= {"kind": "message", "lsn": hexed(r.number("Q")), "name": r.text()}
        out["content"] = r.take(r.number("I")).hex()
    elif kind == "O":
        out |= {"kind": "origin", "lsn": hexed(r.number("Q")), "name": r.text()}
    elif kind in "bP":
        if kind == "P":
            r.number("B")
        out |= {"kind": {"b": "begin_prepare", "P": "prepare"}[kind], "lsn": hexed(r.number("Q"))}
        r.number("Q"), r.number("q")
        out |= {"xid": r.number("I"), "name": r.text()}
    elif kind in "Kr":
        r.number("B")
        out |= {"kind": {"K": "commit_prepared", "r": "rollback_prepared"}[kind], "lsn": hexed(r.number("Q"))}
        r.number("Q"), r.number("q")
        if kind == "r":
            r.number("q")
        out |= {"xid": r.number("I"), "name": r.text()}
    elif kind == "p":
        r.number("B")
        out |= {"kind": "stream_prepare", "lsn": hexed(r.number("Q"))}
        r.number("Q"), r.number("q")
        out |= {"xid": r.number("I"), "name": r.text()}
    else:
        raise ValueError(f"unknown message {kind!r}")
    return out


def running_last(rows: DataFrame, slot: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the last value, not null, up to each row of its slot, in ranges of the order.

    A slot's rows need not fit one task: each range is looked at by itself, and only its last value is carried on to the next.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.withColumn("v_", value).repartitionByRange(n, slot, order).withColumn("p_", F.spark_partition_id()))
    carried = dealt.groupBy(slot, "p_").agg(F.max_by("v_", F.when(F.col("v_").isNotNull(), F.col(order))).alias("end_"))
    # Written, it is known to be small, and joined without dealing out the rows again.
    carried = cut(carried.withColumn("carry_", F.last("end_", ignorenulls=True).over(Window.partitionBy(slot).orderBy("p_").rowsBetween(Window.unboundedPreceding, -1))).select(F.col(slot).alias("s_"), F.col("p_").alias("c_"), "carry_"))
    within = F.last("v_", ignorenulls=True).over(Window.partitionBy("p_", slot).orderBy(order))
    # A slot may be null; its rows are kept, too.
    here = F.col(slot).eqNullSafe(F.col("s_")) & (F.col("p_") == F.col("c_"))
    return dealt.withColumn("own_", within).join(carried, here).withColumn(name, F.coalesce("own_", "carry_")).drop("v_", "p_", "own_", "s_", "c_", "carry_")


def _number(data: Column, at: int, size: int) -> Column:
    """An unsigned big-endian number within a frame, from byte ``at`` (from 1) on."""
    return F.conv(F.hex(F.substring(data, at, size)), 16, 10).cast("long")


def decode(frames: DataFrame) -> DataFrame:
    """(slot, seq, data) of streams to messages; without a slot, all frames are one stream.

    Whether a frame lies within a streamed block, and of which transaction, follows from the last frame before it that begins or ends one; its first bytes tell.  So
    frames are decoded side by side, whatever the length of a stream.
    """
    slot = F.col("slot") if "slot" in frames.columns else F.lit("")
    rows = frames.select(slot.alias("slot"), "seq", "data")
    first = F.hex(F.substring("data", 1, 1))
    # S and E open and close a block of a streamed transaction, B begins an ordinary one.
    state = lambda inside, xid: F.struct(F.lit(inside).alias("inside"), xid.cast("long").alias("xid"))
    state = F.when(first == "53", state(True, _number(F.col("data"), 2, 4))).when(first == "45", state(False, F.lit(None))).when(first == "42", state(False, _number(F.col("data"), 18, 4)))
    placed = running_last(rows, "slot", "seq", state, "state").select("slot", "seq", "data", F.coalesce("state.inside", F.lit(False)).alias("inside"), F.col("state.xid").alias("top"))
    image = pa.list_(pa.struct([("tag", pa.string()), ("value", pa.string())]))
    schema = pa.schema([("slot", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("xid", pa.int64()), ("sub_xid", pa.int64()), ("lsn", pa.string()), ("relations", pa.list_(pa.int64())), ("old", image), ("old_kind", pa.string()), ("new", image), ("name", pa.string()), ("columns", pa.list_(pa.struct([("name", pa.string()), ("type", pa.int64()), ("modifier", pa.int32()), ("is_key", pa.bool_())]))), ("content", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for slot, seq, data, inside, top in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = decode_frame(data, inside)
                row = {"slot": slot, "seq": seq, **m, "xid": m.get("xid", top)}
                for side in ("old", "new"):
                    if m.get(side) is not None:
                        row[side] = [{"tag": t, "value": v} for t, v in m[side]]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return placed.mapInArrow(run, "slot string, " + DECODED)


def violations(messages: DataFrame) -> DataFrame:
    """Messages that the protocol does not allow where they stand: (slot, seq, kind, why).

    A block must not begin within another nor end outside one, a whole transaction must not end within a block, and rows belong to a transaction.
    """
    before = F.when(F.col("kind").isin("begin", "stream_start"), F.col("kind")).when(F.col("kind").isin("commit", "stream_stop"), F.lit("none"))
    # The state after the row before: of everything up to this row, this row's own change is taken back.
    marks = messages.where(before.isNotNull()).select("slot", "seq", before.alias("to_"))
    marks = marks.withColumn("was_", F.lag("to_", 1, "none").over(Window.partitionBy("slot").orderBy("seq")))
    held = running_last(messages.select("slot", "seq", "kind").join(marks.select("slot", "seq", "was_"), ["slot", "seq"], "left"), "slot", "seq", before, "now_")
    state = F.coalesce("was_", "now_", F.lit("none"))
    kind = F.col("kind")
    why = (
        F.when(kind.isin("begin", "stream_start") & (state != "none"), "begins within another transaction")
        .when((kind == "stream_stop") & (state != "stream_start"), "ends a block that is not open").when((kind == "commit") & (state != "begin"), "commits what did not begin")
        .when(kind.isin("stream_commit", "stream_abort") & (state != "none"), "ends a transaction within a block")
        .when(kind.isin("insert", "update", "delete", "truncate") & (state == "none"), "row outside a transaction")
    )
    return held.withColumn("why", why).where("why is not null").select("slot", "seq", "kind", "why")


def relations(messages: DataFrame) -> DataFrame:
    """(slot, oid, version, name, columns, since, until): every description of a relation, and the messages it holds for (until is the next one's, or null)."""
    r = messages.where("kind = 'relation'").select("slot", F.element_at("relations", 1).alias("oid"), "name", "columns", F.col("seq").alias("since"))
    w = Window.partitionBy("slot", "oid").orderBy("since")
    return r.withColumn("until", F.lead("since").over(w)).withColumn("version", F.row_number().over(w))


def outcomes(messages: DataFrame) -> DataFrame:
    """(slot, kind, top_xid, xid, commit_lsn) as :func:`commit_gate` takes them."""
    kind = F.when(F.col("kind") == "stream_abort", "abort").otherwise("commit")
    return messages.where(F.col("kind").isin("commit", "stream_commit", "stream_abort")).select("slot", kind.alias("kind"), F.col("xid").alias("top_xid"), F.coalesce("sub_xid", "xid").alias("xid"), F.col("lsn").alias("commit_lsn"))


#: Relations are broadcast up to so many descriptions, which a count checks.
RELATIONS = 100_000


def changes(messages: DataFrame, internal: tuple[str, ...] = ()) -> DataFrame:
    """Row messages (see :data:`MESSAGE`) with names instead of numbers, from decoded messages.

    Each is held against the description of its relation that was the last one before it.  Where that one stands is found in order, range by range, so the
    number of descriptions does not multiply with that of rows.  A row of an unknown relation, or with another number of columns than it has, is an error.  Relations named in ``internal`` (the engine's own) are left out.
    """
    known = relations(messages)
    rows = messages.where(F.col("kind").isin("insert", "update", "delete", "truncate")).select("slot", "seq", "kind", "xid", "sub_xid", "old", "new", F.explode("relations").alias("oid"))
    key = F.struct("slot", "oid").alias("key_")
    marks = known.select(key, F.col("since").alias("seq"), "since")
    both = rows.select(key, "seq", F.struct(*(c for c in rows.columns if c != "seq")).alias("row_")).unionByName(marks, allowMissingColumns=True)
    placed = running_last(both, "key_", "seq", F.col("since"), "at_").where("row_ is not null").select("seq", "row_.*", "at_")
    known = F.broadcast(known) if known.limit(RELATIONS + 1).count() <= RELATIONS else known
    k = known.select(F.col("slot").alias("s_"), F.col("oid").alias("o_"), "name", "columns", "since", "version")
    held = placed.join(k, (F.col("slot") == F.col("s_")) & (F.col("oid") == F.col("o_")) & (F.col("at_") == F.col("since")), "left")
    names = F.transform("columns", lambda c: c["name"])
    wide = lambda image: F.col(image).isNotNull() & (F.size(image) != F.size("columns"))
    held = held.withColumn("name", F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("row of an unknown relation "), F.col("oid").cast("string")))).when(wide("old") | wide("new"), F.raise_error(F.concat(F.lit("another number of columns than "), F.col("name")))).otherwise(F.col("name")))
    as_map = lambda image: F.when(F.col(image).isNotNull(), F.map_from_arrays(_held(names, image), F.transform(F.filter(F.col(image), lambda v: v["tag"] != "u"), lambda v: v["value"])))
    omitted = F.when(F.col("new").isNotNull(), F.filter(F.zip_with(names, F.col("new"), lambda n, v: F.when(v["tag"] == "u", n)), lambda n: n.isNotNull())).otherwise(F.array().cast("array<string>"))
    op = F.substring("kind", 1, 1)
    out = held.where(~F.col("name").isin(*internal)) if internal else held
    return out.select(op.alias("op"), F.col("name").alias("relation"), "version", F.coalesce("sub_xid", "xid").alias("xid"), F.col("xid").alias("top_xid"), F.lpad(F.hex("seq"), 16, "0").alias("lsn"), as_map("old").alias("old"), as_map("new").alias("new"), omitted.alias("omitted"))


def _held(names: Column, image: str) -> Column:
    """The names of an image's columns that are not left out."""
    return F.filter(F.zip_with(names, F.col(image), lambda n, v: F.when(v["tag"] != "u", n)), lambda n: n.isNotNull())
