"""Source types to Spark columns, and a table's physical plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import parsers

# Type names of the source and the Spark types they become.
DIRECT = {
    "bool": "boolean", "int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "text": "string", "varchar": "string", "bpchar": "string",
    "char": "string", "bytea": "binary", "json": "string", "jsonb": "string", "date": "date", "time": "bigint", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "uuid": "string",
}
TEXTUAL = ("bit", "varbit", "inet", "cidr", "macaddr", "macaddr8", "tsvector", "tsquery", "pg_lsn", "xid", "xid8", "txid_snapshot", "xml", "enum")
RANGES = {"int4range": "int", "int8range": "bigint", "numrange": "string", "tsrange": "timestamp_ntz", "tstzrange": "timestamp", "daterange": "date"}
MULTIRANGES = {"int4multirange": "int", "int8multirange": "bigint", "nummultirange": "string", "tsmultirange": "timestamp_ntz", "tstzmultirange": "timestamp", "datemultirange": "date"}
GEOMETRY = {"point": parsers.point, "line": parsers.line, "lseg": parsers.segment, "box": parsers.segment, "circle": parsers.circle, "path": parsers.path, "polygon": parsers.polygon}
RESERVED = re.compile(r"^_")
BARE = re.compile(r"^[a-z_][a-z0-9_]*$")


class PlanError(ValueError):
    """A table that cannot be mirrored as described."""


@dataclass(frozen=True)
class SourceColumn:
    name: str
    type: str
    is_key: bool = False
    precision: int | None = None
    scale: int | None = None


def emit(c: SourceColumn, strict: bool = True) -> list[Column]:
    """The typed columns of a text column: one, or several for an interval, a time with zone or a range."""
    v, t = F.col(c.name), c.type
    flat = lambda s, parts: [s[p].alias(f"{c.name}_{p}") for p in parts]
    if t == "numeric":
        if c.precision is None or c.precision > 38:
            return [v]
        return [parsers.decimal(v, c.precision, c.scale or 0, strict).alias(c.name)]
    if t in TEXTUAL:
        return [v]
    if t == "interval":
        return flat(parsers.interval(v, strict), ("months", "days", "micros"))
    if t == "timetz":
        return flat(parsers.timetz(v, strict), ("micros", "offset_seconds"))
    if t in RANGES:
        return flat(parsers.range_(v, RANGES[t], strict), ("lower", "upper", "lower_inc", "upper_inc", "empty"))
    if t in MULTIRANGES:
        return [parsers.multirange(v, MULTIRANGES[t], strict).alias(c.name)]
    if t in GEOMETRY:
        return [GEOMETRY[t](v, strict).alias(c.name)]
    special = {"bool": parsers.boolean, "bytea": parsers.bytea, "date": parsers.date, "time": parsers.time_micros, "timestamp": parsers.timestamp, "timestamptz": parsers.timestamptz, "uuid": parsers.uuid}
    if t in special:
        return [special[t](v, strict).alias(c.name)]
    if t in DIRECT:
        return [v if DIRECT[t] == "string" else parsers.number(v, DIRECT[t], strict).alias(c.name)]
    raise PlanError(f"unsupported type {t} of column {c.name}")


@dataclass
class TablePlan:
    """Which columns a source table has in the log and the mirror, and which of them are keys."""

    columns: list[SourceColumn]
    names: dict[str, list[str]] = field(init=False)

    def __post_init__(self):
        seen: set[str] = set()
        self.names = {}
        for c in self.columns:
            if RESERVED.match(c.name):
                raise PlanError(f"reserved name {c.name}")
            if not BARE.match(c.name):
                raise PlanError(f"not a bare lower-case name: {c.name}")
            suffixes = {"interval": ("_months", "_days", "_micros"), "timetz": ("_micros", "_offset_seconds")}.get(c.type, ("_lower", "_upper", "_lower_inc", "_upper_inc", "_empty") if c.type in RANGES else ("",))
            self.names[c.name] = [c.name + s for s in suffixes]
            for n in self.names[c.name]:
                if n in seen:
                    raise PlanError(f"duplicate column {n}")
                seen.add(n)
        if not any(c.is_key for c in self.columns):
            raise PlanError("no key column")

    @property
    def keys(self) -> list[str]:
        """All columns a key fans out to are keys."""
        return [n for c in self.columns if c.is_key for n in self.names[c.name]]

    def typed(self, rows: DataFrame, strict: bool = True) -> DataFrame:
        """Text columns to typed ones; columns of the log beside them stay."""
        other = [c for c in rows.columns if c not in self.names]
        return rows.select(*(e for c in self.columns for e in emit(c, strict)), *other)
