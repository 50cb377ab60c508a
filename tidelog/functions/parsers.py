"""Source text literals to typed values, as column expressions.

Each parser returns null for null, and raises on malformed text unless ``strict`` is off, in which case
malformed text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(c: Column, value: Column, what: str, strict: bool) -> Column:
    if not strict:
        return value
    return F.when(c.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"malformed {what}: "), c))).otherwise(value)


def boolean(c: Column, strict: bool = True) -> Column:
    return _checked(c, F.when(c.isin("t", "true"), True).when(c.isin("f", "false"), False), "boolean", strict)


def number(c: Column, kind: str, strict: bool = True) -> Column:
    """int, bigint, smallint, float or double."""
    return _checked(c, c.try_cast(kind), kind, strict)


def decimal(c: Column, precision: int, scale: int, strict: bool = True) -> Column:
    """Digits beyond the scale are an error; a cast alone would round them."""
    ok = c.rlike(rf"^[+-]?(\d+(\.\d{{0,{scale}}})?|\.\d{{1,{max(scale, 1)}}})$")
    return _checked(c, F.when(ok, c.try_cast(f"decimal({precision},{scale})")), f"decimal({precision},{scale})", strict)


def bytea(c: Column, strict: bool = True) -> Column:
    return _checked(c, F.when(c.rlike(r"^\\x([0-9A-Fa-f]{2})*$"), F.unhex(F.substr(c, F.lit(3)))), "bytea", strict)


def date(c: Column, strict: bool = True) -> Column:
    return _checked(c, F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date")), "date", strict)


def _fraction(digits: Column) -> Column:
    """Fraction digits to microseconds; what lies beyond six digits is cut off."""
    return F.rpad(F.substring(F.coalesce(digits, F.lit("")), 1, 6), 6, "0").cast("long")


_CLOCK = r"(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d+))?"


def _clock(c: Column, pattern: str, first: int = 1) -> Column:
    part = lambda i: F.regexp_extract(c, pattern, first + i)
    return (part(0).try_cast("long") * 3600 + part(1).try_cast("long") * 60 + part(2).try_cast("long")) * 1_000_000 + _fraction(part(3))


def time_micros(c: Column, strict: bool = True) -> Column:
    """Microseconds since midnight."""
    return _checked(c, F.when(c.rlike(f"^{_CLOCK}$"), _clock(c, f"^{_CLOCK}$")), "time", strict)


def timestamp(c: Column, strict: bool = True) -> Column:
    """Without an offset: as it stands."""
    return _checked(c, F.when(c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"), F.try_to_timestamp(c).cast("timestamp_ntz")), "timestamp", strict)


def timestamptz(c: Column, strict: bool = True) -> Column:
    """With an offset such as +02, +0530 or +05:30."""
    return _checked(c, F.when(c.rlike(r"[+-]\d{2}(:?\d{2})?$"), F.try_to_timestamp(F.regexp_replace(c, r"([+-]\d{2})$", "$1:00"))), "timestamptz", strict)


def uuid(c: Column, strict: bool = True) -> Column:
    return _checked(c, F.when(c.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower(c)), "uuid", strict)


def interval(c: Column, strict: bool = True) -> Column:
    """struct(months int, days int, micros long); units are never converted into each other."""
    text = F.trim(F.regexp_replace(F.regexp_replace(c, r"^@\s*", ""), r"\s+ago$", ""))
    sign = F.when(c.rlike(r"\sago$"), -1).otherwise(1)

    def unit(names: str) -> Column:
        found = F.regexp_extract(text, rf"([+-]?\d+)\s+(?:{names})\b", 1)
        return F.coalesce(found.try_cast("long"), F.lit(0).cast("long"))

    clock = rf"(?:^|\s)([+-]?)(\d+):(\d{{2}}):(\d{{2}})(?:\.(\d+))?$"
    part = lambda i: F.regexp_extract(text, clock, i)
    micros = F.when(text.rlike(clock), F.when(part(1) == "-", -1).otherwise(1) * ((part(2).try_cast("long") * 3600 + part(3).try_cast("long") * 60 + part(4).try_cast("long")) * 1_000_000 + _fraction(part(5)))).otherwise(0)
    spelled = unit("hours?") * 3_600_000_000 + unit("mins?|minutes?") * 60_000_000
    seconds = F.regexp_extract(text, r"([+-]?\d+(?:\.\d+)?)\s+(?:secs?|seconds?)\b", 1).try_cast("decimal(28,6)")
    micros = micros + spelled + F.coalesce((seconds * 1_000_000).cast("long"), F.lit(0).cast("long"))
    months = unit("years?") * 12 + unit("mons?|months?")
    names = "years?|mons?|months?|days?|hours?|mins?|minutes?|secs?|seconds?"
    ok = text.rlike(rf"^(?:[+-]?\d+(?:\.\d+)?\s+(?:{names})\s*)*(?:[+-]?\d+:\d{{2}}:\d{{2}}(?:\.\d+)?)?$") & (text != "")
    whole = F.struct((sign * months).cast("int").alias("months"), (sign * unit("days?")).cast("int").alias("days"), (sign * micros).alias("micros"))
    return _checked(c, F.when(ok, whole), "interval", strict)


def as_interval(parts: Column) -> Column:
    """struct(months, days, micros) as one interval, to show it or to add it to a time."""
    return F.make_interval(months=parts["months"], days=parts["days"], secs=(parts["micros"] / F.lit(1_000_000)).cast("decimal(18,6)"))


def timetz(c: Column, strict: bool = True) -> Column:
    """struct(micros long, offset_seconds int); the offset is mandatory."""
    pattern = rf"^{_CLOCK}([+-])(\d{{2}})(?::?(\d{{2}}))?(?::?(\d{{2}}))?$"
    part = lambda i: F.coalesce(F.regexp_extract(c, pattern, i).try_cast("int"), F.lit(0))
    offset = F.when(F.regexp_extract(c, pattern, 5) == "-", -1).otherwise(1) * (part(6) * 3600 + part(7) * 60 + part(8))
    return _checked(c, F.when(c.rlike(pattern), F.struct(_clock(c, pattern).alias("micros"), offset.cast("int").alias("offset_seconds"))), "timetz", strict)


#: A bound: quoted with "" and \ escapes, or plain.
_BOUND = r'(?:"(?:[^"\\]|""|\\.)*"|(?:[^",()\[\]{}\\]|\\.)*)'


def _unquote(b: Column) -> Column:
    plain = F.when(b.startswith('"'), F.regexp_replace(F.substr(b, F.lit(2), F.length(b) - 2), '""', '"')).otherwise(b)
    return F.when(b == "", F.lit(None).cast("string")).otherwise(F.regexp_replace(plain, r"\\(.)", "$1"))


def _once(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _bounds(c: Column, kind: str) -> Column:
    """The parts are taken out of the text once, in a struct that the fields are made from."""
    pattern = rf"^([\[(])({_BOUND}),({_BOUND})([\])])$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    parts = F.struct(part(1).alias("open"), _unquote(part(2)).alias("low"), _unquote(part(3)).alias("high"), part(4).alias("close"))
    typed = lambda p: F.struct(p["open"].alias("open"), p["low"].alias("low"), p["high"].alias("high"), p["close"].alias("close"), p["low"].try_cast(kind).alias("lower"), p["high"].try_cast(kind).alias("upper"))

    def value(p: Column) -> Column:
        bad = (p["open"] == "") | (p["low"].isNotNull() & p["lower"].isNull()) | (p["high"].isNotNull() & p["upper"].isNull())
        made = F.struct(p["lower"].alias("lower"), p["upper"].alias("upper"), (p["low"].isNotNull() & (p["open"] == "[")).alias("lower_inc"), (p["high"].isNotNull() & (p["close"] == "]")).alias("upper_inc"))
        return F.when(~bad, made)

    return _once(parts, lambda p: _once(typed(p), value))


def range_(c: Column, kind: str = "string", strict: bool = True) -> Column:
    """struct(lower, upper, lower_inc, upper_inc, empty); an unbounded side is null and never inclusive."""
    none, no = F.lit(None).cast(kind), F.lit(False)
    empty = F.struct(none.alias("lower"), none.alias("upper"), no.alias("lower_inc"), no.alias("upper_inc"), F.lit(True).alias("empty"))
    full = _once(_bounds(c, kind), lambda b: F.when(b.isNotNull(), F.struct(*(b[f].alias(f) for f in ("lower", "upper", "lower_inc", "upper_inc")), no.alias("empty"))))
    value = F.when(F.lower(c) == "empty", empty).otherwise(full)
    if not strict:
        return value
    return _once(value, lambda v: F.when(c.isNotNull() & v.isNull(), F.raise_error(F.concat(F.lit("malformed range: "), c))).otherwise(v))


def multirange(c: Column, kind: str = "string", strict: bool = True) -> Column:
    """array of struct(lower, upper, lower_inc, upper_inc); {} is empty, not null."""
    one = rf"[\[(]{_BOUND},{_BOUND}[\])]"
    members = F.transform(F.regexp_extract_all(c, F.lit(f"({one})"), F.lit(1)), lambda m: _bounds(m, kind))
    ok = c.rlike(rf"^\{{({one}(,{one})*)?\}}$") & F.coalesce(F.forall(members, lambda m: m.isNotNull()), F.lit(True))
    return _checked(c, F.when(ok, members), "multirange", strict)


_NUM = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def _numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(f"({_NUM})"), F.lit(1)), lambda x: x.cast("double"))


def _points(c: Column) -> Column:
    n = _numbers(c)
    return F.transform(F.sequence(F.lit(0), F.greatest((F.size(n) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(n, 2 * i).alias("x"), F.get(n, 2 * i + 1).alias("y")))


_PT = rf"\({_NUM},{_NUM}\)"


def point(c: Column, strict: bool = True) -> Column:
    return _checked(c, F.when(c.rlike(f"^{_PT}$"), F.get(_points(c), 0)), "point", strict)


def segment(c: Column, strict: bool = True) -> Column:
    """A line segment ``[(..),(..)]`` or a box ``(..),(..)``: struct(p1, p2)."""
    p = _points(c)
    return _checked(c, F.when(c.rlike(rf"^(\[{_PT},{_PT}\]|{_PT},{_PT})$"), F.struct(F.get(p, 0).alias("p1"), F.get(p, 1).alias("p2"))), "lseg or box", strict)


def line(c: Column, strict: bool = True) -> Column:
    n = _numbers(c)
    return _checked(c, F.when(c.rlike(rf"^\{{{_NUM},{_NUM},{_NUM}\}}$"), F.struct(F.get(n, 0).alias("a"), F.get(n, 1).alias("b"), F.get(n, 2).alias("c"))), "line", strict)


def circle(c: Column, strict: bool = True) -> Column:
    n = _numbers(c)
    return _checked(c, F.when(c.rlike(rf"^<{_PT},{_NUM}>$"), F.struct(F.get(n, 0).alias("x"), F.get(n, 1).alias("y"), F.get(n, 2).alias("r"))), "circle", strict)


def path(c: Column, strict: bool = True) -> Column:
    """struct(is_closed, points); closed if it starts with a parenthesis."""
    many = rf"{_PT}(,{_PT})*"
    return _checked(c, F.when(c.rlike(rf"^(\[{many}\]|\({many}\))$"), F.struct(c.startswith("(").alias("is_closed"), _points(c).alias("points"))), "path", strict)


def polygon(c: Column, strict: bool = True) -> Column:
    return _checked(c, F.when(c.rlike(rf"^\({_PT}(,{_PT})*\)$"), _points(c)), "polygon", strict)


#: Microseconds from 1970 to 2000, where the source's clock starts; a fixed value.
EPOCH_MICROS = 946_684_800_000_000


def source_clock(micros: Column) -> Column:
    """Microseconds since 2000 to a timestamp."""
    return F.timestamp_micros(micros + F.lit(EPOCH_MICROS))


def utc(c: Column, strict: bool = True) -> Column:
    """A UTC timestamp in RFC 3339 form, which must end in Z."""
    return _checked(c, F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), F.try_to_timestamp(c)), "UTC timestamp", strict)


def numeric_modifier(typmod: Column) -> Column:
    """struct(precision, scale) of a packed numeric type modifier, null if unconstrained."""
    return F.when(typmod >= 4, F.struct(F.shiftright(typmod - 4, 16).bitwiseAND(F.lit(0xFFFF)).alias("precision"), (typmod - 4).bitwiseAND(F.lit(0xFFFF)).alias("scale")))
