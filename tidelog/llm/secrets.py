"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong findings stand alone: assignments of a password or the like, access identifiers with a
known prefix, and long hexadecimal strings.  Weak ones are reported only when a complementary part
lies in the same scope: an access identifier with a secret, or a login or endpoint with a secret.

Positions come from cutting the text at the matches: what lies between two matches has a length, and
the running sum of lengths is the position, in code points.

Linking is an interval join of parts within a document: the nearest part of each other sort, before
and after, decides whether one lies within ``scope`` code points.  So each part is looked at once,
whatever number of parts a document holds.

Null texts count as empty.  Rows are scanned one by one; repeated rows and extra columns change
nothing.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import cut

# The base patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

# Parts that count only beside a complementary part.
LOGIN = r"""(?:(?i:access_?key_?id|client_?id|account(?:_?name)?|username|user|login))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
ENDPOINT = r"""(?:https?|s3|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"""
KEY = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=])"
WEAK = {"login": LOGIN, "endpoint": ENDPOINT, "key": KEY}
#: Code points between complementary parts at most.
SCOPE = 300


SPANS = "array<struct<at:int,end:int,m:string>>"
#: Matches whose places are summed up together.
CHUNK = 64


def spans(text: Column, pattern: str) -> Column:
    """array of (at, end, m) of the matches: first code point, the one after the last, and the string."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("m")))
    steps = F.filter(steps, lambda s: s["m"].isNotNull())
    empty = lambda at: F.struct(at.alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, s):
        at = acc["at"] + s["gap"]
        end = at + F.length(s["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), end.alias("end"), s["m"].alias("m")))).alias("out"))

    # In chunks, as appending copies what there is already: first the length of each chunk, then its spans from the sum of those before.
    once = lambda value, f: F.transform(F.array(value), f)[0]
    part = lambda all_, c: F.slice(all_, c * CHUNK + 1, F.lit(CHUNK))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def placed(p):
        numbers = F.sequence(F.lit(0), F.floor(F.size(p["all"]) / CHUNK).cast("int"))
        return F.flatten(F.transform(numbers, lambda c: F.aggregate(part(p["all"], c), empty(total(F.slice(p["lens"], F.lit(1), c))), step, lambda acc: acc["out"])))

    def measured(all_):
        numbers = F.sequence(F.lit(0), F.floor(F.size(all_) / CHUNK).cast("int"))
        return F.struct(all_.alias("all"), F.transform(numbers, lambda c: F.aggregate(part(all_, c), F.lit(0), lambda acc, s: acc + s["gap"] + F.length(s["m"]))).alias("lens"))

    return once(steps, lambda all_: once(measured(all_), placed))


def _if(text: Column, hint: Column, pattern: str) -> Column:
    return F.when(hint, spans(text, pattern)).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, base and linked: arrays of (at, end, kind), base ones by place and kind, linked ones likewise.

    The columns ``n_assign``, ``n_access`` and ``n_hex`` count the base findings.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = lambda spans_, kind: F.transform(spans_, lambda s: F.struct(s["at"].alias("at"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    docs = docs.select("doc_id", text.alias("text"))
    t = F.col("text")
    lower = F.lower(t)
    words = lambda *ws: F.greatest(*(lower.contains(w) for w in ws)) if len(ws) > 1 else lower.contains(ws[0])
    assign = F.filter(_if(t, words("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN), lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 2)) >= 6)
    parts = {"assign": assign, "access": _if(t, t.contains("AKIA"), ACCESS), "hex": _if(t, t.rlike(HEX), HEX), "login": _if(t, words("key", "client", "account", "user", "login"), LOGIN), "endpoint": _if(t, t.contains("://"), ENDPOINT), "key": _if(t, t.rlike(r"[A-Za-z0-9+/]{32}"), KEY)}
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(tag(v, k).alias(k) for k, v in parts.items()))
    slim = cut(
        numbered.select(
            "row", "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
            F.array_sort(F.concat(*KINDS), _order).alias("base"),
            F.concat(*WEAK).alias("weak"),
        )
    )
    none = F.array().cast("array<struct<at:int,end:int,kind:string>>")
    plain = slim.where(F.size("weak") == 0).select("row", none.alias("linked"))
    loose = slim.where(F.size("weak") > 0)
    part = loose.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p", F.col("p.at").alias("at"), F.col("p.end").alias("end"), F.col("p.kind").alias("kind"))
    # Sorts of parts: an identifier, a secret, an endpoint.  A secret completes either other sort, and either completes a secret.
    part = part.withColumn("sort", F.when(F.col("kind").isin("access", "login"), "id").when(F.col("kind") == "endpoint", "end").otherwise("secret"))
    back = Window.partitionBy("row").orderBy("at", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy("row").orderBy("at", "end", "kind").rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for s in ("id", "end", "secret"):
        before = F.max(F.when(F.col("sort") == s, F.col("end"))).over(back)
        after = F.min(F.when(F.col("sort") == s, F.col("at"))).over(on)
        near[s] = F.coalesce(F.col("at") - before <= scope, F.lit(False)) | F.coalesce(after - F.col("end") <= scope, F.lit(False))
    part = part.select("row", "p", "kind", "sort", *(v.alias(f"near_{k}") for k, v in near.items()))
    complete = F.when(F.col("sort") == "secret", F.col("near_id") | F.col("near_end")).otherwise(F.col("near_secret"))
    linked = part.where(F.col("kind").isin(*WEAK)).groupBy("row").agg(F.array_sort(F.collect_list(F.when(complete, F.col("p"))), _order).alias("linked"))
    return slim.join(plain.union(linked), "row").select("doc_id", *(f"n_{k}" for k in KINDS), "base", "linked")


def _order(a: Column, b: Column) -> Column:
    """By place, then by kind in the listed order."""
    rank = lambda s: F.array_position(F.array(*(F.lit(k) for k in (*KINDS, *WEAK))), s["kind"])
    return F.when(a["at"] != b["at"], F.when(a["at"] < b["at"], -1).otherwise(1)).when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)


def joined(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The counts, the hash of the base spans, and all spans as a string, for every document."""
    found = scan(docs, scope)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "linked"), _order)).alias("spans"))
