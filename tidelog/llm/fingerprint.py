"""Document fingerprints by I-Match with several randomised lexicon subsets, in DataFrame operations only.

The lexicon has the terms whose document frequency lies within a band.  It is parted at random (by a hash
of the term) into ``SUBSETS`` subsets, and each subset is thinned: level L of it keeps one term in
2**L.  A document's distinct terms in a subset, sorted, are hashed to one component.  The level follows the
number of the document's distinct terms, so that a component covers a few terms and short and long
documents alike lose few components to an edit; components of the next level stand beside it,
so that documents on either side of a limit can still be compared.

Likeness of two fingerprints: equal components among those that either has, at a level both have.

The frequency band is relative to the number of documents.  Terms above the band are at most (mean terms of a
document / ``HIGH``) in number, whatever the corpus; they are counted before they are broadcast.  All other terms are joined by shuffle.

A null text counts as empty.  A text without terms in the band is fingerprinted by a hash of its
whole text.  Equal texts have equal fingerprints.  Rows with one doc_id are ordered by text, and identical rows are neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import cut, small

#: Subsets of the lexicon; the band of document frequencies: from LOW documents to a share HIGH of them.
SUBSETS, LOW, HIGH = 16, 2, 0.05
#: What lies between terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(F.array_remove(F.split(F.lower(text), BETWEEN, -1), ""), lambda t: F.xxhash64(t)))


def level(n: Column) -> Column:
    """The level for n distinct terms: a component covers one or two terms of them on average."""
    return F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)) / F.lit(float(SUBSETS)))), F.lit(0)).cast("int")


def sampled(hashes: Column, lev: Column) -> Column:
    """The terms that stay at a level."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), lev + 8) - F.lit(256)
    return F.filter(hashes, lambda h: h.bitwiseAND(mask) == 0)


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df) over all documents."""
    return docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def following(docs: DataFrame) -> DataFrame:
    """Each document with the text of the next one by (doc_id, text); the last one's next is the first.

    Documents are dealt into ranges of doc_id by quantiles, and the first one of each range is also put at the end of the
    range before, so no sort takes all rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.select(F.percentile_approx("doc_id", F.array(*(F.lit(i / parts) for i in range(1, parts))), 10_000).alias("c")).first()["c"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    bucket = F.lit(0)
    if cuts:
        # By two steps, the root of as many comparisons each: first every so many cut points, then those in between.
        step = max(1, int(len(cuts) ** 0.5))
        passed = lambda points: F.aggregate(points, F.lit(0), lambda a, c: a + (F.col("doc_id") >= c).cast("int"))
        coarse = passed(F.array(*(F.lit(c) for c in cuts[step - 1 :: step]))) * step
        bucket = F.coalesce(coarse + passed(F.slice(F.array(*(F.lit(c) for c in cuts)), coarse + 1, F.lit(step))), F.lit(0))
    dealt = docs.withColumn("b", bucket)
    # The first document of each range: as many rows as ranges.
    heads = dealt.groupBy("b").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("h")).orderBy("b").collect()
    if not heads:
        return docs.select("doc_id", "text", F.lit("").alias("next_text"), F.col("doc_id").alias("next_id"), F.lit(0).cast("bigint").alias("next_key"))
    names = [r["b"] for r in heads]
    before = {b: names[i - 1] for i, b in enumerate(names)}
    first_ids = [(b, r["h"]["doc_id"]) for b, r in zip(names, heads, strict=True)]
    is_head = F.coalesce(*(F.when((F.col("b") == b) & F.col("doc_id").eqNullSafe(F.lit(i)), F.lit(before[b])) for b, i in first_ids))
    copies = dealt.withColumn("to", is_head)
    rows = copies.select("doc_id", "text", F.explode(F.when(F.col("to").isNotNull(), F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("end")), F.struct(F.col("to").alias("b"), F.lit(1).alias("end")))).otherwise(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("end"))))).alias("p")).select("doc_id", "text", "p.b", "p.end")
    order = Window.partitionBy("b").orderBy("end", "doc_id", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_id", F.lead("doc_id").over(order)).withColumn("next_key", F.xxhash64("next_text")).where("end = 0").drop("b", "end")


def band(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(terms within the band, terms above it).  The second is bounded, see above."""
    n = docs.count()
    high = max(float(LOW), HIGH * n)
    df = cut(frequencies(docs, text).where(F.col("df") >= LOW))
    return df.where(F.col("df") <= high).select("term"), df.where(F.col("df") > high).select("term")


def components(rows: DataFrame, lexicon: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(id, role, parts) from (id, role, lev, hashes): parts has a hash or null for each subset, at this level and then at the next."""
    known, frequent = lexicon
    each = rows.select("id", "role", "lev", F.explode("hashes").alias("term")).join(small(frequent), "term", "left_anti").join(known, "term", "left_semi")
    kept = each.groupBy("id", "role").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.first("lev").alias("lev"))

    def part(i: Column) -> Column:
        subset = F.pmod(i, F.lit(SUBSETS))
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("lev") + 8 + (i >= SUBSETS).cast("int")) - F.lit(256)
        mine = F.filter("terms", lambda t: (F.pmod(F.shiftrightunsigned(t, 50), F.lit(SUBSETS)) == subset) & (t.bitwiseAND(mask) == 0))
        return F.when(F.size(mine) > 0, F.hash(mine))

    return kept.select("id", "role", F.transform(F.sequence(F.lit(0), F.lit(2 * SUBSETS - 1)), part).alias("parts"))


def render(parts: Column, lev: Column, text_hash: Column) -> Column:
    """The fingerprint as a string: the level, then each component in hexadecimal or nothing; or a hash of the text."""
    hexed = F.transform(parts, lambda p: F.coalesce(F.lower(F.lpad(F.right(F.hex(p), F.lit(8)), 8, "0")), F.lit("")))
    empty = F.coalesce(F.forall(parts, lambda p: p.isNull()), F.lit(True))
    return F.when(empty, F.concat(F.lit("t"), text_hash)).otherwise(F.concat(lev.cast("string"), F.lit(":"), F.array_join(hexed, ".")))


def likeness(a: Column, b: Column, la: Column, lb: Column, fa: Column, fb: Column) -> Column:
    """Of two arrays of components with their levels and fingerprints; 0 to 1."""

    def share(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: F.when(p.isNotNull() | q.isNotNull(), F.coalesce(p == q, F.lit(False)).cast("int")))
        some = F.filter(pairs, lambda p: p.isNotNull())
        return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0), lambda s, p: s + p) / F.size(some)).otherwise(0.0)

    this, after = (lambda x: F.slice(x, 1, SUBSETS)), (lambda x: F.slice(x, 1 + SUBSETS, SUBSETS))
    got = F.when(la == lb, share(a, b)).when(la + 1 == lb, share(after(a), this(b))).when(la == lb + 1, share(this(a), after(b))).otherwise(0.0)
    return F.when(fa == fb, 1.0).otherwise(F.coalesce(got, F.lit(0.0))).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, lev and parts of each document's text."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"), terms(F.coalesce("text", F.lit(""))).alias("all")).withColumn("lev", level(F.size("all"))).select("id", "doc_id", "whole", "lev", F.lit(0).alias("role"), sampled(F.col("all"), F.col("lev")).alias("hashes")))
    made = components(rows, band(docs))
    return rows.join(made.drop("role"), "id", "left").select("doc_id", render(F.col("parts"), F.col("lev"), F.col("whole")).alias("fingerprint"), "lev", "parts")


def compare(docs: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness; see the query's contract.

    The edited form has the last 1/``share`` of its code points replaced by the first as many of the next document.
    """
    near = following(docs)
    n = F.length("text")
    k = F.floor(n / share).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    near = near.select("doc_id", "next_id", "next_key", F.xxhash64("text").alias("key"), n.cast("long").alias("n_chars"), F.sha2("text", 256).alias("w0"), F.sha2(edited, 256).alias("w1"), terms(F.col("text")).alias("t0"), terms(edited).alias("t1"))
    near = near.withColumn("l0", level(F.size("t0"))).withColumn("l1", level(F.size("t1")))
    rows = cut(near.select(F.monotonically_increasing_id().alias("id"), "doc_id", "next_id", "next_key", "key", "n_chars", "w0", "w1", "l0", "l1", sampled(F.col("t0"), F.col("l0")).alias("h0"), sampled(F.col("t1"), F.col("l1")).alias("h1")))
    both = rows.select("id", F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("l0").alias("lev"), F.col("h0").alias("hashes")), F.struct(F.lit(1).alias("role"), F.col("l1").alias("lev"), F.col("h1").alias("hashes")))).alias("x")).select("id", "x.role", "x.lev", "x.hashes")
    parts = components(both, band(docs)).groupBy("id").agg(F.max(F.when(F.col("role") == 0, F.col("parts"))).alias("p0"), F.max(F.when(F.col("role") == 1, F.col("parts"))).alias("p1"))
    made = rows.drop("h0", "h1").join(parts, "id", "left").withColumn("f0", render(F.col("p0"), F.col("l0"), F.col("w0"))).withColumn("f1", render(F.col("p1"), F.col("l1"), F.col("w1")))
    made = cut(made)
    other = made.select(F.col("doc_id").alias("o_id"), F.col("key").alias("o_key"), F.col("l0").alias("ol"), F.col("p0").alias("op"), F.col("f0").alias("of")).dropDuplicates(["o_id", "o_key"])
    out = made.join(other, F.col("next_id").eqNullSafe(F.col("o_id")) & (F.col("next_key") == F.col("o_key")), "left")
    return out.select(
        "doc_id", "n_chars", F.col("w1").alias("edited_sha256"), F.col("f0").alias("fingerprint"), F.col("f1").alias("edited_fingerprint"),
        likeness(F.col("p0"), F.col("p1"), F.col("l0"), F.col("l1"), F.col("f0"), F.col("f1")).alias("near_edited"),
        likeness(F.col("p0"), F.col("op"), F.col("l0"), F.col("ol"), F.col("f0"), F.col("of")).alias("near_next"),
    )
