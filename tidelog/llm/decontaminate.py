"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``window`` words (the whole item if shorter).  A window occurs in a document
only if all its shingles do, so one necessary shingle is enough to find candidates:

1. The documents' occurrences of benchmark shingles are counted: one aggregation, combined before its shuffle.
2. A window's shingles are ordered by that rarity.  Its prefix is the rarest one; a window with a shingle that no
   document holds occurs nowhere and has none.
3. Only prefix shingles are joined to the documents' shingles.  A match at a place gives the place where the window would start;
   the length and positional bounds drop those that would start before the document or end after it.
4. What remains is verified word by word against the document, over windows of the item's own size.

Benchmark tables are small beside the corpus, but that is checked: shingles are broadcast only
if a count shows them within ``common.BROADCAST_ROWS``; beyond that the same joins shuffle.

Null and empty texts have no words: such documents have no hits, such items no windows.  Null
item_ids count as the item named "null" in the list of items.  Rows with one doc_id are told apart by
their text; identical rows get the same result.  Empty tables give no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import cut, marked, row_key, small

# What lies between words, and the letters that are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 4


def words(text: str = "text") -> Column:
    """array of the words of a text; empty for null."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def _shingles(w: Column, n: int) -> Column:
    """array of 64-bit hashes of each run of n words."""
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.lit(n), *(F.get(w, i + k) for k in range(n))))).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(item, n, start, body): the distinct windows of each item; n words each, joined by spaces."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words().alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    return w.select("item", n.alias("n"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " ")))).alias("body"))


def _matches(docs: DataFrame, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, key_, len, place and the columns of ``keys`` wherever a document has one of their shingles."""
    found = None
    for k in sizes:
        # The shingles are a column before they are exploded, as all words would be copied beside each shingle otherwise.
        part = docs.select("doc_id", "key_", F.size("w").alias("len"), _shingles(F.col("w"), k).alias("all_"))
        part = part.select("doc_id", "key_", "len", F.posexplode_outer("all_").alias("place", "shingle")).join(keys, "shingle", "inner")
        found = part if found is None else found.union(part)
    return found


def occurrences(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """doc_id, key_, n_words and c, the (start, n, body) of every occurrence of a window, for every document.

    wins: (n, body) of the windows, as in :func:`windows`.
    """
    g = F.least("n", F.lit(SHINGLE))
    bodies = wins.select("n", "body").distinct()
    sizes = sorted(r["g"] for r in bodies.select(g.alias("g")).distinct().collect())  # SHINGLE values at most
    docs = docs.select("doc_id", row_key().alias("key_"), words().alias("w"))
    none = F.array().cast("array<struct<start:int,n:int,body:string>>")
    if not sizes:
        return docs.select("doc_id", "key_", F.size("w").cast("long").alias("n_words"), none.alias("c"))
    each = cut(bodies.withColumn("v", F.split("body", " ")).select("n", "body", F.posexplode(F.coalesce(*(F.when(g == k, _shingles(F.col("v"), k)) for k in sizes))).alias("at", "shingle")))
    rarity = _matches(docs, small(each.select("shingle").distinct()), sizes).groupBy("shingle").agg(F.count("*").alias("matches"))
    ranked = each.join(small(cut(rarity)), "shingle", "left").withColumn("r", F.row_number().over(Window.partitionBy("n", "body").orderBy(F.coalesce("matches", F.lit(0)), "at")))
    prefix = cut(ranked.where("r = 1 and matches > 0").select("n", "body", "at", "shingle"))
    start = F.col("place") - F.col("at")
    candidates = _matches(docs, small(prefix), sizes).where((start >= 0) & (start + F.col("n") <= F.col("len"))).select("doc_id", "key_", start.alias("start"), "n", "body")
    by_doc = cut(candidates.groupBy("doc_id", "key_").agg(F.collect_set(F.struct("start", "n", "body")).alias("c")).withColumnsRenamed({"doc_id": "id_", "key_": "k_"}))
    # Words travel only where a candidate may be.
    kept = marked(docs, by_doc.select(F.col("id_").alias("doc_id"))).select("doc_id", "key_", F.size("w").cast("long").alias("n_words"), F.when(F.col("marked"), F.col("w")).alias("w"))
    return kept.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")), "left").select(
        "doc_id", "key_", "n_words",
        F.filter(F.coalesce("c", none), lambda c: F.array_join(F.slice("w", c["start"] + 1, c["n"]), " ") == c["body"]).alias("c"),
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, key_, n_words, spans (start, n) of every occurrence of a window and items, the sorted ids of their items, for every document."""
    wins = cut(windows(benchmark, window))
    found = cut(occurrences(docs, wins))
    # Items by distinct windows, so a window that occurs often is looked up once.
    held = found.where(F.size("c") > 0).select("doc_id", "key_", F.explode(F.array_distinct(F.transform("c", lambda c: F.struct(c["n"].alias("n"), c["body"].alias("body"))))).alias("c")).select("doc_id", "key_", "c.*").distinct()
    items = held.join(small(wins), ["n", "body"]).select(F.col("doc_id").alias("id_"), F.col("key_").alias("k_"), "item").distinct().groupBy("id_", "k_").agg(F.array_sort(F.collect_list("item")).alias("items"))
    spans = F.array_distinct(F.transform("c", lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"))))
    return found.select("doc_id", "key_", "n_words", spans.alias("spans")).join(items, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")), "left").select("doc_id", "key_", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered(spans: Column) -> Column:
    """Words that spans (start, n) cover: each one, by its start, adds what lies beyond all before it."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, s: Column) -> Column:
        end = s["start"] + s["n"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["start"]))).cast("long").alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and key_ of every document.

    A document is contaminated if it has a hit and ``share`` times its hit words are as many as its words.
    """
    out = hits(docs, benchmark, window).select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), "items", "key_")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "key_")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, without a window of ``window`` words, wherever it is, and without contamination by shorter items.

    A single full window is enough for a document to go, whatever its length.  Items of fewer words (a name, a yes) may stand in any
    document, so they count only if ``share`` times the words that they cover are as many as the document's.
    """
    found = occurrences(docs, cut(windows(benchmark, window)))
    spans = F.array_distinct(F.transform("c", lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"))))
    leaks = F.exists("c", lambda c: c["n"] == window) | (share * covered(spans) >= F.col("n_words"))
    bad = cut(found.where(F.size("c") > 0).where(leaks).select(F.col("doc_id").alias("tidelog__id"), F.col("key_").alias("tidelog__key")).distinct())
    return docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col("tidelog__id")) & (row_key() == F.col("tidelog__key")), "left_anti")
