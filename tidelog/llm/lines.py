"""Line dedup: exact and fuzzy, in DataFrame operations only.

1. A line is normalised: lower case, white space collapsed and trimmed.  Equal normalised lines are one class.
2. A line's features are its distinct words; the runs of three characters of a line with fewer than ``WORDS`` of them; the pairs of neighbouring words of a line with more than
   ``MANY`` distinct ones, as long texts of one language have most of their words in common.  They are hashed and
   put in the order of their hashes, words of up to ``SHORT`` letters last, as they are common to lines that have nothing else in common.
3. Pigeonhole blocks: each run of ``RUN`` features among the first ``POSITIONS`` (of a long line ``LONG``) in that order is a key; in lines with ``ENOUGH``
   longer words, one of them may be short.  If d of these places of two
   lines differ, the others make up d + 1 runs at most, so some run is long enough for a common key wherever more than (RUN - 1) * (d + 1) agree:
   always for up to 3 of 14.  Beyond that it is a matter of chance; README gives measured recall.
   Keys of 64 bits keep buckets apart whatever the number of lines.
4. A 64-bit odd sketch of the first ``SKETCHED`` features (each flips a bit) tells by its bits that differ how many features differ.  Of a bucket, each class is
   first held against the least one; after that only pairs that are not connected yet are made.  So a hot
   group of n variants that are like the least one gives rows in proportion to n.  Of the pairs between two groups that are not connected, the
   most alike one is compared first, and the others only if that leaves the groups apart.  Connectivity is that of all candidates.
5. Pairs are verified by edit similarity of the normalised lines: 1 - distance / longer length, in characters.  Bounds that are never below the distance
   come first, where they take less time than it: long lines are held against each other in pieces of up to ``PIECE`` characters (very long ones once more, of ``SMALL``); pairs of words that both lines have once are
   anchors, and where they come in one order the sum of distances between them is nearly always enough.  Pairs that are not connected by
   the least classes seldom are similar, so of these only long ones are bounded: a bound that does not accept is time lost.
6. Of each connected group of classes the first occurrence stays, by doc_id, then line number.

SimHashes joined on blocks of equal bits do not serve here: lines at the similarity differ in too many bits (figures in README).  The order of
hashes and the odd sketch take their place; no line is too short or too long.  Pairs found are exact.  Blank lines always stay.

Null and empty texts have no lines.  Null doc_ids come first; rows with one doc_id and different texts are ordered by a hash of
the text; identical rows count as one document and get the same result.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import components, cut, marked, row_key

SIMILARITY = 0.8
POSITIONS, LONG, RUN, SKETCHED = 14, 40, 3, 32
#: Words of so many letters at most come last in the order; they bear this bit, above the 60 of the others.
SHORT, MARK, WORDS, MANY = 4, 1 << 60, 6, 512
#: Longer words that make runs of short ones needless as keys.
ENOUGH = 8
#: Bits of two sketches that differ at most, by the kind of features: of all 64, and for each feature of a line that has fewer.  One edit changes one or two words, two or
#: three pairs of words, and three runs of characters, but lines of one language share many of these.
BITS = {"words": (16, 0.55), "runs": (11, 0.33), "pairs": (21, 1.0)}


def normalised(rows: DataFrame, line: str = "line", name: str = "norm") -> DataFrame:
    """``rows`` with the normalised ``line`` in its place, in steps that are columns, so that none is evaluated twice."""
    low = F.col("low_")
    other = low.contains("\t") | low.contains("\r") | low.contains("\x0b") | low.contains("\f")
    rows = rows.withColumn("low_", F.lower(line)).drop(line)
    rows = rows.withColumn("spaced_", F.when(other, F.translate(low, "\t\x0b\f\r", "    ")).otherwise(low)).drop("low_")
    return rows.withColumn(name, F.trim(F.when(F.col("spaced_").contains("  "), F.regexp_replace("spaced_", " {2,}", " ")).otherwise(F.col("spaced_")))).drop("spaced_")


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("bigint")


#: Characters between anchors at most; where there are more, the bounded distance of the whole lines takes less time.
GAP = 2000
#: Characters up to which the distance itself takes less time than its bounds.
BRIEF = 128
#: Characters of a piece at most; and where lines of more than ``HUGE`` characters are tried again, as shorter pieces accept more and take longer.
PIECE, SMALL, HUGE = 8, 4, 8192


def _once(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f uses it: columns of a frame are copied into the filters above them."""
    return F.transform(F.array(value), f)[0]


def features(rows: DataFrame, norm: str = "norm") -> DataFrame:
    """``rows`` with f, the hashes of a line's features in their order, and kind, in the line's place."""
    low = lambda h: h.bitwiseAND(_long(MARK - 1))
    word = lambda w: low(F.xxhash64(w)).bitwiseOR(F.when(F.length(w) <= SHORT, _long(MARK)).otherwise(_long(0)))
    words = F.sort_array(F.array_distinct(F.transform(F.split(norm, " "), word)))
    text = F.col(norm)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: low(F.xxhash64(F.substr(text, i, F.lit(3)))))
    pairs = _once(F.split(norm, " "), lambda ws: F.transform(ws, lambda w, i: low(F.xxhash64(w, F.get(ws, i + 1)))))
    rows = rows.withColumn("words_", words)
    kind = F.when(F.size("words_") < WORDS, "runs").when(F.size("words_") > MANY, "pairs").otherwise("words")
    ordered = lambda x: F.sort_array(F.array_distinct(x))
    return rows.withColumn("kind", kind).withColumn("f", F.when(F.col("kind") == "words", F.col("words_")).when(F.col("kind") == "runs", ordered(runs)).otherwise(ordered(pairs))).drop("words_", norm)


def keys(ordered: Column, kind: Column) -> Column:
    """The keys of a line, from its features in order: a hash of each run."""
    at = lambda i: F.get(ordered, F.lit(i))
    key = lambda i: F.xxhash64(*(at(i + j) for j in range(RUN)))
    all_ = at(POSITIONS - 1).isNull() | (at(ENOUGH - 1) >= _long(MARK))
    runs = (F.when(at(i + RUN - 1).isNotNull() & ((at(i + RUN - 2) < _long(MARK)) | all_), key(i)) for i in range(POSITIONS - RUN + 1))
    return F.array_compact(F.when(kind == "pairs", F.array(*(key(i) for i in range(LONG - RUN + 1)))).otherwise(F.array(*runs)))


def bits(n: Column, kind: Column) -> Column:
    """Bits of a sketch of n features that may differ."""
    most = {k: F.least(F.lit(whole), share * n + 1).cast("int") for k, (whole, share) in BITS.items()}
    return F.when(kind == "words", most["words"]).when(kind == "runs", most["runs"]).otherwise(most["pairs"])


def sketch(ordered: Column) -> Column:
    """The odd sketch of the first features."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(F.slice(ordered, 1, SKETCHED), _long(0), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", one, w.bitwiseAND(_long(63)).cast("int"))))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key_, no, norm, h1, h2) of every line that is not blank."""
    # The outer form, as the other one adds a filter that splits the text again; a text has one line at least.
    split = docs.where("text is not null").select("doc_id", row_key().alias("key_"), F.split("text", "\n", -1).alias("all_"))
    each = split.select("doc_id", "key_", F.posexplode_outer("all_").alias("no", "line")).where(F.trim("line", F.lit(" \t\x0b\f\r")) != "")
    norm = normalised(each)
    return norm.select("*", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"))


def index(docs: DataFrame) -> DataFrame:
    """A slim row for each line, written once: (doc_id, key_, no, h1, h2, size, most, sketch, keys); most is the number of its sketch's bits that may differ."""
    slim = features(lines(docs).select("doc_id", "key_", "no", "h1", "h2", F.length("norm").alias("size"), "norm"))
    return cut(slim.select("doc_id", "key_", "no", "h1", "h2", "size", bits(F.least(F.size("f"), F.lit(SKETCHED)), F.col("kind")).alias("most"), sketch(F.col("f")).alias("sketch"), keys(F.col("f"), F.col("kind")).alias("keys")))


def classes(all_lines: DataFrame) -> DataFrame:
    """(node, h1, h2, first, copies) of each class of equal lines."""
    first = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "key_", "no")
    return all_lines.groupBy("h1", "h2").agg(F.min(first).alias("first"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("h1", "h2"))


def _near(a: str, b: str, similarity: float) -> Column:
    """Sketches that allow enough common features, and lengths that allow the similarity.  a, b: structs (size, most, sketch)."""
    a, b = F.col(a), F.col(b)
    return (F.bit_count(a["sketch"].bitwiseXOR(b["sketch"])) <= F.least(a["most"], b["most"])) & (F.least(a["size"], b["size"]) >= similarity * F.greatest(a["size"], b["size"]) - 1e-9)


def buckets(all_lines: DataFrame) -> DataFrame:
    """(k, leader, node, s): the classes of each key that several classes have, with its least class; s has size, most and sketch.

    A first pass finds such keys, combining before its shuffle, so a common line is a row for each task; only their rows are then shuffled.
    """
    placed = all_lines.select(F.xxhash64("h1", "h2").alias("node"), F.struct("size", "most", "sketch").alias("s"), F.explode("keys").alias("k"))
    shared = cut(placed.groupBy("k").agg(F.min("node").alias("leader"), F.max("node").alias("other")).where("leader <> other").select("k", "leader"))
    held = marked(placed.select("node", "s.size", "s.most", "s.sketch", "k"), shared, "k").where("marked").join(shared, "k")
    return cut(held.groupBy("k", "leader", "node", "size", "most", "sketch").agg(F.lit(1).alias("x")).select("k", "leader", "node", F.struct("size", "most", "sketch").alias("s")))


def texts_of(docs: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, norm) of classes, from the text of each class's first line."""
    firsts = cut(found.join(nodes, "node", "left_semi").select("node", F.col("first.doc_id").alias("id_"), F.col("first.key_").alias("k_"), F.col("first.no").alias("no_")))
    by_doc = firsts.groupBy("id_", "k_").agg(F.collect_list(F.struct("no_", "node")).alias("want"))
    near = marked(docs.where("text is not null").select("doc_id", row_key().alias("key_"), "text"), firsts.select(F.col("id_").alias("doc_id"))).where("marked")
    held = near.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_"))).select("want", F.split("text", "\n", -1).alias("all_"))
    held = held.select(F.transform("want", lambda x: F.struct(x["node"].alias("node"), F.get("all_", x["no_"]).alias("line"))).alias("want"))
    return cut(normalised(held.select(F.inline("want"))).select("node", "norm").dropDuplicates(["node"]))


def _apart(p: Column, anchor, anchors, between) -> Column:
    """The sum of distances between the anchors of a pair, or null if they come in different orders.

    p: struct of words wa and wb, of ta and tb, what each word is looked up by, and of o, by which ``anchor`` tells an anchor and ``anchors`` finds all of a
    line.  ``between``: distance of two texts.
    """
    # What lies between anchors, as texts.  A line never holds the mark, which is white space.
    marked_ = lambda w, t: F.transform(w, lambda x, i: F.when(anchor(p, F.get(t, i)), F.lit("\n")).otherwise(x))
    texts = lambda w, t: F.split(F.array_join(marked_(w, t), " "), " ?\n ?")
    # Where one text is empty and the other is not, there is a space more, too.
    one = lambda x, y: F.when(x == y, 0).otherwise(between(x, y) + ((x == "") != (y == "")).cast("int"))
    each = F.zip_with(texts(p["wa"], p["ta"]), texts(p["wb"], p["tb"]), one)
    return F.when(anchors(p, p["ta"]) == anchors(p, p["tb"]), F.aggregate(each, F.lit(0), lambda acc, x: acc + x))


def _repeated(words: Column) -> Column:
    """The words that occur more than once."""
    return _once(F.sort_array(words), lambda w: F.array_distinct(F.filter(w, lambda x, i: x.eqNullSafe(F.get(w, i + 1)))))


def _in_pieces(p: Column, piece_size: int = PIECE) -> Column:
    """Whether the pieces of two lines differ so little that the distance cannot exceed the limit; null if the pieces have too many kinds.

    p: struct of lines na and nb and of the limit.  A line is the sum of its pieces, so each that is changed, put in or left out costs ``piece_size`` at most.
    """
    pieces = lambda line: F.regexp_extract_all(line, F.lit(f"[^ ]{{1,{piece_size - 1}}} ?| "), F.lit(0))
    cut_up = lambda q: F.struct(q["pa"].alias("pa"), q["pb"].alias("pb"), F.array_distinct(F.concat(q["pa"], q["pb"])).alias("kinds"))
    # A character for each kind of piece, below the surrogates.
    coded = lambda q, x: F.decode(F.unhex(F.array_join(F.transform(x, lambda piece: F.lpad(F.hex(F.array_position(q["kinds"], piece)), 4, "0")), "")), "UTF-16BE")
    most = F.floor(p["limit"] / piece_size).cast("int")
    near = lambda q: F.when(F.size(q["kinds"]) < 0xD800, F.call_function("levenshtein", coded(q, q["pa"]), coded(q, q["pb"]), most) >= 0)
    return _once(F.struct(pieces(p["na"]).alias("pa"), pieces(p["nb"]).alias("pb")), lambda q: _once(cut_up(q), near))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, alike: bool = True) -> DataFrame:
    """The pairs (a, b) whose edit similarity over characters reaches the threshold.  ``alike``: most are expected to; the same pairs result either way."""
    ta, tb = texts.select(F.col("node").alias("a"), F.col("norm").alias("na")), texts.select(F.col("node").alias("b"), F.col("norm").alias("nb"))
    size = F.greatest(F.length("na"), F.length("nb"))
    limit = F.floor((1 - similarity) * size + 1e-9).cast("int")
    words = F.struct(F.split("na", " ").alias("wa"), F.split("nb", " ").alias("wb"))
    # Anchors are some of the pairs of neighbouring words that each line has once: more would take longer to look up, fewer leave long texts between.
    near = lambda x, y: F.when(F.greatest(F.length(x), F.length(y)) <= GAP, F.levenshtein(x, y))
    pairs_of = lambda w: F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    paired = lambda p: F.struct(p["wa"].alias("wa"), p["wb"].alias("wb"), pairs_of(p["wa"]).alias("ta"), pairs_of(p["wb"]).alias("tb"))
    once = lambda p: F.array_except(F.array_intersect(p["ta"], p["tb"]), F.array_union(_repeated(p["ta"]), _repeated(p["tb"])))
    spread = lambda u: F.filter(u, lambda x, i: i % F.ceil(F.sqrt(F.size(u)) / 4) == 0)
    single = lambda p: F.struct(*(p[c].alias(c) for c in ("wa", "wb", "ta", "tb")), _once(once(p), spread).alias("o"))
    by_pair = lambda q: _apart(q, lambda p, x: F.array_contains(p["o"], x), lambda p, line: F.array_intersect(line, p["o"]), near)
    anchored = F.coalesce(_once(words, lambda w: _once(paired(w), lambda p: _once(single(p), by_pair))) <= limit, F.lit(False))
    pieces = lambda n: F.coalesce(_once(F.struct("na", "nb", limit.alias("limit")), lambda p: _in_pieces(p, n)), F.lit(False))
    exact = F.call_function("levenshtein", "na", "nb", limit).between(F.lit(0), limit)
    accepted = F.when((size > GAP) & pieces(PIECE), True).when((size > (BRIEF if alike else GAP)) & anchored, True).when((size > HUGE) & pieces(SMALL), True).otherwise(exact)
    # Texts take little room and long to compare, so tasks follow the number of partitions, not bytes.  A condition that names the task is not moved below the exchange.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.join(ta, "a").join(tb, "b").repartition(tasks, "a", "b").where(F.when(F.spark_partition_id() >= 0, accepted)).select("a", "b")


def groups(docs: DataFrame, all_lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(h1, h2, first) of each class of equal lines with copies or links: the first occurrence in its group."""
    found = cut(classes(all_lines))
    shared = buckets(all_lines)
    own = cut(shared.select(F.col("node").alias("leader"), F.col("s").alias("sl")).distinct())
    # First every class against the leader of its bucket: as many pairs as classes.
    stars = cut(shared.where("node <> leader").join(own, "leader").where(_near("s", "sl", similarity)).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    # Then the pairs of a bucket that are not connected yet; a group that the stars connect gives none.
    near = cut(verified(stars, texts_of(docs, found, _ends(stars)), similarity))
    roots = components(near)
    rest = cut(shared.join(roots, "node", "left").select("k", "node", "s", F.coalesce("root", "node").alias("c")))
    b = rest.select(F.col("k").alias("k2"), F.col("node").alias("n2"), F.col("s").alias("s2"), F.col("c").alias("c2"))
    alike = rest.join(b, (F.col("k") == F.col("k2")) & (F.col("node") < F.col("n2")) & (F.col("c") != F.col("c2")) & _near("s", "s2", similarity))
    far = F.bit_count(F.col("s.sketch").bitwiseXOR(F.col("s2.sketch")))
    cross = cut(alike.select(F.col("node").alias("a"), F.col("n2").alias("b"), F.least("c", "c2").alias("c"), F.greatest("c", "c2").alias("c2"), far.alias("far")).distinct().join(stars, ["a", "b"], "left_anti"))
    texts = texts_of(docs, found, _ends(cross))
    # Of all pairs of two groups the most alike one comes first: most groups that are connected at all are so by it, and need none of the others.
    best = cut(cross.groupBy("c", "c2").agg(F.min(F.struct("far", "a", "b")).alias("x")).select("x.a", "x.b", "c", "c2"))
    links = cut(best.join(verified(best.select("a", "b"), texts, similarity, alike=False), ["a", "b"]).select("c", "c2"))
    others = cut(_apart_still(cross.join(best, ["a", "b"], "left_anti"), components(links, "c", "c2")).select("a", "b", "c", "c2"))
    more = others.join(verified(others.select("a", "b"), texts, similarity, alike=False), ["a", "b"]).select("c", "c2").distinct()
    # Groups that are connected, as a table of groups: the links within them are not needed again.
    joined = components(links.union(more), "c", "c2").withColumnsRenamed({"node": "c", "root": "whole"})
    grouped = found.join(roots, "node", "left").withColumn("c", F.coalesce("root", "node")).join(joined, "c", "left")
    named = grouped.where("root is not null or whole is not null or copies > 1").select(F.coalesce("whole", "c").alias("root"), "h1", "h2", "first")
    kept = named.groupBy("root").agg(F.min("first").alias("first"))
    return named.select("root", "h1", "h2").join(kept, "root").select("h1", "h2", "first")


def _apart_still(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows whose groups c and c2 are not connected by ``roots``, which has only groups with links."""
    one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(r)) for c, r in (("c", "r"), ("c2", "r2")))
    return pairs.join(one, "c", "left").join(two, "c2", "left").where(F.coalesce("r", "c") != F.coalesce("r2", "c2")).drop("r", "r2")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, kept (the text without the removed lines) and kept_sha256 of each document."""
    all_lines = index(docs)
    first = groups(docs, all_lines, similarity)
    placed = all_lines.select("doc_id", "key_", "no", "h1", "h2").join(first, ["h1", "h2"])
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key_") == F.col("first.key_")) & (F.col("no") == F.col("first.no"))
    by_doc = placed.where(~stays).groupBy("doc_id", "key_").agg(F.collect_set("no").alias("gone")).withColumnsRenamed({"doc_id": "id_", "key_": "k_"})
    base = docs.select("doc_id", row_key().alias("key_"), F.coalesce("text", F.lit("")).alias("text"))
    joined = base.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")), "left").select("doc_id", "text", F.split("text", "\n", -1).alias("all_"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("all_") - 1), F.col("gone")), lambda i: F.get("all_", i)), "\n"))
    some = F.size(F.filter("all_", lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "")).cast("long")
    out = joined.select("doc_id", some.alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), kept.alias("kept"))
    return out.select("*", F.sha2("kept", 256).alias("kept_sha256"))
