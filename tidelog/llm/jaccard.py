"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

1. Texts with the same words form a class; one text stands for it.
2. The forest has ``trees`` tries of signatures, each of up to ``depth`` MinHashes.  A trie's node at depth k holds the texts whose
   first k values agree, which happens with probability s**k at similarity s.  Every text starts with its longest prefix and shortens it
   until the trees together reach the target recall at the least similarity, not below the threshold, that a text with its number of
   shingles can have at all: a text of 7 shingles, say, cannot be 0.8 similar to another, only 6/7 or more.
   Two texts are candidates if a prefix that is short enough for one of them is common to both in some tree; what
   longer prefixes find is among them.  Texts too short to have any other text at the threshold need no prefix.
3. Candidates are kept as stars: every text is tied to the least text that needs its prefix, so a prefix with
   n texts gives n rows, not n * n.  Components of the stars are the candidate groups.
4. Each group is verified exactly.  Its texts' shingle sets are dealt into blocks of bounded
   size, each pair of blocks is a unit of work, and within it the sizes of all intersections come
   from products of incidence matrices.  A unit returns, for each text, how many others it is linked to,
   and a spanning forest of the links: rows in proportion to its texts, not to its pairs.
5. Components of the verified links are the groups of near duplicates.

So no group is gathered in one task: a group of n texts takes (n / block)**2 / 2 units, each of bounded memory.
Counting all links of a group whose texts differ is quadratic work in that group alone; copies do not count towards n.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a shingle is ``size`` words; a text of fewer words, but not none,
has one shingle.  Texts without words (null, empty, white space) form one class without links.  Shingles are told apart by
64 bits of hash.  Rows with one doc_id get a row each; identical texts always share a class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import components, cut, marked
from tidelog.llm.kernels import RADIX, U, Words, chunks, mix, trim

TREES, DEPTH, RECALL = 24, 8, 0.999
#: A block of a group: texts and shingles at most (a single text may have more).
BLOCK_TEXTS, BLOCK_SHINGLES = 400, 150_000


def prefix_length(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, from ``depth`` down, whose trees together reach the recall at a similarity."""
    for k in range(depth, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


#: Sets of more shingles can come so near the threshold that their prefixes are those of the threshold itself.
SIZES = 256


def least_similarity(n: int, threshold: float) -> float:
    """The least similarity, not below the threshold, of a set of n and another one; above 1 if there is no other one.

    i common ones of u in all: any i up to n and u from n on can be.
    """
    found = 2.0
    for u in range(n, int(n / threshold + 1e-9) + 1):
        i = int(np.ceil(threshold * u - 1e-9))
        if i <= n and not i == n == u:
            found = min(found, i / u)
    return found


def prefix_lengths(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> np.ndarray:
    """The prefix length of a text by its number of shingles, up to SIZES; 0 where no other text can be similar."""
    least = [least_similarity(n, threshold) for n in range(1, SIZES)]
    return np.array([0, *(prefix_length(min(x, 1.0), trees, depth, recall) if x <= 1 else 0 for x in least), prefix_length(threshold, trees, depth, recall)])


def shingles(texts: list[bytes], size: int):
    """(class hashes (2, n), bounds (n + 1), sorted distinct shingles of each text, in a row)."""
    words = Words(texts, lower=True)
    first, n_docs = words.first, len(texts)
    n = np.diff(first)
    runs, other = words.runs(0), words.runs(1)
    classes = np.stack([runs.at(first[:-1], n), other.at(first[:-1], n)]).view(np.int64)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(n_docs), count)
    start = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hashes = runs.at(start, np.minimum(n, size)[doc])
    order = np.lexsort((hashes, doc)) if len(hashes) else np.zeros(0, np.int64)
    hashes, doc = hashes[order], doc[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(hashes) else np.zeros(0, bool)
    hashes, doc = hashes[new], doc[new]
    return classes, np.searchsorted(doc, np.arange(n_docs + 1)), hashes


#: Bits of a value beyond the shortest prefix, and such values that a key can hold.
TAIL, TAILS = 15, 4


def _signatures(size: int, trees: int, lengths: np.ndarray):
    """For each text: its class, its number of shingles, the prefix length it needs, and for each tree its key at the shortest length and the values after it."""
    low, high = int(lengths[-1]), int(lengths.max())
    rng = np.random.default_rng(20)
    salts = rng.integers(1, 1 << 63, trees * high, dtype=np.uint64) * U(2) + U(1)
    adds = rng.integers(1, 1 << 63, trees * high, dtype=np.uint64)

    def sign(batches):
        for b in batches:
            ids = b.column(0)
            for begin, texts in chunks(b.column(1)):
                classes, bounds, hashes = shingles(texts, size)
                need = lengths[np.minimum(np.diff(bounds), len(lengths) - 1)]
                some = np.flatnonzero(np.diff(bounds))
                prefix, tail = np.zeros((len(texts), trees), U), np.zeros((len(texts), trees), U)
                for t in range(trees if len(some) else 0):
                    key, rest = np.full(len(some), t + 1, U), np.zeros(len(some), U)
                    for k in range(high):
                        x = hashes * salts[t * high + k] + adds[t * high + k]
                        least = np.minimum.reduceat(x ^ (x >> U(29)), bounds[some])
                        if k < low:
                            key = mix(key * U(RADIX[0]) + least)
                        else:
                            rest = rest << U(TAIL) | mix(least) >> U(64 - TAIL)
                    prefix[some, t], tail[some, t] = key, rest
                wants = need > 0
                bounds_out = pa.array(np.r_[0, np.cumsum(np.where(wants, trees, 0))].astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds_out, pa.array(x[wants].reshape(-1).view(np.int64))) for x in (prefix, tail)]
                yield pa.RecordBatch.from_arrays([ids.slice(begin, len(texts)), pa.array(classes[0]), pa.array(classes[1]), pa.array(np.diff(bounds)), pa.array(need.astype(np.int32)), *lists], ["doc_id", "c1", "c2", "n_shingles", "need", "prefixes", "tails"])
            trim()

    return sign


def stars(placed: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b): each text tied to the least one that needs a prefix which both have.

    placed: (node, need, tree, prefix, tail), need from low to high.  At depth k a node of the trie holds its texts that need k values or more: with
    a text that needs fewer they meet at that one's depth.
    """
    found = None
    for k in range(low, high + 1):
        by = ["tree", "prefix"] if k == low else ["tree", "prefix", "part"]
        held = placed.where(F.col("need") >= k).withColumn("part", F.shiftrightunsigned("tail", TAIL * (high - k)))
        hubs = held.groupBy(*by).agg(F.min(F.when(F.col("need") == k, F.col("node"))).alias("hub"), F.count("*").alias("n")).where("n > 1 and hub is not null").drop("n")
        tied = held.join(hubs, by).where("hub <> node").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        found = tied if found is None else found.union(tied)
    return found.distinct()


def _sets(size: int):
    def sets(batches):
        for b in batches:
            for begin, texts in chunks(b.column(0)):
                classes, bounds, hashes = shingles(texts, size)
                n = len(texts)
                out = pa.RecordBatch.from_arrays([*(c.slice(begin, n) for c in b.columns[3:]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["group", "node", "block", "blocks", "s"])
                # A row with the same doc_id but other words is not the class's text.
                yield out.filter(pa.array((b.column(1).slice(begin, n).to_numpy() == classes[0]) & (b.column(2).slice(begin, n).to_numpy() == classes[1])))

    return sets


def link(ids: list, sets: list[np.ndarray], blocks: np.ndarray, threshold: float, across: bool = False):
    """(links of each text, forest edges) among texts of one block, or only ``across`` two blocks."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    common = np.zeros((n, n), np.float32)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    col, row = col[shared], row[shared]
    everywhere = times == n  # in every text: counted without a matrix
    common += np.float32(everywhere.sum())
    rest = ~everywhere[col]
    col, row = col[rest], row[rest]
    if len(col):
        used, col = np.unique(col, return_inverse=True)
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        for c in range(0, len(used), 4096):
            i, j = np.searchsorted(col, (c, c + 4096))
            x = np.zeros((n, min(4096, len(used) - c)), np.float32)
            x[row[i:j], col[i:j] - c] = 1
            common += x @ x.T
    near = common >= np.float32(threshold) * (sizes[:, None] + sizes[None, :] - common) - np.float32(1e-3)
    # The few on the limit are decided in exact arithmetic.
    near &= (common.astype(np.float64) >= threshold * (sizes[:, None] + sizes[None, :] - common.astype(np.float64)) - 1e-9)
    np.fill_diagonal(near, False)
    if across:
        near &= blocks[:, None] != blocks[None, :]
    todo, edges = np.ones(n, bool), []
    for i in range(n):
        if todo[i]:
            todo[i], reach = False, [i]
            while reach:
                at = reach.pop()
                new = np.flatnonzero(near[at] & todo)
                todo[new] = False
                edges += [(ids[at], ids[j]) for j in new]
                reach += new.tolist()
    return near.sum(1), edges


def _verify(threshold: float):
    def verify(batches):
        unit, ids, sets, blocks = None, [], [], []

        def close():
            if len(ids) > 1 and unit is not None:
                counts, edges = link(ids, sets, np.array(blocks), threshold, unit[1] != unit[2])
                a, b, n = [i for i, c in zip(ids, counts.tolist(), strict=True) if c], [None] * int((counts > 0).sum()), [c for c in counts.tolist() if c]
                return [*a, *(e[0] for e in edges)], [*b, *(e[1] for e in edges)], [*n, *([0] * len(edges))]
            return [], [], []

        out: tuple[list, list, list] = ([], [], [])
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            s = b.column(5)
            for k in range(b.num_rows):
                key = (cols[0][k], cols[1][k], cols[2][k])
                if key == unit and ids and ids[-1] == cols[3][k]:
                    continue  # a repeated row
                if key != unit:
                    for x, y in zip(out, close(), strict=True):
                        x.extend(y)
                    unit, ids, sets, blocks = key, [], [], []
                ids.append(cols[3][k]), blocks.append(cols[4][k]), sets.append(s[k].values.to_numpy().view(U))
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "n"])
                out = ([], [], [])
        for x, y in zip(out, close(), strict=True):
            x.extend(y)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "n"])

    return verify


def join(docs: DataFrame, threshold: float = 0.8, size: int = 5, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, copy_id, class_id, n_copies and n_links of every document.

    copy_id: least doc_id with the same words; class_id: least doc_id of the group connected by links; n_copies:
    documents with the same words, this one too; n_links: other texts (copies not counted) at the threshold or more.
    Null doc_ids are least.
    """
    lengths = prefix_lengths(threshold, trees, recall=recall)
    low = int(lengths[-1])
    lengths = np.minimum(lengths, low + TAILS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = cut(docs.select("doc_id", "text").mapInArrow(_signatures(size, trees, lengths), f"doc_id {kind}, c1 long, c2 long, n_shingles long, need int, prefixes array<long>, tails array<long>"))
    # A node for each class: 64 bits of its 128, least place first.
    node = F.xxhash64("c1", "c2")
    classes = cut(signed.groupBy("c1", "c2").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("m"), F.count("*").alias("n_copies"), *(F.first(c).alias(c) for c in ("n_shingles", "need", "prefixes", "tails"))).select(node.alias("node"), "c1", "c2", F.col("m.doc_id").alias("copy_id"), "n_copies", "n_shingles", "need", "prefixes", "tails"))
    placed = classes.where("need > 0").select("node", "need", F.posexplode(F.arrays_zip("prefixes", "tails")).alias("tree", "x")).select("node", "need", "tree", F.col("x.prefixes").alias("prefix"), F.col("x.tails").alias("tail"))
    groups = components(stars(placed, low, int(lengths.max())))
    members = groups.join(classes.select("node", "c1", "c2", "copy_id", "n_shingles"), "node")
    total = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = cut(members.join(total, "root").select("root", "node", "c1", "c2", "copy_id", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("block"), "blocks"))
    # One text of each class: the first row with its copy_id and words.
    chosen = members.select("c1", "c2", "node", "root", "block", "blocks", F.col("copy_id").alias("id_"))
    near = marked(docs.select("doc_id", "text"), chosen.select(F.col("id_").alias("doc_id"))).where("marked").drop("marked")
    texts = near.join(chosen, F.col("doc_id").eqNullSafe(F.col("id_")), "inner")
    sets = texts.select("text", "c1", "c2", F.col("root").alias("group"), "node", "block", "blocks").mapInArrow(_sets(size), "group long, node long, block int, blocks int, s array<long>")
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    units = sets.select("group", F.explode(F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(other)).alias("u"), "node", "block", "s").select("group", F.col("u.i").alias("i"), F.col("u.j").alias("j"), "node", "block", "s")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(units.repartition(n, "group", "i", "j").sortWithinPartitions("group", "i", "j", "node").mapInArrow(_verify(threshold), "a long, b long, n long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n_links")).withColumnRenamed("a", "node")
    roots = components(found.where("b is not null").select("a", "b"))
    named = roots.join(classes.select("node", "copy_id"), "node")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNotNull().alias("some"), "copy_id")).alias("m")).select("root", F.col("m.copy_id").alias("class_id"))
    in_group = named.join(first, "root").select("node", "class_id", F.lit(True).alias("linked"))
    full = classes.join(in_group, "node", "left").join(links, "node", "left").select("c1", "c2", "copy_id", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("copy_id")).alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return signed.select("doc_id", "c1", "c2").join(full, ["c1", "c2"]).select("doc_id", "copy_id", "class_id", "n_copies", "n_links")


def dedup(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """One document of each group stays: that with the least doc_id; of rows repeated with that id, one.

    Rows with one doc_id and different words stay or go together.
    """
    found = cut(join(docs, threshold, size).select("doc_id", "class_id"))
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("tidelog__id")).distinct()
    kept = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("tidelog__id")), "left_semi")
    repeats = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeats else kept
