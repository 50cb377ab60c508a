"""Substring dedup by relative Lempel-Ziv parsing against every reference block.

All texts are cut into reference blocks at places that depend on the words alone: the windows
of ``length`` words that share one minimizer (the run of ``gram`` words with the least hash)
make up a block.  Equal passages are therefore cut into equal blocks wherever they start.

* The index holds each distinct block once, at its first place.  A block that is found there at an earlier place is a piece
  of a factor, with its reference: the document and word where it is a copy of.
* At the boundaries of factors, where a passage begins or ends within a block, the block is new
  but its minimizer is not.  The windows of such blocks are looked up one by one, so a factor grows window by window there.
* :func:`parse` then goes through a document from the left and extends each factor greedily, by the next piece, as long as that
  continues the document and the reference alike; otherwise the next factor begins.  A factor has ``length`` words at least.

A window that starts earlier (smaller doc_id, or same document and earlier start) is a duplicate and
the words it covers go; windows are judged on the input, so the words that go are those of all factors.  Blocks and windows are
told apart by 128 bits of hash.

No pairs are made: a block or window is a row, held against the first of its equals.  Equal blocks of about ``HELD`` blocks at a time are
combined before the shuffle, where they stand: all but the first are known to be copies and are dealt out at random.  So a passage that a
third of all documents hold meets in one task with a row for each some thousand copies.  The reference of a
piece is one earlier place; which one may depend on how the table is partitioned, but the words that go do not.

Null and empty texts have no words.  Null doc_ids come first.  Rows with one doc_id and different
texts are ordered by a checksum of the text; identical rows count as one document (not as copies of each other) and get the
same result.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import cut
from tidelog.llm.kernels import Words, chunks, mix

#: Words of a minimizer.
GRAM = 6
#: A place: 28 bits of the text's checksum, 31 bits of the first word, 4 bits of the number of windows less one.
START, COUNT = 31, 4
#: Blocks that are combined before the shuffle at a time.
HELD = 1 << 18


def _sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least value among v[i], ..., v[i + w - 1], for each i that has all."""
    best, pos, n = v, np.arange(len(v)), 1
    while n < w:
        s = min(n, w - n)
        left, right = best[:-s] if s else best, best[s:]
        k = right < left
        pos = np.where(k, pos[s:], pos[:-s])
        best = np.where(k, right, left)
        n += s
    return pos


def _tag(text: bytes) -> int:
    return zlib.crc32(text) >> 4


def blocks_of(texts: list[bytes], length: int, gram: int):
    """(text's index, minimizer, hash, place) of every block of a chunk of texts."""
    words = Words(texts)
    n = len(words.hash)
    if n < length:
        return None
    runs, other = words.runs(0), words.runs(1)
    grams = runs.at(np.arange(n - gram + 1), gram)
    at = _sliding_argmin(grams, length - gram + 1)
    start = np.arange(len(at))
    doc = words.doc[: len(at)]
    valid = start + length <= words.first[doc + 1]
    start, at, doc = start[valid], at[valid], doc[valid]
    if not len(start):
        return None
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    count = np.diff(np.r_[new, len(start)])
    first, doc = start[new], doc[new]
    full = other.at(first, count + length - 1)
    tags = np.array([_tag(t) for t in texts], np.int64)
    place = (tags[doc] << START | first - words.first[doc]) << COUNT | count - 1
    return doc, grams[at[new]].view(np.int64), full.view(np.int64), place


class _Combiner:
    """Gathers rows of blocks or windows, and combines equal ones."""

    def __init__(self):
        self.rows, self.n = [], 0

    def add(self, ids: pa.Array, mini: np.ndarray, full: np.ndarray, place: np.ndarray):
        self.rows.append((ids, mini, full, place))
        self.n += len(mini)

    def take(self) -> pa.RecordBatch:
        """All rows so far.  Of equal ones, all but the first have it as their reference, and a key of their own."""
        ids = pa.concat_arrays([r[0] for r in self.rows])
        mini, full, place = (np.concatenate([r[k] for r in self.rows]) for k in (1, 2, 3))
        self.rows, self.n = [], 0
        doc = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((place, doc, full))
        m, f, d, p = mini[order], full[order], doc[order], place[order]
        new = np.r_[True, (f[1:] != f[:-1]) | (m[1:] != m[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        known = (d != d[first]) | (p != p[first])
        key = np.where(known, mix((p ^ f ^ (d << 20)).view(np.uint64)).view(np.int64), m)
        refs = pa.array(np.where(known, order[first], 0), mask=~known)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(f), ids.take(pa.array(order)), pa.array(p), ids.take(refs), pa.array(p[first], mask=~known)], ["key", "full", "doc_id", "place", "ref_id", "ref_place"])


def _emit(length: int, gram: int):
    def blocks(batches):
        held = _Combiner()
        for b in batches:
            keys = b.column(0)
            for begin, texts in chunks(b.column(1)):
                got = blocks_of(texts, length, gram)
                if got is not None:
                    doc, mini, full, place = got
                    held.add(keys.take(pa.array(doc + begin)), mini, full, place)
                    if held.n >= HELD:
                        yield held.take()
        if held.n:
            yield held.take()

    return blocks


def _windows(length: int):
    def windows(batches):
        """Of the blocks to check: a row for each window."""
        held = _Combiner()
        for b in batches:
            keys, spans = b.column(0), b.column(2).to_pylist()
            for begin, texts in chunks(b.column(1)):
                words = Words(texts)
                runs, other = words.runs(0), words.runs(1)
                starts, docs, places = [], [], []
                for k, t in enumerate(texts):
                    p = np.array(spans[begin + k], np.int64)
                    p = p[p >> START + COUNT == _tag(t)]
                    count = (p & (1 << COUNT) - 1) + 1
                    s = np.repeat(p >> COUNT & (1 << START) - 1, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    starts.append(s + words.first[k]), docs.append(np.full(len(s), begin + k)), places.append((_tag(t) << START | s) << COUNT)
                s, d, p = np.concatenate(starts), np.concatenate(docs), np.concatenate(places)
                if len(s):
                    held.add(keys.take(pa.array(d)), runs.at(s, length).view(np.int64), other.at(s, length).view(np.int64), p)
                if held.n >= HELD:
                    yield held.take()
        if held.n:
            yield held.take()

    return windows


def _referred(rows: DataFrame) -> DataFrame:
    """``rows`` with earlier, and the reference of those that are: the first of their equals, unless they have one already."""
    order = Window.partitionBy("key", "full").orderBy("doc_id", "place")
    known = F.col("ref_place").isNotNull()
    first = rows.withColumn("first_", F.first(F.struct("doc_id", "place")).over(order)).withColumn("leads_", (F.row_number().over(order) == 1) & ~known)
    earlier = known | ~(F.col("doc_id").eqNullSafe(F.col("first_.doc_id")) & (F.col("place") == F.col("first_.place")))
    return first.withColumn("earlier", earlier).withColumn("ref_id", F.when(known, F.col("ref_id")).otherwise(F.col("first_.doc_id"))).withColumn("ref_place", F.coalesce("ref_place", "first_.place")).drop("first_")


def pieces(docs: DataFrame, length: int = 20, gram: int = GRAM) -> DataFrame:
    """(doc_id, place, ref_id, ref_place) of the blocks and windows that start earlier elsewhere; a place packs tag, first word and windows."""
    if not 0 < length - gram + 1 <= 1 << COUNT:
        raise ValueError("length - gram must be from 0 to 15")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key long, full long, doc_id {kind}, place long, ref_id {kind}, ref_place long"
    found = ["doc_id", "place", "ref_id", "ref_place"]
    texts = docs.select("doc_id", "text")
    blocks = texts.mapInArrow(_emit(length, gram), schema)
    # One exchange by minimizer serves both: equal blocks have equal minimizers.
    meeting = _referred(blocks.repartition("key")).withColumn("kinds", F.sum(F.col("leads_").cast("long")).over(Window.partitionBy("key")))
    marked = cut(meeting.where("earlier or kinds > 1").select(*found, "earlier"))
    checks = marked.where("not earlier").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    again = texts.join(checks.withColumnRenamed("doc_id", "id_"), F.col("doc_id").eqNullSafe(F.col("id_")), "inner").select("doc_id", "text", "places").dropDuplicates(["doc_id", "text"])
    windows = again.mapInArrow(_windows(length), schema)
    return marked.where("earlier").select(*found).union(_referred(windows).where("earlier").select(*found))


def parse(doc: np.ndarray, place: np.ndarray, ref: np.ndarray, ref_place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of documents, by document and place: (index of the piece that each begins with, words).

    A piece is a run of windows: in document doc (any number) at place, copied from document ref (any number) at ref_place.  A factor
    takes the next piece if it begins with the next window both here and in the reference.
    """
    order = np.lexsort((place, doc))
    if len(order):  # a repeated row's pieces once
        order = order[np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(place[order]) != 0)]]
    doc, place, ref, ref_place = doc[order], place[order], ref[order], ref_place[order]
    begin, there, count = place >> COUNT, ref_place >> COUNT, (place & (1 << COUNT) - 1) + 1  # places with the text's tag above
    goes_on = (doc[1:] == doc[:-1]) & (ref[1:] == ref[:-1]) & (begin[1:] == begin[:-1] + count[:-1]) & (there[1:] == there[:-1] + count[:-1])
    new = np.flatnonzero(np.r_[True, ~goes_on]) if len(order) else order
    windows = np.add.reduceat(count, new) if len(order) else count
    return order[new], windows + length - 1


#: Texts that are parsed and cut at a time.
TEXTS = 512
FACTORS = "array<struct<start:int,n:int,ref_id:{},ref_start:int>>"


def dedup(docs: DataFrame, length: int = 20, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document.

    With ``keep_text`` also the kept text and the factors: (start, n, ref_id, ref_start), in words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = pieces(docs, length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("place", "ref_id", "ref_place")).alias("pieces"))
    joined = docs.select("doc_id", "text").join(spans.withColumnRenamed("doc_id", "id_"), F.col("doc_id").eqNullSafe(F.col("id_")), "left").select("doc_id", "text", "pieces")

    def remove(batches):
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for b in (whole.slice(k, TEXTS) for whole in batches for k in range(0, whole.num_rows, TEXTS)):
            texts, lists = b.column(1).to_pylist(), b.column(2)
            held = lists.flatten()
            of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            tags = np.fromiter((_tag((t or "").encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
            mine = np.flatnonzero(held.field(0).to_numpy() >> START + COUNT == tags[of])  # not of another text with this id
            held, of = held.take(pa.array(mine)), of[mine]
            place, ref_ids, ref_place = held.field(0).to_numpy(), held.field(1), held.field(2).to_numpy()
            ref = pc.rank(ref_ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            at, n = parse(of, place, ref, ref_place, length)
            first, there = (x[at] >> COUNT & (1 << START) - 1 for x in (place, ref_place))
            bound = np.searchsorted(of[at], np.arange(len(texts) + 1))
            out = []
            for i, text in enumerate(texts):
                words = word.findall(text or "")
                total, f, m = len(words), first[bound[i] : bound[i + 1]], n[bound[i] : bound[i + 1]]
                if len(f):
                    step = np.zeros(total + 1, np.int64)
                    np.add.at(step, f, 1)
                    np.add.at(step, f + m, -1)
                    words = [w for w, inside in zip(words, np.cumsum(step).tolist(), strict=False) if not inside]
                kept = " ".join(words)
                out.append((total, total - len(words), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept))
            total, gone, sha, kept = list(zip(*out, strict=True)) or [[]] * 4
            arrays, names = [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                factors = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(n, pa.int32()), ref_ids.take(pa.array(at)), pa.array(there, pa.int32())], ["start", "n", "ref_id", "ref_start"])
                arrays, names = [*arrays, pa.array(kept, pa.string()), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), factors)], [*names, "kept", "factors"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + f", kept string, factors {FACTORS.format(kind)}" * keep_text)
