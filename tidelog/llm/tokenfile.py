"""Token-id files: documents as ids, coded by the range coder, in ascending doc_id order.

A file set is a folder of Parquet files.  Each row is a frame of whole documents: (part, frame,
n_ids, doc_ids, n_tokens, payload), where the payload is a stream of :mod:`rangecoder`.  Parts are ranges of
doc_id, in order.  Writing goes through Spark's commit protocol, so a lost executor's tasks run
again and leave no half-written file; reading needs nothing but the folder.

A null text is empty: its document has the end id alone.  doc_id may have any type that sorts; null ones come first.  Rows
with one doc_id are ordered by text; extra columns are ignored; an empty table gives an empty
file set.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm import rangecoder
from tidelog.llm.common import scratch
from tidelog.llm.kernels import trim

#: Ids of a frame, about; and of the frames coded in lockstep: a step of numpy takes hardly longer for more blocks, but each has a model.
FRAME, TOGETHER = 1 << 20, 3 << 20
#: Words of a generation; a Python worker keeps the ids of two.
CACHE = 150_000
#: Words encoded anew after which the memory freed since is given back; the library leaves about as much as the words kept take.
FRESH = 20_000
#: Code points of a part, about.
PART = 1 << 28


class Encoder:
    """The tokenizers library, with the ids of frequent words kept.

    A text is cut at spaces and line feeds only, which the tokenizer drops; each piece goes through the
    library unchanged.  That is valid for tokenizers which treat white space as a word
    boundary and drop it.  ASCII letters with a full stop or comma after them are two pieces for a tokenizer that parts letters from marks.  Both are
    checked against the library when loading, over words of the vocabulary itself; texts go through the library whole if the first does not hold.
    """

    def __init__(self, path: str, end_id: int):
        self.path, self.end_id, self.tok, self.fresh = path, end_id, None, 0

    def __getstate__(self):
        return self.path, self.end_id

    def __setstate__(self, s):
        self.__init__(*s)

    def load(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.cache, self.old = Tokenizer.from_file(self.path), {}, {}
        self.pieces = self.marks = True
        letters = [w for w in (v.removesuffix("</w>") for v in sorted(self.tok.get_vocab())[::20]) if w.isascii() and w.isalpha()]
        probes = ["Ab c\ndé, f's 'll x", " ".join(letters), "\n".join(w + ".," for w in letters[::7])]
        for probe in probes:
            words = probe.split()
            self.pieces &= self.tok.encode(probe, add_special_tokens=False).ids == np.frombuffer(b"".join(self._encode(words)), np.uint32).tolist()
        stop, comma = self._encode([".", ","])
        ids = self._encode(letters)
        for mark, end in ((".", stop), (",", comma)):
            self.marks &= self._encode([w + mark for w in letters]) == [i + end for i in ids]
        trim()

    def __call__(self, texts: list) -> list[np.ndarray]:
        if self.tok is None:
            self.load()
        if not self.pieces:
            return [np.array([*e.ids, self.end_id], np.uint32) for e in self.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.cache) > CACHE:  # words of the generation before move over when they occur again
            self.cache, self.old = {}, self.cache
        known, old = self.cache, self.old
        new = [w for w in set().union(*split) if w not in known] if split else []
        known.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in known]
        fresh = {}
        for w in new:  # letters and one mark are two pieces for any such tokenizer, so fewer words go through the library
            if self.marks and w[-1:] in (".", ",") and w[:-1].isascii() and w[:-1].isalpha():
                fresh[w] = w[:-1]
        ask = list({w for w in new if w not in fresh} | {w for w in (*fresh.values(), ".", ",") if w not in known})
        known.update(zip(ask, self._encode(ask), strict=True))
        self.fresh += len(ask)
        if self.fresh > FRESH:
            self.fresh = 0
            trim()
        for w, head in fresh.items():
            known[w] = known[head] + known[w[-1]]
        find = known.__getitem__
        end = np.array([self.end_id], np.uint32).tobytes()
        return [np.frombuffer(b"".join(map(find, words)) + end, np.uint32) for words in split]

    def _encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word: many words at once, told apart by the places of their ids."""
        out = []
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            lens = np.fromiter(map(len, part), np.int64, len(part)) + 1
            at = np.searchsorted(np.fromiter((o[0] for o in e.offsets), np.int64, len(ids)), np.concatenate([[0], np.cumsum(lens)]))
            raw, at = ids.tobytes(), (4 * at).tolist()
            out += [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
        return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None) -> None:
    """Write ``docs`` as token ids to ``path``."""
    encoder = Encoder(tokenizer, end_id)
    if not parts:
        points = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points // PART))

    def encode(batches):
        import pyspark

        if encoder.tok is None:
            encoder.load()
        bits = rangecoder.low_bits_for(max(encoder.tok.get_vocab_size(), end_id + 1))
        part, frame, kind = pyspark.TaskContext.get().partitionId(), 0, None
        held, ids, names, n = [], [], [], 0

        def close():
            nonlocal ids, names, n
            if ids:
                held.append((np.concatenate(ids), names, [len(x) for x in ids]))
            ids, names, n = [], [], 0

        def flush():
            nonlocal frame
            trim()
            for (x, docs_, lens), payload in zip(held, rangecoder.encode_frames([h[0] for h in held], bits), strict=True):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "frame": pa.array([frame], pa.int32()), "n_ids": pa.array([len(x)], pa.int64()), "doc_ids": pa.array([docs_], pa.list_(kind)), "n_tokens": pa.array([lens], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary())})
                frame += 1
            held.clear()
            trim()

        for b in batches:
            keys, texts, kind = b.column(0).to_pylist(), b.column(1), b.schema.field(0).type
            for k in range(0, len(keys), 64):
                for key, x in zip(keys[k : k + 64], encoder(texts.slice(k, 64).to_pylist()), strict=True):
                    ids.append(x), names.append(key)
                    n += len(x)
                    if n >= FRAME:
                        close()
                        if sum(len(h[0]) for h in held) >= TOGETHER:
                            yield from flush()
            del b, texts  # not beside the next batch
        close()
        yield from flush()
        trim()

    rows = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, f"part int, frame int, n_ids long, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>, n_tokens array<long>, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or, with ``digest``, ids_crc32) of each document of a file set."""
    frames = spark.read.parquet(path)
    order = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    before = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_part"))
    starts = frames.select("part", "frame", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before_frame")).join(F.broadcast(before), "part").select("part", "frame", (F.col("before_part") + F.col("before_frame")).alias("begin"))
    placed = frames.select("part", "frame", "doc_ids", "n_tokens", "payload").join(starts, ["part", "frame"]).select("begin", "doc_ids", "n_tokens", "payload")
    kind = pa.int64() if digest else pa.list_(pa.int64())
    id_kind = frames.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches):
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER // FRAME):
                part = b.slice(k, TOGETHER // FRAME)
                begins, lens, payloads = (part.column(c).to_pylist() for c in (0, 2, 3))
                names = part.column(1)
                for begin, doc_ids, n, ids in zip(begins, (names.slice(i, 1).flatten() for i in range(len(names))), lens, rangecoder.decode_frames(payloads), strict=True):
                    ends = np.cumsum(n)
                    first = ends - n
                    raw = ids.astype("<u4")
                    if digest:
                        last = [zlib.crc32(raw[i:j].tobytes()) for i, j in zip(first, ends, strict=True)]
                    else:
                        last = [raw[i:j].astype(np.int64) for i, j in zip(first, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(first + begin, pa.int64()), pa.array(n, pa.int64()), pa.array(last, kind)], ["doc_id", "start", "n_tokens", "last"])
        trim()

    name = "ids_crc32" if digest else "ids"
    return placed.mapInArrow(decode, f"doc_id {id_kind}, start long, n_tokens long, last {'long' if digest else 'array<long>'}").withColumnRenamed("last", name)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to the shared folder and read the digest of each document back."""
    path = scratch(docs.sparkSession)
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path, digest=True)
