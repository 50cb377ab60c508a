"""Adaptive context-mixing range coder for token ids, run over many blocks in lockstep.

Each block starts from an empty model, has a CRC-32 of its ids and can be decoded alone.  The next id's
distribution is a mixture of three predictions.  Order 2 (a hash of the two ids before) and order 1 (the id before) each
name an id with a confidence; order 0 has adaptive counts of all ids.  The two confidences pick a slot whose adaptive weights mix
them: w2 for the id of order 2, w1 for that of order 1, the rest for order 0's distribution.  Where both name
the same id, their weights add up.

Order 0 counts ids by their upper part (up to 1,024 of them), then in two trees of eight branches within it, whose counts adapt to every id; of vocabularies
beyond 2**16 the lowest bits are coded as equally likely.  An id that a higher order names is coded by that order's weight alone, without
order 0's share of it: that keeps intervals in one piece, and costs little (README has the figure).

The arithmetic coder keeps a 48-bit range and
emits 16 bits at a time; a carry is added to the words before at once.
A block is one lane of a numpy array, so a step codes one id in every block at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
BLOCK = 4096
SLOTS = 11  # bits of a prediction table's index
HI, REFRESH, TOTAL = 1024, 128, 16
#: Bits of an id below its upper part that the trees count: three for each.
FINE = 6
#: What an id's occurrence adds to its counts; a tree's eight counts are bytes of a word, so their sum stays below 256.
STEP, MOST = 16, 239
#: Words that a block may emit between two refreshes at most, and some: an id takes 5.
ROOM = 8 * REFRESH
ONES, BEFORE, HALF = U(0x0101010101010101), U(0x0101010101010100), U(0x7F7F7F7F7F7F7F7F)
#: Header of a coded frame: magic, bits of an id's lower part, upper parts (0: HI; for the trees' size alone), blocks, ids; then for each block its ids, 16-bit words and CRC-32.
HEAD, EACH = struct.Struct("<4sBxHIQ"), np.dtype([("n", "<u4"), ("words", "<u4"), ("crc", "<u4")])
MAGIC = b"TLR2"


def _span(node: np.ndarray, at: np.ndarray):
    """Of eight counts packed in each word: the sum of those before branch ``at``, its own, and of all."""
    shift = (at << 3).astype(U)
    return (node * BEFORE) >> shift & U(255), node >> shift & U(255), (node * ONES) >> U(56)


def _branch(node: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The branch whose counts hold u, by binary search in the packed sums."""
    sums, at = node * BEFORE, np.zeros(len(u), U)
    for step in (4, 2, 1):
        at += (sums >> (at + U(step) << U(3)) & U(255) <= u) * U(step)
    return at.astype(np.int64)


def _learned(node: np.ndarray, at: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The counts after branch ``at`` occurred; halved, but to 1 at least, before they would not fit a byte."""
    return np.where(total > U(MOST), (node >> U(1) & HALF) + (node & ONES), node) + (U(STEP) << (at << 3).astype(U))


class _Model:
    """Tables for every lane, and the parts of a step that coding and decoding share."""

    def __init__(self, lanes: int, uppers: int):
        self.t1, self.t2 = np.zeros(lanes << SLOTS, np.uint32), np.zeros(lanes << SLOTS, np.uint32)  # id << 4 | confidence
        self.base = np.arange(lanes, dtype=np.int64) << SLOTS
        # Of 2**16: order 2 is right; else order 1 is right.
        self.m2, self.m1 = np.full(lanes << 8, 1 << 14, np.int64), np.full(lanes << 8, 1 << 13, np.int64)
        self.row = np.arange(lanes, dtype=np.int64) << 8
        self.count = np.ones((lanes, HI), np.int32)
        self.trees = np.full(lanes * uppers, ONES), np.full(lanes * uppers * 8, ONES)
        self.cum = np.empty((lanes, HI + 1), np.int32)
        self.flat = self.cum.reshape(-1)
        self.p1 = np.zeros(lanes, np.int64)
        self.p2 = np.zeros(lanes, np.int64)

    def refresh(self, a: int):
        """Cumulated order-0 frequencies out of 2**16, each 1 at least."""
        c = np.cumsum(self.count[:a], axis=1, dtype=np.int64)
        total = c[:, -1:].copy()
        c *= (1 << TOTAL) - HI
        c //= total
        c += np.arange(1, HI + 1)
        self.cum[:a, 0] = 0
        self.cum[:a, 1:] = c

    def predict(self, a: int):
        p1, p2 = self.p1[:a], self.p2[:a]
        self.i1 = self.base[:a] + ((p1 * 0x9E3B1 >> 5) & ((1 << SLOTS) - 1))
        self.i2 = self.base[:a] + (((p1 * 0x2F0B5 + p2 * 0x6A09F) >> 7) & ((1 << SLOTS) - 1))
        self.e1, self.e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.slot = self.row[:a] + ((self.e2 & 15) << 4 | self.e1 & 15)
        self.f2, self.g1 = self.m2.take(self.slot), self.m1.take(self.slot)
        rest = (1 << TOTAL) - self.f2
        f1 = np.minimum(np.maximum(rest * self.g1 >> TOTAL, 1), rest - 1)
        c1, c2 = self.e1 >> 4, self.e2 >> 4
        self.both = c1 == c2
        self.w2, self.w1 = self.f2 + np.where(self.both, f1, 0), np.where(self.both, 0, f1)
        return c1, c2

    def update(self, a: int, x, hit1, hit2, same1):
        """Learn id x; hit1: order 1 coded it; same1: order 1 predicted it; hit2: order 2 did both."""
        self.m2[self.slot] = self.f2 + (np.where(hit2, 65300, 300) - self.f2 >> 5)
        self.m1[self.slot] = np.where(hit2 | self.both, self.g1, self.g1 + (np.where(hit1, 65300, 300) - self.g1 >> 5))
        new = x.astype(np.uint32) << 4 | np.uint32(1)
        for t, i, e, same in ((self.t1, self.i1, self.e1, same1), (self.t2, self.i2, self.e2, hit2)):
            c = e & 15
            t[i] = np.where(same, e + (c < 15), np.where(c > 1, e - (c + 1 >> 1), new))
        self.p2[:a], self.p1[:a] = self.p1[:a], x

    def frequencies(self, i, hi):
        """Cumulated order-0 frequencies before and after the upper part hi in the lanes i."""
        place = i * (HI + 1) + hi
        return self.flat.take(place).astype(np.int64), self.flat.take(place + 1).astype(np.int64)

    def upper(self, i, u):
        """The upper part whose frequencies hold u in each of the lanes i, by binary search."""
        begin = i * (HI + 1)
        at = begin
        step = HI >> 1
        while step:
            at = at + (self.flat.take(at + step) <= u) * step
            step >>= 1
        return at - begin


def _kind(low_bits: int):
    """The narrowest type that holds ids."""
    return np.uint16 if low_bits <= FINE else np.int32


def _uppers(blocks: list[np.ndarray], low_bits: int) -> int:
    """Upper parts that the ids have, counted from 0 on."""
    return max((int(b.max()) for b in blocks if len(b)), default=0) // (1 << low_bits) + 1


def _plan(lens: np.ndarray):
    """Lanes by falling length, and how many are still running at each step."""
    order = np.argsort(-lens, kind="stable")
    down = lens[order]
    return order, np.searchsorted(-down, -np.arange(1, (down[0] if len(down) else 0) + 1), side="right")


def encode_blocks(blocks: list[np.ndarray], low_bits: int) -> list[bytes]:
    lens = np.array([len(b) for b in blocks], np.int64)
    order, running = _plan(lens)
    lanes, steps = len(blocks), len(running)
    ids = np.zeros((steps, lanes), _kind(low_bits))
    for lane, b in enumerate(order):
        ids[: lens[b], lane] = blocks[b]
    uppers = _uppers(blocks, low_bits)
    model = _Model(lanes, uppers)
    low, size = np.zeros(lanes, U), np.full(lanes, 1 << 48, U)
    # A word for two ids or so; widened where that is not enough.
    width = steps * 5 // 8 + 2 * ROOM
    out, at = np.zeros((lanes, width), np.uint16), np.zeros(lanes, np.int64)
    flat, begin = out.reshape(-1), np.arange(lanes, dtype=np.int64) * width
    floor, mask = U(1 << 32), U((1 << 32) - 1)

    def shift(i):
        """Emit 16 bits of the lanes i."""
        part = low[i]
        top, place = part >> U(32), begin[i] + at[i]
        flat[place] = top & U(0xFFFF)
        over = place[top > U(0xFFFF)]
        while len(over):  # nearly always once
            over = over - 1
            flat[over] += np.uint16(1)
            over = over[flat[over] == 0]
        at[i] += 1
        low[i] = (part & mask) << U(16)
        size[i] <<= U(16)

    flat_bits = low_bits - FINE
    upper, lower = model.trees

    def narrow(i, node, at):
        """Code branch ``at`` of the trees' nodes."""
        before, own, total = _span(node, at)
        r = size[i] // total
        low[i] += r * before
        size[i] = r * own
        return total

    for t, a in enumerate(running):
        if t % REFRESH == 0:
            model.refresh(a)
            if at.max() + ROOM > width:
                wider = np.zeros((lanes, width + width // 2 + ROOM), np.uint16)
                wider[:, :width] = out
                out, width = wider, wider.shape[1]
                flat, begin = out.reshape(-1), np.arange(lanes, dtype=np.int64) * width
        x = ids[t, :a].astype(np.int64)
        c1, c2 = model.predict(a)
        hit2, same1 = c2 == x, c1 == x
        hit1 = same1 & ~hit2
        f2, f1 = model.w2, model.w1
        miss = ~(hit1 | hit2)
        cum = np.where(hit2, 0, np.where(hit1, f2, f2 + f1))
        freq = np.where(hit2, f2, np.where(hit1, f1, (1 << TOTAL) - f2 - f1))
        r = size[:a] >> U(TOTAL)
        low[:a] += r * cum.astype(U)
        size[:a] = r * freq.astype(U)
        i = np.flatnonzero(size[:a] < floor)
        if len(i):
            shift(i)
        i = np.flatnonzero(miss)
        if len(i):
            xi = x[i]
            hi, fine = xi >> low_bits, xi >> flat_bits & ((1 << FINE) - 1)
            from_, to = model.frequencies(i, hi)
            r = size[i] >> U(TOTAL)
            low[i] += r * from_.astype(U)
            size[i] = r * (to - from_).astype(U)
            model.count[i, hi] += 24
            j = i[size[i] < floor]
            if len(j):
                shift(j)
            first, second = fine >> 3, fine & 7
            place = i * uppers + hi
            node = upper[place]
            upper[place] = _learned(node, first, narrow(i, node, first))
            place = place * 8 + first
            node = lower[place]
            lower[place] = _learned(node, second, narrow(i, node, second))
            if flat_bits:
                j = i[size[i] < floor]
                if len(j):
                    shift(j)
                r = size[i] >> U(flat_bits)
                low[i] += r * (xi & ((1 << flat_bits) - 1)).astype(U)
                size[i] = r
            while len(i := i[size[i] < floor]):
                shift(i)
        model.update(a, x, hit1, hit2, same1)
    for _ in range(3):
        shift(np.arange(lanes))
    words, coded = out.astype("<u2", copy=False), [b""] * lanes
    for lane, b in enumerate(order):
        coded[b] = words[lane, : at[lane]].tobytes()
    return coded


def decode_blocks(coded: list[bytes], lens: np.ndarray, low_bits: int, uppers: int = HI) -> list[np.ndarray]:
    order, running = _plan(lens)
    lanes, steps = len(coded), len(running)
    width = max((len(c) for c in coded), default=0) // 2 + 8
    words = np.zeros((lanes, width), np.uint16)
    for lane, b in enumerate(order):
        w = np.frombuffer(coded[b], "<u2")
        words[lane, : len(w)] = w
    flat, begin = words.reshape(-1), np.arange(lanes, dtype=np.int64) * width
    ids = np.zeros((steps, lanes), _kind(low_bits))
    model = _Model(lanes, uppers)
    w = words[:, :3].astype(U)
    code, size, at = w[:, 0] << U(32) | w[:, 1] << U(16) | w[:, 2], np.full(lanes, 1 << 48, U), np.full(lanes, 3, np.int64)
    floor, top, flat_bits = U(1 << 32), (1 << TOTAL) - 1, low_bits - FINE
    upper, lower = model.trees

    def shift(i):
        code[i] = code[i] << U(16) | flat[begin[i] + np.minimum(at[i], width - 1)].astype(U)
        at[i] += 1
        size[i] <<= U(16)

    def branch(i, node):
        """The branch that comes next, and the sum of the node's counts."""
        total = (node * ONES) >> U(56)
        r = size[i] // total
        found = _branch(node, np.minimum(code[i] // r, total - U(1)))
        before, own, _ = _span(node, found)
        code[i] -= r * before
        size[i] = r * own
        return found, total

    for t, a in enumerate(running):
        if t % REFRESH == 0:
            model.refresh(a)
        c1, c2 = model.predict(a)
        f2, f1 = model.w2, model.w1
        r = size[:a] >> U(TOTAL)
        v = np.minimum((code[:a] // r).astype(np.int64), top)
        hit2 = v < f2
        miss = v >= f2 + f1
        hit1 = ~(hit2 | miss)
        cum = np.where(hit2, 0, np.where(hit1, f2, f2 + f1))
        freq = np.where(hit2, f2, np.where(hit1, f1, (1 << TOTAL) - f2 - f1))
        code[:a] -= r * cum.astype(U)
        size[:a] = r * freq.astype(U)
        i = np.flatnonzero(size[:a] < floor)
        if len(i):
            shift(i)
        x = np.where(hit2, c2, c1).astype(np.int64)
        i = np.flatnonzero(miss)
        if len(i):
            r = size[i] >> U(TOTAL)
            hi = model.upper(i, np.minimum((code[i] // r).astype(np.int64), top))
            from_, to = model.frequencies(i, hi)
            code[i] -= r * from_.astype(U)
            size[i] = r * (to - from_).astype(U)
            model.count[i, hi] += 24
            j = i[size[i] < floor]
            if len(j):
                shift(j)
            place = i * uppers + hi
            node = upper[place]
            first, total = branch(i, node)
            upper[place] = _learned(node, first, total)
            place = place * 8 + first
            node = lower[place]
            second, total = branch(i, node)
            lower[place] = _learned(node, second, total)
            xi = hi << FINE | first << 3 | second
            if flat_bits:
                j = i[size[i] < floor]
                if len(j):
                    shift(j)
                r = size[i] >> U(flat_bits)
                rest = np.minimum(code[i] // r, U((1 << flat_bits) - 1))
                code[i] -= r * rest
                size[i] = r
                xi = xi << flat_bits | rest.astype(np.int64)
            x[i] = xi
            while len(i := i[size[i] < floor]):
                shift(i)
        ids[t, :a] = x
        model.update(a, x, hit1, hit2, c1 == x)
    got: list = [None] * lanes
    for lane, b in enumerate(order):
        got[b] = ids[: lens[b], lane].astype(np.uint32)
    return got


def low_bits_for(vocabulary: int) -> int:
    """Bits of an id's lower part, so that its upper part is below ``HI``."""
    bits = max(FINE, max(1, vocabulary - 1).bit_length() - 10)
    if bits > 14:
        raise ValueError("ids must be below 2**24")
    return bits


def encode_frames(frames: list[np.ndarray], low_bits: int, block: int = BLOCK) -> list[bytes]:
    """Coded frames; all their blocks are coded in lockstep."""
    blocks = [[f[k : k + block] for k in range(0, len(f), block)] for f in frames]
    coded = iter(encode_blocks([b for f in blocks for b in f], low_bits))
    out = []
    for f in blocks:
        parts = [next(coded) for _ in f]
        index = np.array([(len(b), len(p) // 2, zlib.crc32(b.astype("<u4").tobytes())) for b, p in zip(f, parts, strict=True)], EACH)
        out.append(HEAD.pack(MAGIC, low_bits, _uppers(f, low_bits), len(f), sum(map(len, f))) + index.tobytes() + b"".join(parts))
    return out


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Ids of each frame.  Raises ValueError if a frame or a block's checksum is wrong."""
    parts, lens, crcs, of, bits, uppers = [], [], [], [], 8, 1
    for k, f in enumerate(frames):
        magic, bits, most, n, _ = HEAD.unpack_from(f)
        if magic != MAGIC:
            raise ValueError("not a frame of this coder")
        uppers = max(uppers, min(most or HI, HI))
        index = np.frombuffer(f, EACH, n, HEAD.size)
        at = HEAD.size + index.nbytes
        for n_ids, words, crc in index.tolist():
            parts.append(f[at : at + 2 * words]), lens.append(n_ids), crcs.append(crc), of.append(k)
            at += 2 * words
    try:
        got = decode_blocks(parts, np.array(lens, np.int64), bits, uppers)
    except IndexError:
        raise ValueError("a block names an id beyond its header's") from None
    for b, crc in zip(got, crcs, strict=True):
        if zlib.crc32(b.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
    out = [[] for _ in frames]
    for k, b in zip(of, got, strict=True):
        out[k].append(b)
    return [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]
