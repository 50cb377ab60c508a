"""Vectorised word hashing over batches of texts, shared by the operators that run in Python.

A batch of texts becomes one byte buffer; words, their hashes and the hashes of any run of
words come from prefix sums modulo 2**64, so no Python code runs for each word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial hashes; any odd numbers serve.
RADIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of a chunk of texts, about; bounds a worker's memory (a longer text is a chunk of its own).
CHUNK = 1 << 19
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(radix: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """radix**i and its inverse modulo 2**64, for i < n at least."""
    got = _POWERS.get(radix)
    if got is None or len(got[0]) < n:
        m = max(n, CHUNK + 16)
        up, down = np.full(m, radix, U), np.full(m, pow(radix, -1, 1 << 64), U)
        up[0] = down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if m <= 4 * CHUNK:
            _POWERS[radix] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk of texts.

    begin, end: byte bounds in ``buf``; doc: index of each word's text; first: index of each
    text's first word, with one more entry at the end; hash: 64 bits for each word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buf = buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.buf = buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        turn = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.begin, self.end = turn[0::2], turn[1::2]
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        starts = 1 + np.concatenate([[0], np.cumsum(lens + 1)])
        self.first = np.searchsorted(self.begin, starts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        up, down = powers(RADIX[0], len(buf) + 1)
        sums = np.concatenate([[U(0)], np.cumsum(buf.astype(U) * up[: len(buf)], dtype=U)])
        size = (self.end - self.begin).astype(U)
        self.hash = mix((sums[self.end] - sums[self.begin]) * down[self.begin] + size * U(RADIX[1]))

    def runs(self, which: int = 0) -> "Runs":
        return Runs(self.hash, RADIX[which])


class Runs:
    """Hashes of runs of consecutive words."""

    def __init__(self, hashes: np.ndarray, radix: int):
        up, self.down = powers(radix, len(hashes) + 1)
        self.sums = np.concatenate([[U(0)], np.cumsum(hashes * up[: len(hashes)], dtype=U)])

    def at(self, start: np.ndarray, n) -> np.ndarray:
        """Of the n words from each start on."""
        return mix((self.sums[start + n] - self.sums[start]) * self.down[start] + np.asarray(n).astype(U))


def chunks(texts, limit: int = CHUNK):
    """(first index, texts as bytes) for consecutive texts of about ``limit`` bytes; null is empty.

    texts: an Arrow array, of which a few rows at a time become Python strings.
    """
    out, size, begin = [], 0, 0
    for at in range(0, len(texts), 128):
        for i, t in enumerate(texts.slice(at, 128).to_pylist(), at):
            t = (t or "").encode("utf-8", "surrogatepass")
            if out and size + len(t) > limit:
                yield begin, out
                out, size, begin = [], 0, i
            out.append(t)
            size += len(t)
    if out:
        yield begin, out


def trim() -> None:
    """Give the memory that a Python worker has freed back to the system, as idle workers stay beside busy ones."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)
