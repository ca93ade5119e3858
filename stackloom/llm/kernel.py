"""Vectorised text kernel: words, lines and 64-bit hashes of whole UTF-8 texts.

Works on Arrow string buffers without making a Python object per word.  A batch
is handled in chunks of whole documents of about ``CHUNK`` bytes, so memory is
bounded by the chunk (or by one document, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """The first n numbers of a splitmix64 stream."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE_CODE = stream(0x5EED, 256) | U64(1)
BASE = U64(0x9FB21C651E98DF25)
_INV = U64(pow(int(BASE), -1, 1 << 64))
SHINGLE = stream(0xABCD, 64) | U64(1)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of a word: not white space of ASCII; and ASCII letters and digits with all of non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    ALNUM[_lo : _hi + 1] = False

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n at least."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, CHUNK + (CHUNK >> 3))
        one = np.ones(n, U64)
        one[1:] = BASE
        inv = np.ones(n, U64)
        inv[1:] = _INV
        _powers = np.cumprod(one, dtype=U64), np.cumprod(inv, dtype=U64)
    return _powers


def forget() -> None:
    """Drops the powers, which grow with the largest chunk so far."""
    global _powers
    _powers = np.ones(1, U64), np.ones(1, U64)


class Chunk:
    """Some whole documents: bytes, and offsets of each (n + 1 of them)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, rows: slice):
        self.buf, self.offs, self.rows, self.n = buf, offs, rows, len(offs) - 1

    def prefix(self, fold: bool) -> np.ndarray:
        """Prefix sums from which hash_of() takes the hash of any range."""
        code = BYTE_CODE[FOLD] if fold else BYTE_CODE
        out = np.zeros(len(self.buf) + 1, U64)
        np.cumsum(code[self.buf] * powers(len(self.buf))[0][: len(self.buf)], dtype=U64, out=out[1:])
        return out

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words in bytes, and for each document the number of words before it."""
        ok = is_word[self.buf]
        first, last = ok.copy(), ok.copy()
        first[1:] &= ~ok[:-1]
        last[:-1] &= ~ok[1:]
        cut = self.offs[self.offs < len(ok)]
        first[cut] = ok[cut]
        cut = self.offs[self.offs > 0] - 1
        last[cut] = ok[cut]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, np.searchsorted(start, self.offs)


def hash_of(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they are."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; the last k - 1 places have none."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for j in range(k):
        out += words[j : j + m] * SHINGLE[j]
    return mix(out)


def spans_of(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of k within each document: (places at which a whole run starts, document of each)."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + (first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]))[doc], doc


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of flags over each document's range."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
        wide = True
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """The documents of a string column in chunks of about size bytes."""
    buf, offs = text_of(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield Chunk(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], slice(i, j))
        i = j
