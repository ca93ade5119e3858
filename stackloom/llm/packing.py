"""Packing token sequences by non-negative least squares.

A document's ids (byte-level BPE, then one end id 0) give as many full windows as they fill and
one rest; only full windows are cut off, so most pieces need no company.  Rests are packed in
blocks of documents: the block's histogram of rest lengths is the right-hand side, columns are
the shallow combinations (two or three lengths) that fill a window, and non-negative least
squares gives how often to use each.  Counts are rounded, the most used patterns take their rests
first and as many as there are (triples only what long rests don't need), and what is left over is packed greedily: the longest first, then
the longest that fit.  Open sequences are padded, except where they end at a power of two.

A block is what one hash partition of (doc_id, length) rows holds, and ``block_rows`` bounds its
mean size, so packing is parallel and nothing of corpus size meets in one task.  Repeated rows
are packed each on their own.  Null and empty texts are the single id 0; an empty table gives an
empty result.  Null doc_ids pass through.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import kernel as K
from stackloom.llm.spark import cut, tidy

WINDOW = 1024
BLOCK_ROWS = 20_000
#: Triples considered for each longest length.
TRIPLES = 8
#: Words kept between chunks, and bytes of text at a time.
CACHE = 200_000
CHUNK = 512 << 10
#: How vocabularies of this family split texts: a fixed value.  split_plain() says the same in numpy.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_MARK = "<|endoftext|>"

ODD, LETTER, DIGIT, MARK, BLANK = range(5)
_class = np.full(256, ODD, np.uint8)
_class[33:127] = MARK
_class[48:58] = DIGIT
_class[65:91] = _class[97:123] = LETTER
_class[[9, 10, 11, 12, 13, 32]] = BLANK
_class[0x80:0xC0] = LETTER  # right only after one of the next bytes
_class[0xC3:0xC9] = LETTER  # U+00C0 to U+023F, all letters but two


def classes(buf: np.ndarray) -> np.ndarray:
    """Class of every byte; ODD where the numpy splitter doesn't know the character."""
    out = _class[buf]
    lead = (buf >= 0xC3) & (buf < 0xC9)
    follow = (buf >= 0x80) & (buf < 0xC0)
    out[1:][follow[1:] & ~lead[:-1]] = ODD
    two = (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
    out[1:][two] = ODD
    out[buf == 39] = ODD  # contractions are left to the tokenizer
    return out


def split_plain(c: K.Chunk, cls: np.ndarray) -> np.ndarray:
    """Starts of the words into which PATTERN splits each document; each ends where the next starts."""
    n = len(cls)
    fresh = np.zeros(n, bool)
    fresh[c.offs[c.offs < n]] = True
    change = fresh.copy()
    change[1:] |= cls[1:] != cls[:-1]
    at = np.flatnonzero(change)
    flag = change.copy()
    # a blank run leaves its last character to itself or, if a space, to the word that follows
    solid = at[(cls[at] != BLANK) & ~fresh[at]]
    solid = solid[cls[solid - 1] == BLANK]
    flag[solid - 1] = True
    flag[solid[c.buf[solid - 1] == 32]] = False
    return np.flatnonzero(flag)


class Ids:
    """Token ids of whole texts; words are looked up by hash in a bounded cache."""

    def __init__(self, tokenizer_json: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        model = json.loads(tokenizer_json)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        ranks = {bytes(back[ch] for ch in w): i for w, i in model["vocab"].items() if w != END_MARK}
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merged)):
            raise ValueError("ids of this vocabulary are not the ranks of its merges")
        self.word = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.clear()

    def clear(self) -> None:
        self.hashes, self.begin, self.many = np.zeros(0, K.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def learn(self, c: K.Chunk, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(self.hashes) > CACHE:
            self.clear()
        raw = c.buf.tobytes()
        ids = [self.word(raw[a:b].decode()) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        many = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(many.sum()))
        begin = np.cumsum(many) - many + len(self.pool)
        self.pool = np.concatenate([self.pool, flat])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes)
        self.hashes, self.begin, self.many = hashes[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.many, many])[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, -1) if len(self.hashes) else np.full(len(hashes), -1)

    def chunk(self, c: K.Chunk) -> list[np.ndarray]:
        """uint32 ids of each document of a chunk."""
        if not len(c.buf):
            return [np.zeros(0, np.uint32)] * c.n
        cls = classes(c.buf)
        odd = (K.per_doc(cls == ODD, c.offs) > 0) | np.array([END_MARK.encode() in c.buf[a:b].tobytes() for a, b in zip(c.offs[:-1], c.offs[1:], strict=True)])
        start = split_plain(c, cls)
        end = np.append(start[1:], len(c.buf))
        doc = np.searchsorted(c.offs, start, "right") - 1
        ok = ~odd[doc]
        start, end, doc = start[ok], end[ok], doc[ok]
        hashes, first, which = np.unique(K.hash_of(c.prefix(False), start, end), return_index=True, return_inverse=True)
        at = self.find(hashes)
        if (new := at < 0).any():
            self.learn(c, hashes[new], start[first[new]], end[first[new]])
            at = self.find(hashes)
            if (at < 0).any():  # the cache was cleared meanwhile
                self.learn(c, hashes[at < 0], start[first[at < 0]], end[first[at < 0]])
                at = self.find(hashes)
        at = at[which]
        many = self.many[at]
        total = np.cumsum(many)
        flat = self.pool[np.arange(total[-1] if len(total) else 0) + np.repeat(self.begin[at] - (total - many), many)]
        cuts = np.concatenate([[0], total])[np.searchsorted(doc, np.arange(c.n + 1))]
        return [np.array(self.tok.encode(c.buf[c.offs[i] : c.offs[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) if odd[i] else flat[cuts[i] : cuts[i + 1]] for i in range(c.n)]


_ids: dict[int, Ids] = {}


def ids_of(tokenizer_json: str) -> Ids:
    """One instance for each Python process, kept between tasks."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ids:
        _ids[key] = Ids(tokenizer_json)
    return _ids[key]


def tokenize(docs: DataFrame, tokenizer_json: str, window: int = WINDOW) -> DataFrame:
    """For each row: doc_id, doc_tokens and the CRCs of its pieces (full windows, then the rest if any)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer_json)
        for b in batches:
            n, crcs = [], []
            for c in K.chunks(b.column(1), CHUNK):
                for x in ids.chunk(c):
                    raw = x.astype("<u4").tobytes() + b"\0\0\0\0"
                    n.append(len(raw) // 4)
                    crcs.append([zlib.crc32(raw[i : i + 4 * window]) for i in range(0, len(raw), 4 * window)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, doc_tokens bigint, crcs array<bigint>")


def combinations(have: np.ndarray, window: int, triples: int = TRIPLES) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of present lengths that fill the window; c is 0 in pairs.

    All pairs, and for each longest length up to half the window up to `triples` triples, spread
    over those there are.  A longer one with two shorter would leave another long one without any.
    """
    have = have.copy()
    have[0] = False
    some = np.flatnonzero(have)
    pairs = some[(2 * some >= window)]
    pairs = pairs[have[window - pairs]]
    out = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    for a in some[(3 * some >= window) & (2 * some <= window)]:
        rest = window - a
        b = some[(2 * some >= rest) & (some < rest) & (some <= a)]
        b = b[have[rest - b]]
        if len(b) > triples:
            b = b[np.linspace(0, len(b) - 1, triples).astype(int)]
        out.append(np.stack([np.full_like(b, a), b, rest - b], 1))
    return np.concatenate(out)


def nnls(patterns: np.ndarray, count: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares of patterns against a histogram, by accelerated projected gradients."""
    if not len(patterns):
        return np.zeros(0)
    size = len(count)
    used = patterns.T.ravel()

    def product(x: np.ndarray) -> np.ndarray:
        out = np.bincount(used, np.tile(x, 3), size)
        out[0] = 0  # the place of no third length
        return out

    # the greatest row sum times the greatest column sum bounds the squared norm
    step = 1 / (3 * max(1.0, product(np.ones(len(patterns))).max()))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        left = product(y) - count
        left[0] = 0
        new = np.maximum(0, y - step * left[patterns].sum(1))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        moved, x = np.abs(new - x).max(), new
        if moved < 1e-3:
            break
    return x


def pack(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each rest, 0 < length < window."""
    count = np.bincount(lengths, minlength=window + 1)[: window + 1]
    made: list[tuple[int, ...]] = []
    patterns = combinations(count > 0, window)
    often = nnls(patterns, count)
    # pairs first; triples have what the long lengths that are left don't need to be filled up
    spare = 0
    for kind in (patterns[:, 2] == 0, patterns[:, 2] > 0):
        rows = np.flatnonzero(kind)
        rows = rows[np.argsort(-often[rows], kind="stable")]
        for row, times in zip(patterns[rows].tolist(), np.rint(often[rows]).astype(int).tolist(), strict=True):
            parts = [n for n in row if n]
            times = min(times, *(count[n] // parts.count(n) for n in parts), spare if len(parts) == 3 else times)
            if times > 0:
                for n in parts:
                    count[n] -= times
                made += [tuple(parts)] * times
                spare -= times
        length, half = np.arange(window + 1), window // 2
        spare = int(count[: half + 1] @ length[: half + 1] - count[half + 1 :] @ (window - length[half + 1 :])) // window
    # what is left: the longest first, filled up by the longest that fit
    top = window
    while True:
        while top and not count[top]:
            top -= 1
        if not top:
            break
        parts, room = [], window
        n = top
        while n:
            parts.append(n)
            count[n] -= 1
            room -= n
            n = min(n, room)
            while n and not count[n]:
                n -= 1
        made.append(tuple(parts))
    # rests of one length take the places for it in order
    n = np.array([len(p) for p in made], np.int64)
    flat = np.array([x for p in made for x in p], np.int64)
    which = np.repeat(np.arange(len(made)), n)
    before = np.cumsum(flat) - flat
    place = before - np.repeat(before[np.cumsum(n) - n], n) if len(flat) else flat
    spot, rest = np.argsort(flat, kind="stable"), np.argsort(lengths, kind="stable")
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    seq[rest], off[rest] = which[spot], place[spot]
    return seq, off


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pieces(docs: DataFrame, tokenizer_json: str, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pieces of all rows with their places in sequences of at most `window` ids."""
    rows = cut(tokenize(docs, tokenizer_json, window))
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    salted = rows.withColumn("salt", F.xxhash64("doc_id", "doc_tokens", "crcs"))
    dealt = salted.repartition(min(blocks, 1 << 20), F.pmod(F.xxhash64("salt", F.monotonically_increasing_id()), F.lit(1 << 40))) if blocks > 1 else salted.coalesce(1)
    dealt = dealt.sortWithinPartitions("doc_id", "salt")

    def run(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        n = table["doc_tokens"].to_numpy()
        crc = table["crcs"].combine_chunks()
        whole, rest = n // window, n % window
        many = whole + (rest > 0)
        row = np.repeat(np.arange(len(n)), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(window, n[row] - k * window)
        seq, off = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        part_of = length < window
        seq[part_of], off[part_of] = pack(length[part_of], window)
        made = int(seq[part_of].max()) + 1 if part_of.any() else 0
        seq[~part_of] = made + np.arange(np.count_nonzero(~part_of))
        out = [table["doc_id"].combine_chunks().take(pa.array(row)), k * window, length, crc.flatten(), n[row], seq + (part << 32), off]
        whole_table = pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in out], names=[x.split()[0] for x in PIECES.split(", ")])
        yield from whole_table.to_batches(max_chunksize=10_000)

    @tidy
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from run(TaskContext.get().partitionId(), batches)

    return dealt.mapInArrow(numbered, PIECES)


def read_tokenizer(path: str) -> str:
    """A tokenizer's JSON, read where the driver runs; executors get it with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()
