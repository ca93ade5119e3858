"""Benchmark decontamination with suffix arrays over the training text.

Every executor task builds suffix arrays over the words of its own shard of documents (about
``SHARD`` bytes each, so memory is bounded; a longer document is one shard) and binary-searches every suffix of the benchmark
in them.  From the range of a suffix come its longest verbatim matches and where they are.

Words are numbered by the benchmark's vocabulary (0: a word that no item has; no match can hold
one, so suffixes that begin with it are not sorted).  Four numbers of 16 bits make one 64-bit key,
or two of 32 bits where a block has 65,536 or more different words; suffixes are sorted by the
three or six keys of ``DEPTH`` = 12 words, and matches are then extended word by word.

A match counts if it is ``window`` words long, or covers a whole item that is shorter.  Windows
within one document only.  Null or empty texts have no words: no hits, not contaminated; items
without words are never found, and those without an id are one item with an empty name.  Repeated documents and items count each on their own; further
columns pass through ``remove``.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text, one pass over the
documents for each; a benchmark of usual size is one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import kernel as K
from stackloom.llm.spark import cut, tidy, unused

WINDOW = 10
DEPTH = 12
SHARD = 1 << 20
BLOCK_BYTES = 16 << 20


def word_hashes(c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's words in lower case, and for each document the number of words before it."""
    start, end, first = c.words(K.ALNUM)
    return K.hash_of(c.prefix(True), start, end), first


def keys_at(ids: np.ndarray, stop: np.ndarray, at: np.ndarray, bits: int = 16) -> np.ndarray:
    """Rows of 64-bit keys: 12 numbers of `bits` bits from each place on, 0 beyond `stop`."""
    each = 64 // bits
    out = np.zeros((DEPTH // each, len(at)), K.U64)
    for j in range(DEPTH):
        p = at + j
        inside = p < stop
        v = np.zeros(len(at), K.U64)
        v[inside] = ids[p[inside]]
        out[j // each] = (out[j // each] << K.U64(bits)) | v
    return out


class Benchmark:
    """Items as numbered words; their suffixes, those with equal first windows together."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = [str(i) for i, _ in items]
        self.window = window
        hashes, firsts = [], [0]
        for c in K.chunks(pa.array([t for _, t in items], pa.large_string())):
            h, first = word_hashes(c)
            hashes.append(h)
            firsts += [firsts[-1] + n for n in np.cumsum(np.diff(first)).tolist()]
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, K.U64)
        self.vocabulary = np.unique(hashes)
        self.bits = 16 if len(self.vocabulary) < 1 << 16 else 32
        self.ids = np.searchsorted(self.vocabulary, hashes) + 1
        first = np.array(firsts)
        n = np.diff(first)
        self.item = np.repeat(np.arange(len(n)), n)
        self.stop = first[1:][self.item]
        self.whole = n[self.item]
        self.at = np.arange(len(self.item))
        # places at which a window starts; a short item is one window
        self.need = np.minimum(window, self.whole)
        ok = self.at + self.need <= self.stop
        self.tests = self.at[ok]
        self.need, self.item_of = self.need[ok], self.item[ok]
        keys = keys_at(self.ids, (self.tests + self.need), self.tests, self.bits)
        self.keys, self.which = np.unique(keys, axis=1, return_inverse=True) if len(self.tests) else (keys, np.zeros(0, np.int64))
        self.which = self.which.ravel()
        self.lengths = np.zeros(self.keys.shape[1], np.int64)
        self.lengths[self.which] = self.need
        # the items of each distinct window
        pairs = np.unique(self.which.astype(np.int64) * max(1, len(self.names)) + self.item_of)
        self.items, self.edge = pairs % max(1, len(self.names)), np.searchsorted(pairs // max(1, len(self.names)), np.arange(self.keys.shape[1] + 1))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class Shard:
    """Suffix array over the words of some documents."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, bits: int = 16):
        self.ids, self.first, self.bits = ids, first, bits
        stop = np.repeat(first[1:], np.diff(first))
        at = np.flatnonzero(ids)
        lead = keys_at(ids, stop[at], at, bits)
        order = np.lexsort(lead[::-1])
        self.suffixes, self.keys, self.stop = at[order], lead[:, order], stop

    def range_of(self, keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each test the range of suffixes that start with its first `words` words (12 at most)."""
        lo = np.zeros(keys.shape[1], np.int64)
        hi = np.full(keys.shape[1], len(self.suffixes))
        each = 64 // self.bits
        for j in range(DEPTH // each):
            k = np.clip(words - each * j, 0, each)
            free = np.where(k == each, K.U64(0), (K.U64(1) << (K.U64(self.bits) * (each - k).astype(K.U64) % K.U64(64))) - K.U64(1))
            free[k == 0] = ~K.U64(0)
            a, b = lo, hi
            lo, hi = self._bound(j, keys[j], a, b, True), self._bound(j, keys[j] | free, a, b, False)
        return lo, hi

    def _bound(self, j: int, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: bool) -> np.ndarray:
        """Binary search of every key in its own range of the j-th keys, all at once."""
        lo, hi, col = lo.copy(), hi.copy(), self.keys[j]
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            v = col[np.minimum(mid, len(col) - 1)]
            right = open_ & ((v < key) if left else (v <= key))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo


def occurrences(shard: Shard, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(place in the shard, index of the distinct window) for each occurrence of each window."""
    lo, hi = shard.range_of(bench.keys, bench.lengths)
    n = hi - lo
    w = np.repeat(np.arange(len(n)), n)
    return shard.suffixes[np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + lo[w]], w


def longest(shard: Shard, bench: Benchmark) -> list[tuple[int, int, int, int]]:
    """Maximal matches of `window` words or whole short items: (item, item word, place in the shard, words)."""
    at, w = occurrences(shard, bench)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    tests = [np.flatnonzero(bench.which == k) for k in range(bench.keys.shape[1])] if len(at) else []
    out = []
    for p, k in sorted(zip(at.tolist(), w.tolist(), strict=True)):
        for t in tests[k].tolist():
            i, item = int(bench.tests[t]), int(bench.item_of[t])
            if found.get((item, p - i), (0, -1))[1] >= p + bench.need[t]:
                continue
            n = 0
            while i + n < bench.stop[i] and p + n < shard.stop[p] and shard.ids[p + n] == bench.ids[i + n]:
                n += 1
            found[item, p - i] = (p, p + n)
            out.append((item, i - int(np.searchsorted(bench.item, item)), p, n))
    return out


def _items(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks whose texts take about `block_bytes` each."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        yield [(r["i"], r["t"]) for r in part.orderBy("i", "t").collect()]


def _add(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """docs with n_words, spans (start and end words of hits) and items of this block added to what is there."""
    at = docs.columns.index("text")
    mine = range(len(docs.columns) - 3, len(docs.columns))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spans, items = [], [], []
            for c in K.chunks(b.column(at), SHARD):
                hashes, first = word_hashes(c)
                shard = Shard(bench.number(hashes), first, bench.bits)
                place, w = occurrences(shard, bench)
                doc = np.searchsorted(first, place, "right") - 1
                order = np.argsort(doc, kind="stable")
                place, w, doc = place[order], w[order], doc[order]
                lim = np.searchsorted(doc, np.arange(c.n + 1))
                for i in range(c.n):
                    p, k = place[lim[i] : lim[i + 1]] - first[i], w[lim[i] : lim[i + 1]]
                    edge = np.zeros(first[i + 1] - first[i] + 1, np.int32)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + bench.lengths[k], -1)
                    inside = np.diff(np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]]).astype(np.int8)) if len(p) else np.zeros(1, np.int8)
                    spans.append(np.stack([np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)], 1).ravel())
                    hit = np.unique(np.concatenate([bench.items[bench.edge[x] : bench.edge[x + 1]] for x in np.unique(k)])) if len(k) else []
                    items.append([bench.names[x] for x in hit])
                n += np.diff(first).tolist()
            before = [b.column(j).to_pylist() for j in mine]
            cols = b.columns
            cols[mine[0]] = pa.array(n, pa.int64())
            cols[mine[1]] = pa.array([[*x, *(int(v) for v in y)] for x, y in zip(before[1], spans, strict=True)], pa.list_(pa.int64()))
            cols[mine[2]] = pa.array([x + y for x, y in zip(before[2], items, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with three columns more: number of words, spans of hit words and items found, over the whole benchmark."""
    if window > DEPTH:
        raise ValueError(f"windows of at most {DEPTH} words")
    names = [unused(docs, c) for c in ("n", "spans", "items")]
    out = docs.select("*", F.lit(0).cast("bigint").alias(names[0]), F.array().cast("array<bigint>").alias(names[1]), F.array().cast("array<string>").alias(names[2]))
    for k, items in enumerate(_items(benchmark, block_bytes)):
        out = _add(cut(out) if k else out, Benchmark(items, window))
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits (words of each maximal run) for each row."""
    rows = matched(docs.select("doc_id", "text"), benchmark, window, block_bytes).drop("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, many, digest, runs = [], [], [], []
            for spans, items in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                joined: list[list[int]] = []
                for a, z in sorted(zip(spans[::2], spans[1::2], strict=True)):
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], z)
                    else:
                        joined.append([a, z])
                names = sorted({*items})
                hit.append(sum(z - a for a, z in joined))
                many.append(len(names))
                digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                runs.append([{"start": a, "words": z - a} for a, z in joined])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(many, pa.int64()), pa.array(digest), pa.array([h > 0 for h in hit]), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"],
            )

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hits array<struct<start: bigint, words: bigint>>")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim matches and where they are: doc_id, item_id (as text), first word in the item and in the document, words."""
    out = None
    for items in _items(benchmark, block_bytes):
        bench = Benchmark(items, window)

        def run(batches: Iterator[pa.RecordBatch], bench: Benchmark = bench) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c in K.chunks(b.column(1), SHARD):
                    hashes, first = word_hashes(c)
                    rows = longest(Shard(bench.number(hashes), first, bench.bits), bench)
                    doc = np.searchsorted(first, [r[2] for r in rows], "right") - 1
                    ids = b.column(0).take(pa.array(doc + c.rows.start, pa.int64()))
                    cols = [[bench.names[r[0]] for r in rows], [r[1] for r in rows], [int(r[2] - first[d]) for r, d in zip(rows, doc, strict=True)], [int(r[3]) for r in rows]]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.string()), *(pa.array(x, pa.int64()) for x in cols[1:])], ["doc_id", "item_id", "item_word", "doc_word", "words"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id string, item_word bigint, doc_word bigint, words bigint")
        out = part if out is None else out.unionAll(part)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with their columns, in which nothing of the benchmark is found."""
    out = matched(docs, benchmark, window, block_bytes)
    return out.where(F.size(out.columns[-2]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
