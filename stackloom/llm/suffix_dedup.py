"""Removal of repeated byte strings with blockwise suffix arrays sorted by difference-cover ranks.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts at another place: in any
document, also the same one; overlaps count and everything is judged on the input.

1. Equal texts are pre-aggregated to a class; all that follows works on one member of each.
2. Every string of LENGTH bytes holds a window of minimizers: the least hash of all ``GRAM``-byte
   strings among its first ``SPREAD`` places.  Equal strings have the same minimizer, so a string
   whose minimizer occurs once in the corpus can't repeat.  The places with one minimizer form a
   run; a run whose minimizer occurs again, also within the run, is cut out with the bytes that its strings need (its
   context), and equal contexts are pre-aggregated.
3. Contexts are dealt out by minimizer: the suffix buckets.  A bucket of more than ``BUCKET``
   contexts is split first: strings with about as many bytes before the minimizer have some bytes
   around it in common, and these deal them out again, by ever narrower classes as long as a bucket
   is too large.  In the last class the common bytes are the string.  A task sorts one block of whole
   buckets at a time, ``BLOCK`` bytes or one bucket.  Suffixes are sorted by their first V bytes;
   longer ties are resolved by ranks, computed beforehand, of the suffixes at the places of a
   difference cover modulo V: for any two suffixes there is a shift below V that takes both to
   ranked places.  Neighbours with LENGTH bytes in common repeat.
4. Covered spans go back to their documents.

Null texts are empty: nothing is removed.  Texts shorter than LENGTH lose nothing.  Repeated rows
are occurrences of their own, so each loses everything if long enough.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm import kernel as K
from stackloom.llm.spark import cut, parts, tidy

LENGTH = 400
GRAM = 200
SPREAD = LENGTH - GRAM + 1
BLOCK = 2 << 20
V = 13
COVER = (0, 1, 3, 9)  # every difference modulo 13 is one of two members
CONTEXT_BYTES_A_TASK = 12 << 20
BUCKET = 512
FEW = 20_000  # texts with a run in a large bucket, up to which they are broadcast
WIDTHS = (64, 16, 4, 1)  # each divides the one before, so classes nest


def places(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each string of a chunk's documents: (minimizer, its place in the chunk, document, start).

    The minimizer's place is the leftmost with the least leading bits.
    """
    n = len(buf)
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return np.zeros(0, K.U64), z, z, z
    pre = K.Chunk(buf, offs, slice(0, 0)).prefix(False)
    h = K.mix((pre[GRAM:] - pre[:-GRAM]) * K.powers(n + 1)[1][: n - GRAM + 1])
    m = len(h) - SPREAD + 1
    rows = -(-len(h) // SPREAD)
    pad = np.full(rows * SPREAD, ~K.U64(0))
    low_bits = K.U64((1 << max(24, n.bit_length())) - 1)
    pad[: len(h)] = (h & ~low_bits) | np.arange(len(h), dtype=K.U64)
    pad = pad.reshape(rows, SPREAD)
    head = np.minimum.accumulate(pad, 1).ravel()
    tail = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    place = (np.minimum(tail[:m], head[SPREAD - 1 : SPREAD - 1 + m]) & low_bits).astype(np.int64)
    # strings within one document only
    many = np.maximum(np.diff(offs) - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    place = place[offs[:-1][doc] + at]
    return h[place], place, doc, at


def minimizers(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one minimizer in a chunk: (minimizer, document, first start, starts, loop).

    loop: the minimizer has several places within the run, as in periodic text.
    """
    value, place, doc, at = places(buf, offs)
    new = np.ones(len(doc), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return value[first], doc[first], at[first], last - first + 1, place[last] != place[first]


def pieces(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts of one class in a chunk of contexts: (key, content, context, first start, starts).

    A class: `width` numbers of bytes before the minimizer, and all bytes around it that its strings have in common.
    Equal strings are in the same class.
    """
    _, place, doc, at = places(buf, offs)
    begin = offs[:-1][doc] + at
    kind = (place - begin) // width
    least = kind * width
    pre = K.Chunk(buf, offs, slice(0, 0)).prefix(False)
    common = K.hash_of(pre, place - least, place + LENGTH + 1 - np.minimum(least + width, SPREAD))
    key = K.mix(common + kind.astype(K.U64) * K.SHINGLE[0] + K.U64(width))
    new = np.ones(len(doc), bool)
    if width > 1:
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(doc)))
    begin = begin[first]
    end = begin + many - 1 + LENGTH
    return key[first], K.hash_of(pre, begin, end) ^ K.mix((end - begin).astype(K.U64)), doc[first], at[first], many


def _keyed(buf: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """First n <= 8 bytes from each place as big-endian numbers; 0 beyond the end."""
    out = np.zeros(len(at), K.U64)
    wide = np.append(buf, np.zeros(8, np.uint8))
    for j in range(n):
        out = (out << K.U64(8)) | wide[np.minimum(at + j, len(wide) - 1)]
    return out


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 by sorted keys; equal keys have equal ranks."""
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def cover_ranks(buf: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the cover the rank of its suffix up to `depth` bytes at least; 0 elsewhere."""
    n = len(buf)
    at = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
    a, b = _keyed(buf, at, 8), _keyed(buf, at + 8, V - 8)
    rank = np.zeros(n + 1, np.int64)
    r = _dense(np.lexsort((b, a)), a, b)
    known = V
    while known < depth:  # prefix doubling: a step of a multiple of V stays within the cover
        rank[at] = r
        step = known // V * V
        pair = r.astype(K.U64) << K.U64(32) | rank[np.minimum(at + step, n)].astype(K.U64)
        r = _dense(np.argsort(pair), pair)
        known += step
    rank[at] = r
    return rank


SHIFT = np.array([[next(d for d in range(V) if (a + d) % V in COVER and (b + d) % V in COVER) for b in range(V)] for a in range(V)])


def sort_suffixes(buf: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The starts in the order of their suffixes (to `depth` bytes; equal ones stand together)."""
    rank = np.append(cover_ranks(buf, depth), np.zeros(V, np.int64))
    a, b = _keyed(buf, starts, 8), _keyed(buf, starts + 8, V - 8)
    order = np.lexsort((b, a))
    group = _dense(order, a, b)
    size = np.bincount(group)
    tied = np.flatnonzero(size[group] > 1)
    less = np.zeros(len(starts), np.int64)
    residue = starts[tied] % V
    members = [tied[residue == r] for r in range(V)]
    for r in range(V):
        for q in range(V):
            d = SHIFT[r, q]
            mine, other = members[r], members[q]
            if len(mine) and len(other):
                key = lambda m: group[m] << 32 | rank[np.minimum(starts[m] + d, len(buf))]  # noqa: B023, E731
                less[mine] += np.searchsorted(np.sort(key(other)), key(mine))
    return starts[np.lexsort((less, group))]


def repeated(texts: list[bytes], counts: list[int], twice: list[bool]) -> list[list[int]]:
    """For each context of a block: covered spans (start, end, ...) among its first counts[i] starts."""
    # one zero byte and more after each keeps suffixes within their contexts: no string reaches over an end
    offs = np.cumsum([0] + [len(t) + 1 for t in texts])
    buf = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    counts_ = np.array(counts)
    owner = np.repeat(np.arange(len(texts)), counts_)
    local = np.arange(len(owner)) - np.repeat(np.cumsum(counts_) - counts_, counts_)
    starts = offs[owner] + local
    order = sort_suffixes(buf, starts)
    pre = K.Chunk(buf, offs, slice(0, 0)).prefix(False)
    h = K.hash_of(pre, order, order + LENGTH)
    same = h[1:] == h[:-1]
    hit = np.zeros(len(buf) + 1, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    flags = hit[starts] | np.array(twice, bool)[owner]
    out: list[list[int]] = []
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        f = np.diff(np.concatenate([[0], flags[edge[i] : edge[i + 1]].view(np.int8), [0]]))
        s, e = np.flatnonzero(f == 1), np.flatnonzero(f == -1)
        out.append(np.stack([s, e - 1 + LENGTH], 1).ravel().tolist())
    return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, text) -> (key, d1, d2, at, loop): the runs of each text; a text seen before in the task adds nothing."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        d1, d2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        for c in K.chunks(b.column(2)):
            fresh = np.zeros(c.n, bool)
            for i in range(c.n):
                d = (int(d1[c.rows.start + i]), int(d2[c.rows.start + i]))
                if d not in seen:
                    fresh[i] = True
                    if len(seen) < 1_000_000:
                        seen.add(d)
            key, doc, at, _, loop = minimizers(c.buf, c.offs)
            ok = fresh[doc]
            row = c.rows.start + doc[ok]
            yield pa.RecordBatch.from_arrays([pa.array(key[ok].view(np.int64)), pa.array(d1[row]), pa.array(d2[row]), pa.array(at[ok]), pa.array(loop[ok])], ["key", "d1", "d2", "at", "loop"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, text, ats) -> one row for each run that starts in ats."""
    names = ["key", "ctx", "d1", "d2", "at", "starts", "bytes"]
    for b in batches:
        d1, d2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        wanted = b.column(3).to_pylist()
        for c in K.chunks(b.column(2)):
            key, doc, at, many, _ = minimizers(c.buf, c.offs)
            n = max(1, int(at.max()) + 1) if len(at) else 1
            want = np.concatenate([np.array(sorted(wanted[c.rows.start + i]), np.int64) + i * n for i in range(c.n)] or [np.zeros(0, np.int64)])
            ok = np.flatnonzero(np.isin(doc * n + at, want))
            begin = c.offs[:-1][doc[ok]] + at[ok]
            end = begin + many[ok] - 1 + LENGTH
            ctx = K.hash_of(c.prefix(False), begin, end) ^ K.mix((end - begin).astype(K.U64))
            row = c.rows.start + doc[ok]
            raw = c.buf.tobytes()
            for lo in range(0, len(ok), 5000):
                s = slice(lo, lo + 5000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[ok[s]].view(np.int64)), pa.array(ctx[s].view(np.int64)), pa.array(d1[row[s]]), pa.array(d2[row[s]]), pa.array(at[ok[s]]), pa.array(many[ok[s]]), pa.array([raw[x:y] for x, y in zip(begin[s].tolist(), end[s].tolist(), strict=True)], pa.binary())],
                    names,
                )


def _pieces(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key0, ctx0, offs, bytes, twice) -> a row for each different piece of a row; offs: where it stands in the context (key0, ctx0).

    A piece occurs twice if its row does, or if it stands at several places in it.
    """
    names = ["key0", "ctx0", "offs", "key", "ctx", "starts", "bytes", "twice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key0, ctx0 = b.column(0).to_numpy(), b.column(1).to_numpy()
            stands, twice = b.column(2).to_pylist(), b.column(4).to_pylist()
            for c in K.chunks(b.column(3).view(pa.string())):
                key, ctx, doc, at, many = pieces(c.buf, c.offs, width)
                if not len(key):
                    continue
                order = np.lexsort((at, ctx, key, doc))
                key, ctx, doc, at, many = (x[order] for x in (key, ctx, doc, at, many))
                new = np.ones(len(key), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(key))
                raw = c.buf.tobytes()
                for lo in range(0, len(first), 5000):
                    f, z = first[lo : lo + 5000], last[lo : lo + 5000]
                    row = c.rows.start + doc[f]
                    offs = [[x + y for x in stands[r] for y in at[i:j].tolist()] for r, i, j in zip(row.tolist(), f.tolist(), z.tolist(), strict=True)]
                    begin = c.offs[:-1][doc[f]] + at[f]
                    end = begin + many[f] - 1 + LENGTH
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key0[row]), pa.array(ctx0[row]), pa.array(offs, pa.list_(pa.int64())), pa.array(key[f].view(np.int64)), pa.array(ctx[f].view(np.int64)), pa.array(many[f]), pa.array([raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()), pa.array([twice[r] or len(x) > 1 for r, x in zip(row.tolist(), offs, strict=True)])],
                        names,
                    )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key -> their covered spans, a block of whole buckets at a time."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        spans = repeated([r[3] for r in rows], [r[2] for r in rows], [r[4] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(spans, pa.list_(pa.int64()))], ["key", "ctx", "spans"])

    rows: list[tuple] = []
    size = 0
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if size >= BLOCK and r[0] != rows[-1][0]:
                yield flush(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[3])
    if rows:
        yield flush(rows)


def _kinds(rows: DataFrame, place: Column, twice: Column | bool = False) -> DataFrame:
    """Different contexts: (key, ctx, starts, bytes, twice); twice: at several places."""
    kinds = rows.groupBy("key", "ctx").agg(F.min("starts").alias("starts"), F.max("bytes").alias("bytes"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.max(F.lit(twice)).alias("twice"))
    return kinds.select("key", "ctx", "starts", "bytes", (F.col("twice") | (F.col("lo") != F.col("hi"))).alias("twice"))


def _found(kinds: DataFrame, tasks: int) -> DataFrame:
    """(key, ctx, spans) of the contexts with repeated strings."""
    dealt = kinds.repartition(tasks, "key").sortWithinPartitions("key", "ctx")
    return dealt.mapInArrow(tidy(_blocks), "key bigint, ctx bigint, spans array<bigint>").where(F.size("spans") > 0)


def _found_in_large(kinds: DataFrame, tasks: int) -> DataFrame:
    """The same with buckets of more than BUCKET contexts split until none is that large."""
    rows = cut(kinds.select(F.col("key").alias("key0"), F.col("ctx").alias("ctx0"), F.array(F.lit(0).cast("bigint")).alias("offs"), "*"))
    found = []
    for width in (*WIDTHS, None):
        small = rows
        if width:
            large = cut(rows.groupBy("key").agg(F.count_distinct("ctx").alias("n")).where(F.col("n") > BUCKET).select("key"))
            if large.isEmpty():
                width = None
            else:
                small = rows.join(F.broadcast(large), "key", "left_anti")
        spans = small.select("key0", "ctx0", "offs", "key", "ctx").join(_found(_kinds(small, F.xxhash64("key0", "ctx0", "offs"), F.col("twice")), tasks), ["key", "ctx"])
        found.append(spans.select("key0", "ctx0", F.flatten(F.transform("offs", lambda o: F.transform("spans", lambda x: x + o))).alias("spans")))
        if not width:
            break
        split = rows.join(F.broadcast(large), "key", "left_semi").select("key0", "ctx0", "offs", "bytes", "twice")
        rows = cut(split.mapInArrow(tidy(_pieces(width)), "key0 bigint, ctx0 bigint, offs array<bigint>, key bigint, ctx bigint, starts bigint, bytes binary, twice boolean"))
    every = functools.reduce(DataFrame.unionAll, found)
    return every.groupBy(F.col("key0").alias("key"), F.col("ctx0").alias("ctx")).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, copies (rows with this text), spans: covered spans of runs, unmerged; for every row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"d1": F.xxhash64("text"), "d2": F.hash("text")})
    key = ["d1", "d2"]
    copies = rows.groupBy(*key).agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    # computed twice rather than kept: they are small beside the text, but not beside the disk
    anchors = rows.where(F.octet_length("text") >= LENGTH).select(*key, "text").mapInArrow(tidy(_anchors), "key bigint, d1 bigint, d2 int, at bigint, loop boolean")
    place = F.xxhash64("d1", "d2", "at")
    often = anchors.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("loop").alias("loop"), F.count("*").alias("n")).where("lo <> hi or loop").select("key", (F.col("n") > BUCKET).alias("large"))
    hits = anchors.join(often, "key").groupBy(*key).agg(F.collect_set("at").alias("ats"), F.collect_set(F.when(F.col("large"), F.col("at"))).alias("large"))
    hits = cut(copies.join(hits, key, "left").where("copies > 1 or ats is not null"))
    runs, crowded = hits.agg(F.sum(F.coalesce(F.size("ats"), F.lit(0))), F.count(F.when(F.size("large") > 0, 1))).first()
    tasks = max(parts(spark), int(runs or 0) * (LENGTH + GRAM) // CONTEXT_BYTES_A_TASK)

    def contexts(wanted: DataFrame) -> DataFrame:
        once = rows.join(wanted, key).where(F.col("doc_id").eqNullSafe(F.col("rep")))
        return once.select(*key, "text", "ats").mapInArrow(tidy(_contexts), "key bigint, ctx bigint, d1 bigint, d2 int, at bigint, starts bigint, bytes binary")

    wanted = hits.where("ats is not null").select(*key, "ats", "rep")
    if not crowded:
        found = _found(_kinds(contexts(wanted), place), tasks)
    else:
        # the few texts with a run in a large bucket are looked up without a shuffle of all texts
        few = hits.where(F.size("large") > 0).select(*key, F.col("large").alias("ats"), "rep")
        large = _found_in_large(_kinds(contexts(F.broadcast(few) if crowded <= FEW else few), place), tasks)
        others = hits.where("ats is not null").select(*key, F.array_except("ats", "large").alias("ats"), "rep").where(F.size("ats") > 0)
        found = _found(_kinds(contexts(others), place), tasks).unionAll(large)
    spans = contexts(wanted).drop("bytes").join(found, ["key", "ctx"]).groupBy(*key).agg(F.collect_set(F.transform("spans", lambda x: x + F.col("at"))).alias("spans"))
    covered = hits.select(*key, "copies").join(spans, key, "left")
    return rows.join(covered, key, "left").select("doc_id", "text", F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"), F.coalesce(F.flatten("spans"), F.array().cast("array<bigint>")).alias("spans"))


def merged(spans: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), for every row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, many, kept = [], [], [], []
            for text, copies, spans in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                gaps = [(0, len(raw))] if copies > 1 and len(raw) >= LENGTH else merged(spans)
                size.append(len(raw))
                gone.append(sum(z - a for a, z in gaps))
                many.append(len(gaps))
                edges = [0, *(x for g in gaps for x in g), len(raw)]
                kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return repeats(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
