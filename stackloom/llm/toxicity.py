"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word (lower case, split at ASCII white space) enters as its own embedding, if the sample knows
it, beside the pooled embeddings of its character trigrams and beginnings (hashed).  A recurrent
layer runs over each window of ``SPAN`` words in both directions, attention pools the states, and
a linear layer gives the window's logit.  Windows overlap by half and cover the whole text; the
last one ends with the text.  The greatest logit of all windows, through a fitted logistic curve,
is the document's score.

Learning takes whole labelled texts (crc32(doc_id) modulo 5 not 0): at most ``SAMPLE`` rows and
``SAMPLE_BYTES`` bytes of each class, rows over ``ROW_BYTES`` left out as a whole.  The driver
holds these texts as numbers of words only and looks at windows chunk after chunk.  Embeddings
start from the log odds of words and beginnings.  A toxic text doesn't say where it is so, hence
each round learns from the window that scores highest so far, and from the highest and random
windows of the others.

Null and empty texts have one window without words.  Repeated rows are scored each.  With fewer
than 12 labelled texts, or fewer than 4 of a class, nothing can be learnt and every score is the
mean label (0.5 without labels).  Very long texts are one piece of work.  Labels with a null id
or another value than 0 and 1 teach nothing; a doc_id (bigint) may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import kernel as K
from stackloom.llm.quality import held_out, logistic, sample
from stackloom.llm.spark import tidy

SAMPLE = 2000
SAMPLE_BYTES = 6 << 20
ROW_BYTES = 64 << 10
SPAN, STRIDE = 32, 16
CHARS = 1 << 16
BEGINNINGS = range(4, 10)
#: Words in so many texts of the sample have an embedding of their own.
KNOWN = 3
DIM_WORD, DIM_CHAR, HIDDEN, ATTEND = 6, 10, 8, 8
CUTOFF = 0.5
F32 = np.float32


def _fresh(seed: int, words: int = 0) -> dict[str, np.ndarray]:
    """Parameters at random; embeddings of no word (the first row) and of all grams are zero."""
    g = np.random.default_rng(seed)
    d, h = DIM_WORD + DIM_CHAR, HIDDEN
    w = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(F32)
    p = {"word": np.zeros((words + 1, DIM_WORD), F32), "char": 0.02 * g.standard_normal((CHARS, DIM_CHAR)).astype(F32)}
    for s in "fb":
        p |= {f"x{s}": w(d, 3 * h), f"h{s}": w(h, 3 * h), f"c{s}": np.zeros(3 * h, F32)}
    return p | {"a": w(2 * h, ATTEND), "v": w(ATTEND, 1), "o": w(2 * h, 1), "b": np.zeros(1, F32)}


class Words:
    """The words of a chunk: an index into distinct ones, with hashes and gram buckets of these."""

    def __init__(self, c: K.Chunk):
        start, end, self.first = c.words(K.NOT_SPACE)
        prefix = c.prefix(True)
        self.hashes, at, which = np.unique(K.hash_of(prefix, start, end), return_index=True, return_inverse=True)
        self.which = which.astype(np.int32)
        start, end = start[at], end[at]
        n = end - start
        total = np.cumsum(n)
        place = np.arange(total[-1] if len(n) else 0) + np.repeat(start - (total - n), n)
        low = K.FOLD[c.buf].astype(np.uint32)
        before = np.where(place > np.repeat(start, n), low[np.maximum(place - 1, 0)], 1)
        after = np.where(place + 1 < np.repeat(end, n), low[np.minimum(place + 1, max(len(low) - 1, 0))], 2)
        tri = (before << 16) | (low[place] << 8) | after
        owner = [np.repeat(np.arange(len(n), dtype=np.int32), n)]
        grams = [((tri * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)]
        for k in BEGINNINGS:
            some = np.flatnonzero(n >= k)
            owner.append(some.astype(np.int32))
            grams.append((K.hash_of(prefix, start[some], start[some] + k) >> K.U64(48)).astype(np.int32))
        owner, grams = np.concatenate(owner), np.concatenate(grams)
        order = np.argsort(owner, kind="stable")
        self.tri, self.tri_n = grams[order], np.bincount(owner, minlength=len(n))
        self.tri_at = np.cumsum(self.tri_n) - self.tri_n
        self.word = np.zeros(len(n), np.int32)

    def known(self, vocabulary: np.ndarray) -> Words:
        """Numbers the words by a sorted vocabulary of hashes, 0 for others."""
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, self.hashes), len(vocabulary) - 1)
            self.word = np.where(vocabulary[at] == self.hashes, at + 1, 0).astype(np.int32)
        return self

    def inputs(self, p: dict[str, np.ndarray]) -> np.ndarray:
        out = np.empty((len(self.word), DIM_WORD + DIM_CHAR), F32)
        out[:, :DIM_WORD] = p["word"][self.word]
        for lo in range(0, len(self.word), 8192):  # bounds the rows of grams in memory
            hi = min(lo + 8192, len(self.word))
            a, z = self.tri_at[lo], self.tri_at[hi - 1] + self.tri_n[hi - 1]
            out[lo:hi, DIM_WORD:] = np.add.reduceat(p["char"][self.tri[a:z]], self.tri_at[lo:hi] - a) / np.sqrt(self.tri_n[lo:hi])[:, None].astype(F32)
        return out

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of distinct words, -1 beyond the text; document) of all windows, each of SPAN words."""
        begin, doc = self.begins(stride)
        index = self.at(begin, doc)
        return index, doc, (index >= 0).all(1)

    def begins(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """(first word, document) of all windows."""
        n = np.diff(self.first)
        many = np.maximum(1, -(-(n - SPAN) // stride) + 1)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), many)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        return self.first[:-1][doc] + np.maximum(0, np.minimum(k * stride, n[doc] - SPAN)), doc

    def at(self, begin: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Rows of SPAN indices of distinct words for windows of (first word, document)."""
        at = begin[:, None] + np.arange(SPAN)
        return np.where(at < self.first[1:][doc][:, None], np.append(self.which, np.int32(0))[np.minimum(at, len(self.which))], np.int32(-1))


def logits(p: dict[str, np.ndarray], x: np.ndarray, index: np.ndarray, full: np.ndarray, block: int = 2048) -> np.ndarray:
    """Logit of every window; x holds the inputs of distinct words."""
    h = HIDDEN
    out = np.empty(len(index), F32)
    table = {s: np.concatenate([x @ p[f"x{s}"] + p[f"c{s}"], p[f"c{s}"][None]]) for s in "fb"}  # the last row: no word
    for s in "fb":  # half angles, so that one tanh makes both gates
        table[s][:, : 2 * h] *= 0.5
    rec = {s: p[f"h{s}"].copy() for s in "fb"}
    for s in "fb":
        rec[s][:, : 2 * h] *= 0.5
    order = np.argsort(~full, kind="stable")
    edge = int(full.sum())
    for lo, hi in [(i, min(i + block, edge)) for i in range(0, edge, block)] + [(i, min(i + block, len(index))) for i in range(edge, len(index), block)]:
        rows = order[lo:hi]
        idx = np.ascontiguousarray(index[rows].T)
        mask = None if lo < edge else (idx >= 0).astype(F32)
        states = np.empty((SPAN, len(rows), 2 * h), F32)
        for s, steps, side in (("f", range(SPAN), slice(0, h)), ("b", range(SPAN - 1, -1, -1), slice(h, 2 * h))):
            state = np.zeros((len(rows), h), F32)
            for t in steps:
                g = table[s].take(idx[t], 0, mode="wrap")
                r = state @ rec[s]
                zr = np.tanh(g[:, : 2 * h] + r[:, : 2 * h])
                zr += 1
                zr *= 0.5
                new = np.tanh(g[:, 2 * h :] + zr[:, h:] * r[:, 2 * h :])
                new += zr[:, :h] * (state - new)
                state = new if mask is None else np.where(mask[t][:, None] > 0, new, state)
                states[t, :, side] = state
        score = np.tanh(states.reshape(-1, 2 * h) @ p["a"]) @ p["v"]
        e = np.exp(np.clip(score.reshape(SPAN, len(rows)), -30, 30))
        if mask is not None:
            e *= mask
        e /= e.sum(0) + F32(1e-9)
        out[rows] = np.einsum("tb,tbh->bh", e, states) @ p["o"][:, 0] + p["b"]
    return out


def gradients(p: dict[str, np.ndarray], x: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean weighted log loss: of the layers, and of the inputs x of distinct words."""
    h, n = HIDDEN, len(index)
    idx, mask = index.T, (index.T >= 0).astype(F32)[:, :, None]
    xs = np.concatenate([x, np.zeros((1, x.shape[1]), F32)])[idx]
    states, kept = np.zeros((SPAN, n, 2 * h), F32), {}
    sig = lambda v: 0.5 * (1 + np.tanh(0.5 * v))
    for s, steps, side in (("f", range(SPAN), slice(0, h)), ("b", range(SPAN - 1, -1, -1), slice(h, 2 * h))):
        state = np.zeros((n, h), F32)
        for t in steps:
            g, r = xs[t] @ p[f"x{s}"] + p[f"c{s}"], state @ p[f"h{s}"]
            z, k = sig(g[:, :h] + r[:, :h]), sig(g[:, h : 2 * h] + r[:, h : 2 * h])
            c = np.tanh(g[:, 2 * h :] + k * r[:, 2 * h :])
            kept[s, t] = state, z, k, c, r[:, 2 * h :]
            state = mask[t] * (c + z * (state - c)) + (1 - mask[t]) * state
            states[t, :, side] = state
    u = np.tanh(states @ p["a"])
    e = np.exp(np.clip((u @ p["v"])[:, :, 0], -30, 30)) * mask[:, :, 0]
    alpha = e / (e.sum(0) + 1e-9)
    pooled = np.einsum("tb,tbh->bh", alpha, states)
    logit = pooled @ p["o"][:, 0] + p["b"]
    prob = sig(logit)
    loss = float(-(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).mean())
    d = (weight * (prob - y) / n).astype(F32)
    out = {"o": pooled.T @ d[:, None], "b": d.sum(keepdims=True)}
    dpool = d[:, None] * p["o"][:, 0]
    dalpha = np.einsum("bh,tbh->tb", dpool, states)
    dscore = alpha * (dalpha - (alpha * dalpha).sum(0))
    dstates = alpha[:, :, None] * dpool
    out["v"] = np.einsum("tba,tb->a", u, dscore)[:, None]
    du = dscore[:, :, None] * p["v"][:, 0] * (1 - u * u)
    out["a"] = np.einsum("tbh,tba->ha", states, du)
    dstates = dstates + du @ p["a"].T
    dx = np.zeros((len(x) + 1, x.shape[1]), F32)
    for s, steps, side in (("f", range(SPAN - 1, -1, -1), slice(0, h)), ("b", range(SPAN), slice(h, 2 * h))):
        gx, gh, gc, carry = np.zeros_like(p[f"x{s}"]), np.zeros_like(p[f"h{s}"]), np.zeros(3 * h, F32), np.zeros((n, h), F32)
        for t in steps:
            state, z, k, c, rc = kept[s, t]
            total = carry + dstates[t, :, side]
            live = total * mask[t]
            dz = live * (state - c) * z * (1 - z)
            dc = live * (1 - z) * (1 - c * c)
            dk = dc * rc * k * (1 - k)
            dg = np.concatenate([dz, dk, dc], 1)
            dr = np.concatenate([dz, dk, dc * k], 1)
            gx += xs[t].T @ dg
            gh += state.T @ dr
            gc += dg.sum(0)
            np.add.at(dx, idx[t], dg @ p[f"x{s}"].T)
            carry = live * z + dr @ p[f"h{s}"].T + total * (1 - mask[t])
        out |= {f"x{s}": gx, f"h{s}": gh, f"c{s}": gc}
    return out, dx[:-1], loss


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5 / (size + 1e-9))
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)).astype(F32)


class Sample:
    """Whole labelled texts as chunks of numbered words, with the (chunk, first word, document) of each window."""

    def __init__(self, texts: list[str], known: int):
        self.parts: list[Words] = []
        self.start = [0]
        for c in K.chunks(pa.array(texts, pa.large_string())):
            self.parts.append(Words(c))
            self.start.append(self.start[-1] + c.n)
        hashes = np.concatenate([np.unique(w.which.astype(np.int64) * len(w.first) + np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))) // len(w.first) + off for w, off in zip(self.parts, np.cumsum([0] + [len(w.hashes) for w in self.parts]))] or [np.zeros(0, np.int64)])
        every = np.concatenate([w.hashes for w in self.parts] or [np.zeros(0, K.U64)])
        distinct, inverse = np.unique(every, return_inverse=True)
        self.vocabulary = distinct[np.bincount(inverse[hashes], minlength=len(distinct)) >= known]
        spans = [w.known(self.vocabulary).begins() for w in self.parts]
        self.begin = np.concatenate([b for b, _ in spans]).astype(np.int32)
        self.local = np.concatenate([d for _, d in spans])
        self.part = np.repeat(np.arange(len(spans)), [len(d) for _, d in spans])
        self.doc = self.local + np.array(self.start)[self.part]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def lifts(self, y: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds against the mean label of known words, and of grams, over the documents that are ok."""
        out = []
        for what, size in (("word", len(self.vocabulary) + 1), ("gram", CHARS)):
            pos, neg = np.zeros(size), np.zeros(size)
            for w, a, z in zip(self.parts, self.start, self.start[1:], strict=False):
                doc = np.repeat(np.arange(z - a), np.diff(w.first))
                mine = ok[a:z][doc]
                pairs = np.unique(w.which[mine].astype(np.int64) * (z - a) + doc[mine])
                word, doc = pairs // (z - a), pairs % (z - a)
                if what == "word":
                    key = w.word[word]
                else:
                    many = w.tri_n[word]
                    key = w.tri[np.arange(many.sum()) + np.repeat(w.tri_at[word] - (np.cumsum(many) - many), many)]
                    doc = np.repeat(doc, many)
                pairs = np.unique(key.astype(np.int64) * (z - a) + doc)
                key, label = pairs // (z - a), y[a:z][pairs % (z - a)]
                pos += np.bincount(key, label, minlength=size)
                neg += np.bincount(key, 1 - label, minlength=size)
            rate = y[ok].mean()
            share = (pos + 4 * rate) / (pos + neg + 4)
            out.append(np.where(pos + neg >= KNOWN, np.log(share / (1 - share)) - np.log(rate / (1 - rate)), 0.0))
        out[0][0] = 0
        return out[0], out[1]

    def scores(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """Logit of every window, chunk after chunk."""
        out = []
        for w in self.parts:
            index, _, full = w.windows()
            out.append(logits(p, w.inputs(p), index, full))
        return np.concatenate(out)

    def leads(self, word: np.ndarray, char: np.ndarray) -> np.ndarray:
        """For every window the greatest lift of its words: where to look first."""
        out = []
        for w in self.parts:
            grams = np.maximum.reduceat(char[w.tri], w.tri_at) if len(w.tri) else np.zeros(0)
            index, _, _ = w.windows()
            out.append(np.append(word[w.word] + grams, -9.0)[index].max(1))
        return np.concatenate(out)

    def batch(self, windows: np.ndarray) -> tuple[Words, np.ndarray]:
        """The words of some windows, and for each window the indices into these."""
        words, rows = [], np.empty((len(windows), SPAN), np.int64)
        total = 0
        for k in np.unique(self.part[windows]):
            mine = np.flatnonzero(self.part[windows] == k)
            w, at = self.parts[k], windows[mine]
            seen, back = np.unique(w.at(self.begin[at], self.local[at]), return_inverse=True)
            back = back.reshape(len(mine), SPAN)
            if seen[0] < 0:
                seen, back = seen[1:], back - 1
            words.append(_some(w, seen))
            rows[mine] = np.where(back >= 0, back + total, -1)
            total += len(seen)
        out = Words.__new__(Words)
        out.word, out.tri, out.tri_n = (np.concatenate([getattr(x, name) for x in words]) for name in ("word", "tri", "tri_n"))
        out.tri_at = np.cumsum(out.tri_n) - out.tri_n
        return out, rows


def fit(rows: list[tuple[str, int]], rounds: int = 8, seed: int = 7) -> dict[str, np.ndarray] | float:
    """Parameters, with the curve's weights under "curve" and the known words' hashes under "vocabulary"; or a constant."""
    y = np.array([v for _, v in rows], float)
    if len(rows) < 12 or min(y.sum(), (1 - y).sum()) < 4:
        return float(y.mean()) if len(rows) else 0.5
    g = np.random.default_rng(seed)
    s = Sample([t for t, _ in rows], KNOWN)
    learn = np.ones(len(y), bool)
    for v in (0, 1):  # every fourth of each class fits the curve
        learn[np.flatnonzero(y == v)[::4]] = False
    p = _fresh(seed, len(s.vocabulary))
    adam = Adam(p, 0.01)
    word, char = s.lifts(y, learn)
    p["word"][:, 0], p["char"][:, 0] = word / 4, char / 4
    score = s.leads(word, char)
    for _ in range(rounds):
        top = np.array([a + int(np.argmax(score[a:b])) for a, b in zip(s.first[:-1], s.first[1:], strict=True)])
        some = s.first[:-1] + g.integers(0, 1 << 30, len(y)) % np.diff(s.first)
        # the clean windows that score highest, whatever their document, teach what toxicity isn't
        clean = np.flatnonzero((learn & (y == 0))[s.doc])
        hard = clean[np.argsort(-score[clean])[: int((learn & (y == 1)).sum())]]
        windows = np.concatenate([top[learn], some[learn & (y == 0)], hard])
        target = y[s.doc[windows]]
        weight = np.where(target == 1, len(target) / (2 * target.sum()), len(target) / (2 * (1 - target).sum()))
        for _ in range(max(2, 1500 // len(windows))):
            order = g.permutation(len(windows))
            for i in range(0, len(order), 128):
                b = order[i : i + 128]
                part, index = s.batch(windows[b])
                grads, dx, _ = gradients(p, part.inputs(p), index, target[b], weight[b])
                grads["word"], grads["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
                np.add.at(grads["word"], part.word, dx[:, :DIM_WORD])
                grads["word"][0] = 0
                np.add.at(grads["char"], part.tri, np.repeat(dx[:, DIM_WORD:] / np.sqrt(part.tri_n)[:, None].astype(F32), part.tri_n, 0))
                adam.step(grads)
        score = s.scores(p)
        adam.rate *= 0.8
    best = np.maximum.reduceat(score, s.first[:-1])
    p["curve"] = logistic(best[~learn, None].astype(float), y[~learn], 1e-2)
    p["vocabulary"] = s.vocabulary
    return p


def _some(w: Words, seen: np.ndarray) -> Words:
    """The distinct words `seen` of w only."""
    part = Words.__new__(Words)
    part.word, part.tri_n = w.word[seen], w.tri_n[seen]
    total = np.cumsum(part.tri_n)
    part.tri = w.tri[np.arange(total[-1] if len(total) else 0) + np.repeat(w.tri_at[seen] - (total - part.tri_n), part.tri_n)]
    return part


def scores(p: dict[str, np.ndarray] | float, column: pa.Array) -> np.ndarray:
    """Score of every whole text of a column."""
    if isinstance(p, float):
        return np.full(len(column), p)
    out = []
    for c in K.chunks(column):
        w = Words(c).known(p["vocabulary"])
        index, doc, full = w.windows()
        z = logits(p, w.inputs(p), index, full)
        out.append(np.maximum.reduceat(z, np.searchsorted(doc, np.arange(c.n))))
    z = np.concatenate(out).astype(float) if out else np.zeros(0)
    # rounded, as the last digits depend on which windows are multiplied together
    return np.round(1 / (1 + np.exp(-np.clip(z * p["curve"][0] + p["curve"][1], -30, 30))), 6)


def score(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    model = fit(sample(docs, labels, "toxic", per_class, SAMPLE_BYTES, ROW_BYTES))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(model, b.column(1)), pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
