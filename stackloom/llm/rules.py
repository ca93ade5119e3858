"""Quality rules as a short-circuit cascade.

A rule is a test over the documents that all earlier rules kept, and works out its own features;
what an earlier rule has worked out (words, hashes) is used again.  On a bounded random sample the
cascade measures every rule's cost per document and the share that it rejects, and orders the
rules by rejection per cost.  The verdict is a conjunction, so the order only saves work: documents
that are rejected leave the chunk as soon as they are half of it.

``keep`` runs all rules in that order, the two of the base among them.  ``score`` has to report the
base counts of every document, so there only the rules beyond the base are a cascade.  Null and
empty texts have no words and fail the base.  Repeated rows are judged each; an empty table gives
an empty result; other columns pass through ``keep`` whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stackloom.llm import kernel as K
from stackloom.llm.spark import tidy

SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 400
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_lower = np.zeros(256, bool)
_lower[97:123] = True
_bang = np.zeros(256, bool)
_bang[list(b"!?")] = True


class Features:
    """Counts of each document of a chunk, each worked out when a rule first asks for it."""

    def __init__(self, c: K.Chunk):
        self.c = c

    def only(self, some: np.ndarray) -> Features:
        """The features of some documents, none worked out yet."""
        c, n = self.c, np.diff(self.c.offs)
        return Features(K.Chunk(c.buf[np.repeat(some, n)], np.concatenate([[0], np.cumsum(n[some])]), slice(0, int(some.sum()))))

    def count(self, flags: np.ndarray) -> np.ndarray:
        return K.per_doc(flags[self.c.buf], self.c.offs)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.c.words(K.NOT_SPACE)

    @cached_property
    def prefix(self) -> np.ndarray:
        return self.c.prefix(False)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return K.per_doc(((self.c.buf & 0xC0) != 0x80) & K.NOT_SPACE[self.c.buf], self.c.offs)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(_symbol)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        start, end, first = self.words
        at, doc = K.spans_of(first, WINDOW)
        keys = K.shingles(K.hash_of(self.prefix, start, end), WINDOW)[at] ^ K.mix(doc.astype(K.U64)) if len(at) else np.zeros(0, K.U64)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edge = np.zeros(len(start) + 1, np.int32)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + WINDOW, -1)
        return K.per_doc(np.cumsum(edge)[:-1] > 0, first)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that equal an earlier one."""
        c, start = self.c, self.words[0]
        breaks = np.flatnonzero(c.buf == 10)
        full = np.diff(c.offs) > 0
        line_start = np.sort(np.concatenate([c.offs[:-1][full], breaks + 1]))
        # a line after a last \n is empty and starts at its document's end
        line_start = np.unique(line_start[line_start < len(c.buf)])
        line_doc = np.searchsorted(c.offs, line_start, "right") - 1
        stop = np.searchsorted(breaks, line_start)
        line_end = np.minimum(np.append(breaks, len(c.buf))[stop], c.offs[line_doc + 1])
        has = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
        line_start, line_end, line_doc = line_start[has], line_end[has], line_doc[has]
        keys = K.mix(K.hash_of(self.prefix, line_start, line_end) + (line_end - line_start).astype(K.U64)) ^ K.mix(line_doc.astype(K.U64))
        _, where = np.unique(keys, return_index=True)
        n_lines = np.bincount(line_doc, minlength=c.n)
        return n_lines, n_lines - np.bincount(line_doc[where], minlength=c.n)

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self.lines[1]


Rule = Callable[[Features], np.ndarray]


def _shouting(f: Features) -> np.ndarray:
    up = f.count(_upper)
    return (up > 20) & (up > 2 * f.count(_lower))


def _word_length(f: Features) -> np.ndarray:
    return (f.word_chars < 2 * f.n_words) | (f.word_chars > 15 * f.n_words)


def _dup_lines(f: Features) -> np.ndarray:
    n, dup = f.lines
    return (n >= 4) & (10 * dup > 3 * n)


#: A document goes if any rule says so.
BASE: dict[str, Rule] = {"few_words": lambda f: f.n_words < MIN_WORDS, "repeats": lambda f: 100 * f.n_repeat_words > MAX_REPEAT_PERCENT * f.n_words}
RULES: dict[str, Rule] = {"shouting": _shouting, "bangs": lambda f: 2 * f.count(_bang) > f.n_words, "symbols": lambda f: 10 * f.n_symbols > 3 * f.n_words, "dup_lines": _dup_lines, "word_length": _word_length}
ALL = BASE | RULES


def plan(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of all rules by rejection per cost, as measured on at most `rows` rows."""
    some = docs.select("text").sample(0.05, 7).limit(rows).toPandas()["text"].tolist()
    if len(some) < rows // 4:  # a small table
        some = docs.select("text").limit(rows).toPandas()["text"].tolist()
    cost = dict.fromkeys(ALL, 1e-9)
    gone = dict.fromkeys(ALL, 0)
    for c in K.chunks(pa.array(some, pa.large_string())):
        for name, rule in ALL.items():
            began = time.perf_counter()
            gone[name] += int(rule(Features(c)).sum())
            cost[name] += time.perf_counter() - began
    return sorted(ALL, key=lambda r: (-(gone[r] + 0.01) / cost[r], r))


def cascade(f: Features, order: list[str], left: np.ndarray | None = None) -> np.ndarray:
    """Which documents of a chunk all rules keep, of those in `left`."""
    left = np.ones(f.c.n, bool) if left is None else left
    row, alive = np.arange(f.c.n), left.copy()
    for name in order:
        if not alive.any():
            break
        if 2 * np.count_nonzero(alive) <= len(alive):
            row, f = row[alive], f.only(alive)
            alive = np.ones(len(row), bool)
        alive &= ~ALL[name](f)
    out = np.zeros(len(left), bool)
    out[row[alive]] = True
    return out


def verdicts(column: pa.Array, order: list[str]) -> dict[str, np.ndarray]:
    """Base counts of every text of a column, base_failed and kept."""
    out: list[dict[str, np.ndarray]] = []
    for c in K.chunks(column):
        f = Features(c)
        got = {k: getattr(f, k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        got["base_failed"] = np.logical_or(*(rule(f) for rule in BASE.values()))
        got["kept"] = cascade(f, [r for r in order if r in RULES], ~got["base_failed"])
        out.append(got)
    return {k: np.concatenate([f[k] for f in out]) for k in out[0]} if out else {}


FEATURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the five base counts, base_failed and kept for each row, in one narrow pass."""
    order = plan(docs)
    names = [x.split()[0] for x in FEATURES.split(", ")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = verdicts(b.column(1), order)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[k]) for k in names)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, {FEATURES}")


def keep(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose text every rule keeps."""
    order = plan(docs)
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(np.concatenate([cascade(Features(c), order) for c in K.chunks(b.column(at))])))

    return docs.mapInArrow(run, docs.schema)
