"""Compression classifier of quality.

Two zstandard dictionaries are built, from good and from bad labelled texts.  A text is
compressed with both, in pieces of ``PIECE`` bytes so that the dictionary, not the text itself,
decides on long texts too; every piece counts.  The difference of the two compressed sizes over
the text's length goes through a logistic curve fitted to labelled texts: that is the score.

Learning takes whole texts: of each class at most ``SAMPLE`` labelled rows and ``SAMPLE_BYTES``
bytes, chosen by hash among those whose crc32 of doc_id modulo 5 isn't 0; rows over ``ROW_BYTES``
are left out.  Null and empty texts get the score that the curve has at difference 0.  Repeated
rows are scored each; with fewer than 12 labelled texts, or fewer than 4 of a class, every score
is the share of good labels (0.5 without labels).  Where zstandard finds too little text to choose
from, the end of the class's texts themselves is its dictionary.  Labels with a null id or another value than 0 and 1 teach nothing; a doc_id
(bigint) may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackloom.llm import kernel as K
from stackloom.llm.spark import tidy

SAMPLE = 1500
SAMPLE_BYTES = 6 << 20
ROW_BYTES = 256 << 10
PIECE = 256
DICTIONARY = 64 << 10
LEVEL = 3
FOLDS = 5
CUTOFF = 0.3


def held_out(doc_id: F.Column | str = "doc_id") -> F.Column:
    """Whether crc32 of doc_id as text is divisible by the number of folds; a null id isn't held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int, row_bytes: int) -> list[tuple[str, int]]:
    """Whole labelled texts as (text, label): of each class at most per_class rows and most_bytes bytes, chosen by hash.

    Rows over row_bytes are left out as a whole; labels without an id or another value than 0 and 1 are too.
    """
    ok = labels.where(F.col("doc_id").isNotNull() & ~held_out() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    order = F.crc32(F.concat(F.lit("s"), F.col("doc_id").cast("string")).cast("binary"))
    ids = None
    for y in (0, 1):
        some = ok.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionAll(some)
    chosen = {(r["doc_id"], r["y"]) for r in ids.collect()}  # at most 2 * per_class rows
    known = docs.sparkSession.createDataFrame(sorted(chosen), "doc_id bigint, y int")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= row_bytes).join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    # a running sum over at most per_class rows of each class
    mine = Window.partitionBy("y").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.sum(F.octet_length("text")).over(mine)).where(F.col("before") <= most_bytes)
    return [(r["text"], r["y"]) for r in sorted(rows.select("doc_id", "y", "text").collect(), key=lambda r: (r["doc_id"], r["y"]))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve (the last is the constant), by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    constant: float = 0.0

    def open(self) -> None:
        """Makes the compressors, which don't travel to executors."""
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.tools = make(self.good), make(self.bad)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tools"}

    def difference(self, raw: bytes) -> float:
        """How much smaller the good dictionary makes a text than the bad one, over its length."""
        g, b = self.tools
        size_g = size_b = 0
        for i in range(0, len(raw), PIECE):
            x = raw[i : i + PIECE]
            size_g += len(g.compress(x))
            size_b += len(b.compress(x))
        return (size_b - size_g) / max(1, len(raw))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(100 * x * self.slope + self.constant, -30, 30)))


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return d


def _train(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE) if len(t[i : i + PIECE]) >= 64]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself is the dictionary
        return b"".join(texts)[-DICTIONARY:]


def fit(rows: list[tuple[str, int]]) -> Model | float:
    """Dictionaries from two thirds of the sample, the curve from the rest of it; or a constant."""
    y = np.array([v for _, v in rows])
    if len(rows) < 12 or min((y == 0).sum(), (y == 1).sum()) < 4:
        return float(y.mean()) if len(rows) else 0.5
    raw = [t.encode() for t, _ in rows]
    part = np.arange(len(rows)) % 3 == 0
    m = Model(*[_train([r for r, v, p in zip(raw, y, part, strict=True) if v == k and not p]) for k in (1, 0)])
    m.open()
    x = np.array([m.difference(r) for r, p in zip(raw, part, strict=True) if p])
    m.slope, m.constant = (float(v) for v in logistic(100 * x[:, None], y[part].astype(float)))
    return m


def score(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    model = fit(sample(docs, labels, "quality", per_class, SAMPLE_BYTES, ROW_BYTES))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if isinstance(model, Model):
            model.open()
        for b in batches:
            if isinstance(model, Model):
                x = np.zeros(b.num_rows)
                for c in K.chunks(b.column(1)):
                    raw = c.buf.tobytes()
                    x[c.rows] = [model.difference(raw[a:z]) for a, z in zip(c.offs[:-1].tolist(), c.offs[1:].tolist(), strict=True)]
                s = model.scores(x)
            else:
                s = np.full(b.num_rows, model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
