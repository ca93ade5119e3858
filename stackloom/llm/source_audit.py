"""Source divergence audit with mergeable radix tries.

How differently the sources of a language use words.  Terms are runs of letters (ASCII letters,
A-Z lower-cased, and all of non-ASCII).  A language keeps the terms of at least MIN_DOCS of its
documents; each of its sources, and the language itself, gives each kept term the smoothed share

    p = 1 + floor(10^9 * (count + 5) / (N + 5 * V))

in whole numbers, N being its occurrences of the V kept terms.  ``pair``: for each two sources the
sum of |p - q|; ``term``: for each source the TOP terms whose p exceeds the language's q by most.

1. Each task counts its texts chunk by chunk; what its chunks found is added up, and put into a byte
   trie per language whose leaves hold documents, and occurrences by source.  Tries of COUNTERS
   counters are traversed and let go, so memory is bounded.
2. Leaves are dealt out by ranges of (language, term): a task gets all leaves below some prefixes.
   Those of one term arrive together; terms of too few documents go, the others are merged in a trie
   of at most BLOCK terms and leave it in UTF-8 order as a numbered block.
3. A block of kept terms meets the sources of its language.  Traversed in UTF-8 order it gives
   partial sums of each pair and each source's best TOP terms, equal differences in order of the term.
   Sums are added up and candidates ranked in Spark.

A hot source or language is spread over tasks by its documents in step 1 and by terms in steps 2 and
3.  A group's candidates are at most TOP a block.  The result has a row for every ordered pair of
sources of a language, so a language's sources are taken to fit into memory as numbers.

Null text, lang and source count as empty strings; sources of a language without any term, and
languages without kept terms (their pairs have value 0), are there; repeated rows are documents of
their own; a very long text is one piece of work; an empty table gives no rows; other columns are
ignored, whatever their names.  Equal terms are told by two independent 64-bit hashes within a
chunk and by their bytes everywhere else.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm import kernel as K
from stackloom.llm.spark import cut, parts, tidy

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
COUNTERS, BLOCK, CELLS = 800_000, 4096, 1 << 20

OTHER_CODE = K.stream(0x1F3, 256) | K.U64(1)
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


class Trie:
    """Radix trie over bytes, STRIDE of them an edge: a node maps the next bytes to a node or to a leaf.

    A leaf is (bytes that no other term shares, row number or list of them); it becomes a node when
    a second term comes by.  A term that ends in between has a shorter last edge, which sorts
    first.  Counters stand in the rows of an Arrow table, so merging tries is adding up row numbers.
    """

    STRIDE = 4

    def __init__(self) -> None:
        self.root: dict = {}
        self.leaves = 0

    def add(self, term: bytes, row: int) -> None:
        node, at, step = self.root, 0, self.STRIDE
        while True:
            edge = term[at : at + step]
            at += step
            child = node.get(edge)
            if child is None:
                node[edge] = (term[at:], row)
                self.leaves += 1
                return
            if type(child) is dict:
                node = child
                continue
            rest, rows = child
            if rest == term[at:]:
                if isinstance(rows, list):
                    rows.append(row)
                else:
                    node[edge] = (rest, [rows, row])
                return
            node[edge] = below = {rest[:step]: (rest[step:], rows)}
            node = below

    def merge(self, other: Trie, shift: int = 0) -> None:
        """Adds the leaves of a trie whose rows stand `shift` further down."""
        for term, rows in other.walk():
            for r in rows:
                self.add(term, r + shift)

    def walk(self) -> Iterator[tuple[bytes, list[int]]]:
        """Terms and rows in order of bytes, which in UTF-8 is that of code points."""
        stack = [(b"", self.root)]
        while stack:
            before, child = stack.pop()
            if type(child) is dict:
                stack.extend([(before + edge, child[edge]) for edge in sorted(child, reverse=True)])
            else:
                yield before + child[0], child[1] if isinstance(child[1], list) else [child[1]]


def traversal(terms: pa.ChunkedArray) -> pa.Array:
    """Row numbers of different terms in the order of their trie."""
    gc.disable()  # nodes form no cycles, and looking for some takes longer than all the rest
    try:
        trie = Trie()
        for piece in terms.chunks:
            shift = trie.leaves
            for start in range(0, len(piece), 10_000):
                for row, term in enumerate(piece[start : start + 10_000].to_pylist(), shift + start):
                    trie.add(term, row)
        return pa.array((rows[0] for _, rows in trie.walk()), pa.int64())
    finally:
        gc.enable()


LEAF = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"
_LEAF = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


FOUND = pa.schema([("group", pa.int64()), ("term", pa.binary()), ("docs", pa.int64()), ("n", pa.int64())])


def chunk_terms(c: K.Chunk, group: np.ndarray) -> pa.Table:
    """Distinct (group, term) of a chunk, with the documents and occurrences of each."""
    start, end, first = c.words(LETTER)
    if not len(start):
        return FOUND.empty_table()
    h = K.hash_of(c.prefix(True), start, end)
    # a second hash, of other codes and the length, keeps different terms of equal hash apart
    folded = K.FOLD[c.buf]
    other = np.zeros(len(folded) + 1, K.U64)
    np.cumsum(OTHER_CODE[folded] * K.powers(len(folded))[0][: len(folded)], dtype=K.U64, out=other[1:])
    h2 = K.hash_of(other, start, end) + (end - start).astype(K.U64)
    doc = np.repeat(np.arange(c.n), np.diff(first))
    g = group[doc]
    # equal ones stand together, in the order of their documents
    order = np.argsort(h + h2 * K.U64(0x9E3779B97F4A7C15) + K.mix(g.astype(K.U64)), kind="stable")
    h, h2, g, doc = h[order], h2[order], g[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (g[1:] != g[:-1])
    new_doc = new.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(h)))
    docs = np.add.reduceat(new_doc.astype(np.int64), at)
    lo, size = start[order[at]], (end - start)[order[at]]
    stop = np.cumsum(size)
    place = np.arange(stop[-1]) + np.repeat(lo - stop + size, size)
    terms = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, stop).astype(np.int32)), pa.py_buffer(folded[place])])
    return pa.Table.from_arrays([pa.array(g[at]), terms, pa.array(docs), pa.array(n)], schema=FOUND)


def added_up(found: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(found).group_by(["group", "term"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
    return t.select(["group", "term", "docs_sum", "n_sum"]).rename_columns(FOUND.names)


def leaves(docs: DataFrame, most: int = COUNTERS) -> DataFrame:
    """lang, term, docs, sources, counts: what the tries of the tasks hold, in the order of a traversal."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], int] = {}
        found: list[pa.Table] = []
        held = 0
        for b in batches:
            pairs = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            group = np.array([known.setdefault(p, len(known)) for p in pairs], np.int64)
            for c in K.chunks(b.column(0), 2 * K.CHUNK):
                found.append(chunk_terms(c, group[c.rows]))
                held += found[-1].num_rows
                if held > most:
                    found = [added_up(found)]
                    held = found[0].num_rows
                    if held > most // 2:
                        yield from walked(found, known)
                        found, held = [], 0
        if held:
            yield from walked(found, known)

    def walked(found: list[pa.Table], known: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
        t, names = added_up(found), list(known)
        g = t["group"].to_numpy()
        of = pa.array([lang for lang, _ in names]).dictionary_encode()
        t = t.append_column("lang", pa.array(of.indices.to_numpy()[g])).append_column("source", pa.array([s for _, s in names]).take(pa.array(g)))
        t = t.group_by(["lang", "term"], use_threads=False).aggregate([("docs", "sum"), ("source", "list"), ("n", "list")]).combine_chunks()
        del found[:]
        for k, lang in enumerate(of.dictionary.to_pylist()):
            own = t.filter(pc.equal(t["lang"], k))
            own = own.take(traversal(own["term"]))
            out = pa.Table.from_arrays([pa.array([lang] * own.num_rows, pa.string()), own["term"].cast(pa.string()), own["docs_sum"], own["source_list"].cast(pa.list_(pa.string())), own["n_list"].cast(pa.list_(pa.int64()))], schema=_LEAF)
            yield from out.combine_chunks().to_batches(10_000)

    return rows.mapInArrow(run, LEAF)


def _merged(rows: pa.Table) -> pa.Table:
    """Rows of some terms as one row for each, in UTF-8 order, by a trie."""
    trie = Trie()
    for row, term in enumerate(rows["term"].to_pylist()):
        trie.add(term.encode(), row)
    at, of, terms = [], [], []
    for term, own in trie.walk():
        at += own
        of += [len(terms)] * len(own)
        terms.append(term.decode())
    rows = rows.take(pa.array(at, pa.int64())).combine_chunks()
    of = np.array(of, np.int64)
    many = np.repeat(of, pc.list_value_length(rows["sources"]).to_numpy())
    flat = pa.table({"k": many, "source": pc.list_flatten(rows["sources"]), "n": pc.list_flatten(rows["counts"])})
    flat = flat.group_by(["k", "source"], use_threads=False).aggregate([("n", "sum")]).group_by("k", use_threads=False).aggregate([("source", "list"), ("n_sum", "list")]).sort_by("k")
    docs = np.bincount(of, rows["docs"].to_numpy().astype(float), len(terms)).astype(np.int64)
    return pa.Table.from_arrays([rows["lang"].combine_chunks()[: len(terms)], pa.array(terms), pa.array(docs), flat["source_list"].cast(pa.list_(pa.string())), flat["n_sum_list"].cast(pa.list_(pa.int64()))], schema=_LEAF)


def kept_terms(found: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK) -> DataFrame:
    """The leaves of all tries merged by ranges of prefixes: terms of enough documents, with a block number."""
    ranges = found.repartitionByRange(parts(found.sparkSession), "lang", "term").sortWithinPartitions("lang", "term").withColumn("range", F.spark_partition_id())
    schema = _LEAF.append(pa.field("block", pa.int64()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None  # rows of the newest term, which may go on
        held: list[pa.Table] = []  # rows of kept terms of one language
        many, number, place = 0, 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, many, number
            out = _merged(pa.concat_tables(held))
            held, many, number = [], 0, number + 1
            yield from out.append_column("block", pa.array([(place << 32) + number] * out.num_rows, pa.int64())).cast(schema).combine_chunks().to_batches()

        def terms(t: pa.Table, last: bool) -> Iterator[pa.Table]:
            """The rows of each language's terms of enough documents; the newest term waits unless it is the last."""
            nonlocal open_
            t = (t if open_ is None else pa.concat_tables([open_, t])).combine_chunks()
            lang, term = t["lang"].combine_chunks(), t["term"].combine_chunks()
            n = t.num_rows
            new = np.ones(n, bool)
            turn = np.zeros(n, bool)
            turn[1:] = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = turn[1:] | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            stop = n if last else int(first[-1])
            open_ = None if last else t.slice(stop)
            first = first[first < stop]
            if not len(first):
                return
            enough = np.add.reduceat(t["docs"].to_numpy()[:stop], first) >= min_docs
            keep = np.repeat(enough, np.diff(np.append(first, stop)))
            for part in np.split(np.arange(stop), np.flatnonzero(turn[:stop])):
                rows = part[keep[part]]
                yield t.take(pa.array(rows)).append_column("new", pa.array(new[rows]))

        def blocks(t: pa.Table, last: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal many
            for own in terms(t, last):
                if held and own.num_rows and own["lang"][0] != held[0]["lang"][0]:
                    yield from done()
                starts = np.flatnonzero(own["new"].to_numpy(zero_copy_only=False))
                own = own.drop_columns("new")
                while len(starts):
                    fit = block - many
                    cut_at = own.num_rows if len(starts) <= fit else int(starts[fit])
                    held.append(own.slice(0, cut_at))
                    many += min(fit, len(starts))
                    own, starts = own.slice(cut_at), starts[fit:] - cut_at
                    if many == block or sum(t.num_rows for t in held) >= COUNTERS:
                        yield from done()

        for b in batches:
            if b.num_rows:
                place = b.column(5)[0].as_py()
                yield from blocks(pa.Table.from_batches([b]).drop_columns("range"))
        if open_ is not None:
            yield from blocks(_LEAF.empty_table(), True)
        if held:
            yield from done()

    return ranges.mapInArrow(run, LEAF + ", block bigint")


def share(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / below) for count <= below, digit group by digit group, so that nothing overflows."""
    out, rest = np.zeros(np.broadcast(count, below).shape, np.int64), count % below
    out += count // below
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


PART = "lang string, source string, part string, item string, value bigint"
_PART = pa.schema([(c, pa.int64() if c == "value" else pa.string()) for c in ("lang", "source", "part", "item", "value")])


def _compare(top: int):
    """For a block of kept terms and the sources of its language: partial sums of pairs, and the best terms of each source."""

    def run(terms: pa.Table, groups: pa.Table) -> pa.Table:
        if not terms.num_rows or not groups.num_rows:
            return _PART.empty_table()
        lang = terms["lang"][0].as_py()
        names = groups["source"].to_pylist()
        index = {s: k for k, s in enumerate(names)}
        below = groups["below"].to_numpy()
        everyone = groups["lang_below"][0].as_py()
        order = traversal(terms["term"].cast(pa.binary()))
        words = terms["term"].take(order).to_pylist()
        sources, counts = (terms[c].take(order).to_pylist() for c in ("sources", "counts"))
        m, step = len(names), max(1, CELLS // len(names))
        sums = np.zeros((m, m), np.int64)
        best: list[list[tuple[int, int]]] = [[] for _ in names]
        for lo in range(0, len(words), step):
            hi = min(len(words), lo + step)
            n = np.zeros((m, hi - lo), np.int64)
            for k in range(lo, hi):
                for s, c in zip(sources[k], counts[k], strict=True):
                    n[index[s], k - lo] = c
            p = share(n + SMOOTH, below[:, None])
            q = share(n.sum(0) + SMOOTH, np.int64(everyone))
            for a in range(m):
                sums[a] += np.abs(p - p[a]).sum(1)
                over = np.flatnonzero((n[a] > 0) & (p[a] > q))
                gain = p[a][over] - q[over]
                # stable: equal gains stay in the order of the terms
                first = np.argsort(-gain, kind="stable")[:top]
                best[a] = sorted([*best[a], *((-int(gain[i]), lo + int(over[i])) for i in first)])[:top]
        rows = [(lang, names[a], "pair", names[b], int(sums[a, b])) for a in range(m) for b in range(m) if a != b]
        rows += [(lang, names[a], "term", words[k], -v) for a in range(m) for v, k in best[a]]
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(_PART.types)], schema=_PART)

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of each source against the others and against its language."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = cut(kept_terms(cut(leaves(docs)), min_docs))
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = groups.join(counted, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["n", "v"])
    whole = groups.groupBy("lang").agg((F.sum("n") + SMOOTH * F.first("v")).alias("lang_below"))
    groups = cut(groups.join(whole, "lang").select("lang", "source", (F.col("n") + SMOOTH * F.col("v")).alias("below"), "lang_below"))
    met = kept.select("lang", "block").distinct().join(groups, "lang").withColumnsRenamed({"lang": "of", "block": "at"})
    parted = cut(kept.groupBy("lang", "block").cogroup(met.groupBy("of", "at")).applyInArrow(_compare(top), PART))
    others = groups.select(F.col("lang").alias("of"), F.col("source").alias("item"))
    pairs = groups.join(others, (F.col("lang") == F.col("of")) & (F.col("source") != F.col("item")))
    sums = parted.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    ordered = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = parted.where("part = 'term'").withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ordered)).unionByName(terms)


def oracle(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    """The contract in DuckDB's SQL."""
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
df AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= {min_docs}),
groups AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY lang, source, term),
c AS (SELECT g.lang AS lang, g.source AS source, df.term AS term, coalesce(occ.c, 0) AS c FROM groups g JOIN df ON g.lang = df.lang LEFT JOIN occ ON occ.lang = g.lang AND occ.source = g.source AND occ.term = df.term),
p AS (SELECT lang, source, term, c, 1 + (CAST({SCALE} AS HUGEINT) * (c + {SMOOTH})) // (sum(c) OVER w + {SMOOTH} * count(*) OVER w) AS p FROM c WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (CAST({SCALE} AS HUGEINT) * (c + {SMOOTH})) // (sum(c) OVER w + {SMOOTH} * count(*) OVER w) AS q FROM l WINDOW w AS (PARTITION BY lang)),
sums AS (SELECT a.lang AS lang, a.source AS source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT p.lang, source, 'term', p.term, p - q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= {top}"""
