"""N-gram Jaccard self-join with count-vector R-trees: linked documents and their components.

A document's set holds the hashes of its distinct shingles of five words (lower case, split at
ASCII white space); fewer words are one shingle.  Two documents link when
100 * |A and B| >= 75 * |A or B|, judged on whole sets.

1. Documents with equal sets are one class; everything below works on classes.
2. Candidates.  A link needs an overlap of at least three quarters of either set, so two linked
   sets share one of their first n - ceil(0.75 n) + 1 shingles in any common order.  The order
   puts shingles that a fixed-width count sketch of the corpus finds rare first, so common
   passages hardly ever bring documents together.  Postings travel as packed arrays.  Classes
   with one posting form a run; equal runs are one.
3. A class's point counts its shingles by group of their hashes.  The sum of coordinate minima
   bounds the overlap of two sets; an R-tree over the points of a group, with the greatest
   coordinates and the least size of each node, finds all points whose bound allows a link.
   Survivors are verified on the sets.
4. No run is expanded into all its pairs.  The runs that have the same leader, the class of theirs
   that is in most runs, are one group with one tree.  First each group's leader asks for the
   others.  Then only groups whose classes are not in one component are searched again, from those
   classes that are outside the group's largest component against all of the group.  Nothing that
   could link two components is left out, so components are exact.  Large groups are dealt out in
   salted parts.

Null and empty texts have an empty set and link with nothing.  Repeated rows are in one class; a
null doc_id (bigint) names no component.  An empty table gives an empty result.  Other columns
pass through ``keep_one`` whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import kernel as K
from stackloom.llm.spark import components, cut, let_go, parts, tidy, unused

SHINGLE = 5
PERCENT = 75
#: Cells of the corpus sketch, whatever the corpus: a task's part takes a few MB when packed.
SKETCH_BITS = 22
SKETCH = 1 << SKETCH_BITS
SKETCH_BLOCK = 1 << 14
POSTINGS_A_PART = 1_500_000
FLUSH = 1_500_000
PART_ROWS = 1000
BROADCAST_ROWS = 400_000
LEAF = 16


def sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every text of a column."""
    for c in K.chunks(column):
        start, end, first = c.words(K.NOT_SPACE)
        h = K.hash_of(c.prefix(True), start, end)
        sh = K.shingles(h, SHINGLE)
        for i in range(c.n):
            a, z = int(first[i]), int(first[i + 1])
            if z - a >= SHINGLE:
                yield c.rows.start + i, np.unique(sh[a : z - SHINGLE + 1])
            elif z > a:
                yield c.rows.start + i, K.shingles(h[a:z], z - a) ^ K.U64(z - a)
            else:
                yield c.rows.start + i, np.zeros(0, K.U64)


def class_of(s: np.ndarray) -> int:
    """64-bit id of a set: equal for equal sets."""
    total = np.add.reduce(K.mix(s ^ K.U64(0x1234567)), dtype=K.U64)
    return int(K.mix(np.array([total], K.U64) + K.U64(len(s))).view(np.int64)[0]) if len(s) else 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def least_overlap(n: int | np.ndarray, m: int | np.ndarray) -> int | np.ndarray:
    """The overlap below which sets of n and m can't link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def groups_for(n: int) -> int:
    """Coordinates of a point: a power of two, half of n at least.

    Linked sizes differ by a third at most, so their numbers of coordinates by one doubling.
    """
    g = 32
    while 2 * g < n:
        g *= 2
    return g


def point(s: np.ndarray) -> np.ndarray:
    g = groups_for(len(s))
    return np.bincount((s & K.U64(g - 1)).astype(np.int64), minlength=g)


def packed(p: np.ndarray) -> bytes:
    """A point as bytes: counts are small, so few bits of each are left."""
    kind = b"1" if p.max() < 256 else b"4"
    return kind + zlib.compress(p.astype("<u" + kind.decode()).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), "<u" + raw[:1].decode())


def fold(p: np.ndarray, g: int) -> np.ndarray:
    return p.reshape(-1, g).sum(0)


class RTree:
    """Points packed by sort-tile-recursion; each node knows its greatest coordinates and its sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.order = self._tile(np.arange(len(points)), 0)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        upper, low, high = points[self.order], sizes[self.order], sizes[self.order]
        while len(upper) > 1:
            cuts = np.arange(0, len(upper), LEAF)
            upper, low, high = np.maximum.reduceat(upper, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((upper, low, high))

    def _tile(self, rows: np.ndarray, depth: int) -> np.ndarray:
        if len(rows) <= LEAF or depth >= 3:
            return rows
        key = self.sizes[rows] if depth == 0 else self.points[rows, np.argmax(self.points[rows].var(0))]
        rows = rows[np.argsort(key, kind="stable")]
        width = max(LEAF, -(-int(np.sqrt(len(rows) * LEAF)) // LEAF) * LEAF)
        return np.concatenate([self._tile(rows[i : i + width], depth + 1) for i in range(0, len(rows), width)])

    def _fits(self, q: np.ndarray, n: int, upper: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        bound = np.minimum(upper, q).sum(1)
        return (bound >= least_overlap(n, low)) & (100 * high >= PERCENT * n) & (100 * n >= PERCENT * low)

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Indices of all points whose bound with q allows a link."""
        at = np.arange(1)
        for upper, low, high in self.levels[::-1]:
            at = at[at < len(upper)]
            at = at[self._fits(q, n, upper[at], low[at], high[at])]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = self.order[at[at < len(self.order)]]
        return at[self._fits(q, n, self.points[at], self.sizes[at], self.sizes[at])]


class Forest:
    """A tree for each number of coordinates, of the points that have it and, folded, those with twice as many."""

    def __init__(self, points: list[np.ndarray], sizes: list[int]):
        self.points, self.sizes = points, sizes
        self.own = np.array([len(p) for p in points])
        self.trees: dict[int, tuple[RTree, np.ndarray]] = {}
        for g in sorted({*self.own.tolist()}):
            rows = np.flatnonzero((self.own == g) | (self.own == 2 * g))
            self.trees[g] = RTree(np.stack([fold(points[i].astype(np.int64), g) for i in rows]), np.array([sizes[i] for i in rows])), rows

    def search(self, i: int) -> np.ndarray:
        """Indices of all points whose bound with point i allows a link, itself among them."""
        q, g, n = self.points[i].astype(np.int64), int(self.own[i]), self.sizes[i]
        tree, rows = self.trees[g]
        found = rows[tree.search(q, n)]
        if g // 2 in self.trees:
            tree, rows = self.trees[g // 2]
            lower = rows[tree.search(fold(q, g // 2), n)]
            found = np.concatenate([found, lower[self.own[lower] == g // 2]])
        return found


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n, c) for rows; (block, packed counts) of the task's sketch."""
    sketch = np.zeros(SKETCH, np.uint32)
    names = ["doc_id", "n", "c", "block", "counts"]
    for b in batches:
        n, c = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for i, s in sets_of(b.column(1)):
            n[i], c[i] = len(s), class_of(s)
            np.add.at(sketch, cell(s), np.uint32(1))
        none = pa.nulls(b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(c), none.cast(pa.int32()), none.cast(pa.binary())], names)
    busy = [k for k in range(SKETCH // SKETCH_BLOCK) if sketch[k * SKETCH_BLOCK : (k + 1) * SKETCH_BLOCK].any()]
    none = pa.nulls(len(busy), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.array(busy, pa.int32()), pa.array([packed(sketch[k * SKETCH_BLOCK : (k + 1) * SKETCH_BLOCK]) for k in busy], pa.binary())], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0) + unpacked(raw).astype(np.int64)
    levels = [(8 * np.log2(v + 1)).astype(np.uint8).tobytes() for v in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["block", "levels"])


def sketch_levels(survey: DataFrame) -> np.ndarray:
    """For each cell of the corpus sketch the log of its count in eighths: SKETCH bytes, whatever the corpus."""
    rows = survey.where("block is not null").select("block", "counts").repartition(parts(survey.sparkSession), "block").mapInArrow(tidy(_summed), "block int, levels binary")
    levels = np.zeros(SKETCH, np.uint8)
    for r in rows.toLocalIterator():  # SKETCH bytes in all
        levels[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["levels"], np.uint8)
    return levels


def cell(s: np.ndarray) -> np.ndarray:
    return (s >> K.U64(64 - SKETCH_BITS)).astype(np.int64)


def prefix(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles of which linked sets share one, as places in the common order."""
    order = levels[cell(s)].astype(K.U64) << K.U64(56) | s & K.U64((1 << 56) - 1)
    k = len(s) - -(-PERCENT * len(s) // 100) + 1
    return np.sort(np.partition(order, k - 1)[:k]) if k < len(order) else order


def _postings(levels: np.ndarray, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        classes: list[int] = []
        seen: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            k = K.mix(np.concatenate(keys))
            c = np.repeat(np.array(classes, np.int64), [len(x) for x in keys])
            part = (k % K.U64(many)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, k, c = part[order], (k[order] >> K.U64(32)).astype("<u4"), c[order]
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            cut_ = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]], pa.int32()), pa.array([k[a:z].tobytes() for a, z in cut_], pa.binary()), pa.array([c[a:z].tobytes() for a, z in cut_], pa.binary())], ["part", "keys", "classes"])

        for b in batches:
            for _, s in sets_of(b.column(0)):
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                keys.append(prefix(s, levels))
                classes.append(c)
                size += len(keys[-1])
                if size >= FLUSH:
                    yield flush()
                    keys, classes, size = [], [], 0
        if keys:
            yield flush()

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed postings of whole parts -> (run, c) for each run of two classes or more; equal runs once."""
    keys, classes = [], []
    for b in batches:
        for p, k, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            keys.append(K.U64(p) << K.U64(32) | np.frombuffer(k, "<u4").astype(K.U64))
            classes.append(np.frombuffer(c, np.int64))
    if not keys:
        return
    key, c = np.concatenate(keys), np.concatenate(classes)
    order = np.lexsort((c, key))
    key, c = key[order], c[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
    key, c = key[fresh], c[fresh]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    many = np.diff(edge)
    busy = np.flatnonzero(many > 1)
    total = np.concatenate([[K.U64(0)], np.cumsum(K.mix(c.view(K.U64)), dtype=K.U64)])
    ids = K.mix(total[edge[1:]] - total[edge[:-1]] + many.astype(K.U64))
    _, one = np.unique(ids[busy], return_index=True)
    busy = busy[one]
    for lo in range(0, len(busy), 2000):
        some = busy[lo : lo + 2000]
        rows = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in some])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], many[some]).view(np.int64)), pa.array(c[rows])], ["run", "c"])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, text) -> (c, n, point); a text of another class (a doc_id that isn't unique) is left out."""
    for b in batches:
        rows = [(c, len(s), point(s)) for c, s in _of_class(b)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([packed(r[2]) for r in rows], pa.binary())], ["c", "n", "point"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, text) -> (c, set)."""
    for b in batches:
        rows = [(c, s.astype("<u8").tobytes()) for c, s in _of_class(b)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["c", "set"])


def _of_class(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    want = b.column(0).to_pylist()
    for i, s in sets_of(b.column(1)):
        if class_of(s) == want[i]:
            yield want[i], s


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Consecutive rows with equal first two columns, as lists of the whole rows."""
    rows: list[tuple] = []
    for b in batches:
        for r in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if rows and r[:2] != rows[0][:2]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (a, salt, c, set), that of a among them -> links (a, b)."""
    for rows in _groups(batches):
        a = rows[0][0]
        mine = next((np.frombuffer(r[3], "<u8") for r in rows if r[2] == a), None)
        hit = [] if mine is None else [r[2] for r in rows if r[2] != a and linked(mine, np.frombuffer(r[3], "<u8"))]
        if hit:
            yield pa.RecordBatch.from_arrays([pa.array([a] * len(hit), pa.int64()), pa.array(hit, pa.int64())], ["a", "b"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (g, salt, c, n, point, component, asks) -> pairs (a, b) of different components whose points allow a link."""
    seen: set[tuple[int, int]] = set()
    for rows in _groups(batches):
        forest = Forest([unpacked(r[4]) for r in rows], [r[3] for r in rows])
        pairs = set()
        for k, q in enumerate(rows):
            if q[6]:
                for i in forest.search(k):
                    if rows[i][5] != q[5]:
                        pairs.add((min(q[2], rows[i][2]), max(q[2], rows[i][2])))
        pairs -= seen  # runs of one task often hold the same pair
        if len(seen) < 1_000_000:
            seen |= pairs
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])


def searched(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs that R-trees over groups g of rows (g, c, component, asks, m: the group's size) leave.

    A class that asks goes to all parts of its group, any other to one.
    """
    salts = F.ceil(F.col("m") / PART_ROWS).cast("int")
    part = F.when(F.col("asks"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("c"), salts).cast("int")))
    dealt = rows.select("g", "c", "component", "asks", F.explode(part).alias("salt"))
    full = dealt.join(points, "c").select("g", "salt", "c", "n", "point", "component", "asks")
    return full.repartition(parts(rows.sparkSession), "g", "salt").sortWithinPartitions("g", "salt").mapInArrow(tidy(_search), "a bigint, b bigint").distinct()


def stars_of(members: DataFrame) -> DataFrame:
    """(g, c) once each: the classes of all runs that g leads, without itself.

    A run's leader is its class that is in most runs, the text that copies were made from if it is
    there; the runs of near copies share it, so these are one group.
    """
    degree = members.groupBy("c").agg(F.count("*").alias("d"))
    top = members.join(degree, "c").groupBy("run").agg(F.max(F.struct("d", "c")).alias("top")).select("run", F.col("top.c").alias("g"))
    return members.join(top, "run").where("g <> c").select("g", "c").distinct()


def led(stars: DataFrame) -> DataFrame:
    """For searched(): each group's leader asks for all others."""
    size = stars.groupBy("g").agg(F.count("*").alias("m"))
    both = stars.join(size, "g").select("g", "c", F.lit(False).alias("asks"), "m").unionAll(size.select("g", F.col("g").alias("c"), F.lit(True).alias("asks"), "m"))
    return both.select("g", "c", F.col("c").alias("component"), "asks", "m")


def crossing(stars: DataFrame) -> DataFrame:
    """For searched(): in groups (g, c, component) of several components all ask but those of the largest one."""
    share = stars.groupBy("g", "component").agg(F.count("*").alias("k"))
    top = share.groupBy("g").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("kinds"), F.sum("k").alias("m")).where("kinds > 1")
    return stars.join(top, "g").select("g", "c", "component", (F.col("component") != F.col("top.component")).alias("asks"), "m")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked among distinct pairs (a, b) of classes, by their whole sets."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("salts"))
    rows = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("c"))
    lead = many.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("c"))
    rows = rows.unionAll(lead)
    sets = texts_of(rows.select("c").distinct(), classes, docs).mapInArrow(tidy(_sets), "c bigint, set binary")
    full = rows.join(sets, "c").select("a", "salt", "c", "set")
    return full.repartition(parts(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt").mapInArrow(tidy(_verify), "a bigint, b bigint")


def texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(c, text) of one document of each wanted class; ids are broadcast only up to BROADCAST_ROWS."""
    wanted = cut(wanted.join(classes, "c").select("c", "rep"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("rep"))).select("c", "text")


def survey_of(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", "text").mapInArrow(tidy(_survey), "doc_id bigint, n bigint, c bigint, block int, counts binary"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) for every row."""
    spark = docs.sparkSession
    survey = survey_of(docs)
    levels = sketch_levels(survey)
    rows = survey.where("block is null").select("doc_id", "n", "c")
    classes = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    total = rows.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    many = max(parts(spark), int(total) // POSTINGS_A_PART + 1)
    postings = docs.select("text").mapInArrow(tidy(_postings(levels, many)), "part int, keys binary, classes binary")
    members = cut(postings.repartition(many, "part").mapInArrow(tidy(_runs), "run bigint, c bigint").distinct())

    let_go(spark)
    stars = cut(stars_of(members))
    points = cut(texts_of(stars.select("c").unionAll(stars.select("g")).distinct(), classes, docs).mapInArrow(tidy(_points), "c bigint, n bigint, point binary"))
    links = cut(verified(cut(searched(led(stars), points)), classes, docs))
    known = components(links)
    # all pairs with a leader are settled, so a group of one more class is done
    left = stars.join(known, F.col("c") == F.col("node"), "left").select("g", "c", F.coalesce("component", "c").alias("component"))
    more = cut(verified(cut(searched(crossing(cut(left)), points)), classes, docs))
    final = components(links.unionAll(more))
    grouped = classes.join(final, F.col("c") == F.col("node"), "left").select("c", "rep", F.coalesce("component", "c").alias("g"))
    least = grouped.groupBy("g").agg(F.min("rep").alias("component_id"))
    of_class = grouped.join(least, "g").select("c", "component_id")
    out = rows.withColumnRenamed("n", "n_shingles").join(of_class, "c", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each linked group the rows, with their columns, of the least doc_id; rows that repeat a doc_id all stay."""
    own = unused(docs, "id")
    gone = cut(join(docs.select("doc_id", "text")).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own)).distinct())
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")
