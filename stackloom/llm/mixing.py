"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share SHARE of all
words; a target stops at MOST times the words of its source, and what is over is shared again by
weight among the others until none is above.

Rates: each document may be taken 0 to MOST times.  Among all ways to draw the copies that meet
every source's target, the one nearest in entropy to fair coins (one copy on average) tilts the
counts exponentially: rate = MOST / (1 + exp(-lambda * size / mean size)), one lambda a source.
The dual is convex and has one term for each distinct (source, size), so Newton's iterations run
over that histogram: one grouped aggregation a round for all sources at once, each kept inside a
bracket so that it can't run away.  Sums are decimals: the order of rows changes nothing.

Copies: the rates of a class of equal size are rounded together, sizes descending, by differences
of rounded running sums; what then lacks or exceeds is put right with the largest size that fits,
again and again, so a source ends within half of its smallest size of its target wherever copies allow.
In a class all get K // n copies and the K % n rows of least hash one more.

Skew: a class may hold any share of the rows.  It is split into BUCKETS by hash, counted with a
map-side combine and numbered bucket by bucket; no window holds more than a bucket of a class.
The running sums run over the distinct sizes of a source, of which there are no more than its
longest text has words.  Lineage is cut with written tables.

Null texts and texts without words have size 0, are taken 0 times and count nowhere; a source
without words has target 0; repeated rows are documents of their own; a null doc_id is allowed;
if SHARE asks for more than MOST times everything, every source is at its limit; an empty table
gives no rows; other columns are ignored by ``plan`` and kept by ``mix``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.spark import cut, numbered

SHARE, WEIGHTS, MOST = 1.5, (5, 2, 1), 2
BUCKETS = 256
WORD = r"[^\x20\x09-\x0D]+"
EXACT = "decimal(38,6)"


def _rows(docs: DataFrame, kept: Column) -> DataFrame:
    """Source (never null), size, bucket and hash of each row, for its counting and numbering, beside what is kept of it."""
    h = F.xxhash64("doc_id", "text")
    return docs.select(
        kept.alias("kept"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.pmod(h, F.lit(BUCKETS)).alias("bucket"),
        h.alias("h"),
    )


def targets(sources: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with target, the words that the mix is to take of each."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # null is '', before everything that has a sign in front, and stands last
    s = cut(numbered(sources, "k", (F.col("source") == "").cast("int"), F.col("source")).withColumn("w", F.get(cycle, (F.col("k") % len(weights)).cast("int"))))
    all_words, all_weight = s.agg(F.sum("source_size"), F.sum("w")).first()
    limit = F.col("source_size") * F.lit(float(most))
    level, full = 0.0, -1
    while all_words:
        # the level rises from round to round, so a source at its limit stays there
        at, words, weight = s.where(limit <= F.col("w") * F.lit(level)).agg(F.count("*"), F.sum("source_size"), F.sum("w")).first()
        if at == full or all_weight - (weight or 0) <= 0:
            break
        full, level = at, (share * all_words - most * (words or 0)) / (all_weight - (weight or 0))
    return s.select("source", "source_size", F.least(limit, F.col("w") * F.lit(level)).alias("target"))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def balance(classes: DataFrame, most: int = MOST) -> DataFrame:
    """source, lam: the dual of each source in classes (source, size, n, x, target) whose target is inside its limits.

    x is the size in units of the source's mean.  Newton's step where it stays inside the bracket
    that is known so far, else the middle of the bracket, or four times as far where it is open.
    """
    state = cut(classes.select("source", "target").distinct().select("source", "target", *[F.lit(v).cast("double").alias(c) for c, v in (("lam", 0.0), ("lo", None), ("hi", None))], F.lit(True).alias("open")))
    while not state.where("open").isEmpty():
        tilted = classes.drop("target").join(state.where("open").select("source", "lam"), "source")
        p = _sigmoid(F.col("lam") * F.col("x"))
        words = F.col("n").cast("double") * F.col("size") * most
        sums = tilted.groupBy("source").agg(F.sum((words * p).cast(EXACT)).cast("double").alias("now"), F.sum((words * p * (1 - p) * F.col("x")).cast(EXACT)).cast("double").alias("slope"))
        s = state.join(sums, "source", "left").withColumn("gap", F.col("now") - F.col("target"))
        s = s.withColumn("done", F.coalesce(F.abs("gap") <= F.greatest(F.lit(0.25), F.col("target") * 1e-12), F.lit(True)))
        s = s.withColumns({"lo": F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi"))})
        step = F.when(F.col("slope") > 0, F.col("lam") - F.col("gap") / F.col("slope"))
        inside = step.isNotNull() & (step > F.coalesce("lo", F.lit(float("-inf")))) & (step < F.coalesce("hi", F.lit(float("inf"))))
        far = F.lit(4.0) * F.greatest(F.abs("lam"), F.lit(1.0))
        middle = F.when(F.col("lo").isNull(), -far).when(F.col("hi").isNull(), far).otherwise((F.col("lo") + F.col("hi")) / 2)
        # a bracket that can't be halved any more ends the search as well
        stuck = (F.col("lo") + F.col("hi")) / 2 == F.col("lam")
        done = F.col("done") | F.coalesce(stuck & ~inside, F.lit(False))
        s = s.select("source", "target", F.when(F.col("done"), F.col("lam")).otherwise(F.when(inside, step).otherwise(middle)).alias("lam"), "lo", "hi", (F.col("open") & ~done).alias("open"))
        state = cut(s, instead_of=state)
    return state.select("source", "lam")


def round_off(classes: DataFrame, most: int = MOST) -> DataFrame:
    """classes (source, size, n, rate, target) with copies: whole numbers of which sums of words come next to the targets."""
    ideal = F.col("n") * F.col("rate")
    spare = (ideal - F.floor(ideal)).cast("decimal(20,9)")
    c = classes.withColumns({"spare": spare, "copies": F.floor(ideal)})
    half = F.lit("0.5").cast("decimal(2,1)")
    run = F.sum("spare").over(Window.partitionBy("source").orderBy(F.desc("size")))
    c = c.withColumn("run", run).withColumn("copies", F.col("copies") + F.floor(F.col("run") + half) - F.floor(F.col("run") - F.col("spare") + half))
    c = cut(c.select("source", "size", "n", "target", F.least("copies", F.col("n") * most).cast("bigint").alias("copies")))
    while True:
        gap = c.groupBy("source").agg((F.round(F.first("target")).cast("bigint") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).where("gap <> 0")
        room = F.when(F.col("gap") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        # the largest size that fits; if none does, the least that leaves less than it finds
        size, left = F.col("size"), F.abs("gap")
        fits = c.join(gap, "source").withColumn("room", room).where((F.col("room") > 0) & (size < 2 * left))
        best = F.max(F.struct((size <= left).alias("fits"), F.when(size <= left, size).otherwise(-size).alias("by"), "size", "room", "gap")).alias("m")
        times = F.when(F.col("m.fits"), F.least(F.col("m.room"), F.floor(F.abs("m.gap") / F.col("m.size")))).otherwise(1)
        move = fits.groupBy("source").agg(best).select("source", F.col("m.size").alias("size"), (F.signum("m.gap") * times).cast("bigint").alias("more"))
        move = cut(move)
        if move.isEmpty():
            return c
        c = cut(c.join(move, ["source", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more"), instead_of=c)


def _cells(rows: DataFrame, share: float, weights: Sequence[float], most: int) -> DataFrame:
    """For each (source, size, bucket): source_size, target, each (copies of every row) and more (rows with one more)."""
    cells = cut(rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")))
    counts = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    aims = cut(targets(sources.drop("docs"), share, weights, most).join(sources.select("source", "docs"), "source"))
    classes = cut(counts.join(aims, "source").where("size > 0").withColumn("x", F.col("size") * F.col("docs") / F.col("source_size")))
    inner = classes.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(float(most))))
    lam = balance(inner.select("source", "size", "n", "x", "target"), most)
    rate = F.when(F.col("target") <= 0, 0.0).otherwise(F.coalesce(most * _sigmoid(F.col("lam") * F.col("x")), F.lit(float(most))))
    rounded = round_off(classes.join(lam, "source", "left").select("source", "size", "n", rate.alias("rate"), "target"), most)
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("n")
    allotted = cells.withColumn("before", before).join(rounded.select("source", "size", "copies", F.col("n").alias("of")), ["source", "size"], "left")
    extra = F.col("copies") % F.col("of") - F.col("before")
    out = allotted.join(aims, "source").select(
        "source", "size", "bucket", "source_size", "target",
        F.coalesce(F.floor(F.col("copies") / F.col("of")), F.lit(0)).alias("each"),
        F.coalesce(F.greatest(F.least(extra, F.col("n")), F.lit(0)), F.lit(0)).alias("more"),
    )
    return cut(out)


def _allot(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with source_size, target and copies."""
    key = ["source", "size", "bucket"]
    at = rows.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("h")))
    return at.join(cells, key).withColumn("copies", (F.col("each") + (F.col("at") <= F.col("more")).cast("bigint")).cast("bigint"))


def plan(docs: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of docs (doc_id, text, source)."""
    rows = cut(_rows(docs, F.col("doc_id")))
    return _allot(rows, _cells(rows, share, weights, most)).select(F.col("kept").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: the rows of docs, with their columns, each as often as it is taken."""
    cells = _cells(cut(_rows(docs, F.lit(0))), share, weights, most)
    out = _allot(_rows(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), cells)
    return out.select("kept", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("kept.*")
