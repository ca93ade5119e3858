"""Fuzzy line deduplication with DataFrame functions only.

Lines (split at \\n) are normalised: lower case, and words are runs of letters and digits.  Two
lines are near if the SimHashes (``BITS`` bits) of their distinct words differ in at most ``NEAR_BITS`` bits
and their normalised texts have an edit similarity, 1 - distance / longer length, of ``SIMILARITY``
or more; equal normalised lines are near in any case.  Lines of fewer than ``MIN_WORDS`` words whose
normalised text has ``MIN_CHARS`` characters take the SimHash of its runs of three characters.
Shorter lines are near only if they are equal but for case and the amount of white space, so that
symbols count.  Lines of white space always stay.  Of each connected group one occurrence stays:
the one with the least (doc_id, line number).

Plan.  Equal lines are pre-aggregated to one row before anything else.  With ``NEAR_BITS`` = 3,
of five blocks of a SimHash two are the same in both lines, so the ten pairs of blocks, 24 bits
each, are the join keys; more ``BLOCKS`` give longer keys to a larger corpus and the same result.  Inside a bucket no list of all pairs is made: a semi-join keeps the
lines that have any near SimHash, then every line is verified against its bucket's first, and only
lines of a bucket that are not yet in one component are compared with each other.

Null and empty texts have no lines to remove and stay as they are.  Rows with the same doc_id
count as one document: what is removed from one is removed from all.  A null doc_id comes before
others.  Line numbers count from 0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackloom.llm.spark import components, cut, let_go, unused

BITS = 60
NEAR_BITS = 3
SIMILARITY = 0.8
MIN_WORDS = 4
MIN_CHARS = 20
BLOCKS = 5
BROADCAST_ROWS = 100_000
#: Words counted together: a counter of 4 bits holds 15; the sum of two longs may not reach the 64th bit.
RUN = 15
NIBBLES = 0x0111111111111111
BYTES = 0x0F0F0F0F0F0F0F0F
WIDE = 0x000F000F000F000F
#: Words counted by counters of 8 bits, of which the highest stays free, and of 16, of which the highest two do.
FEW = 127
MOST = 1092 * RUN


def words(line: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normal(line: Column) -> Column:
    """The words with a space between them."""
    return F.array_join(words(line), " ")


def simhash(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and s of rows with x, hashes of words: bit i is set if it is in more than half of them; null without x.

    Four longs hold 60 counters of 4 bits for each run of 15 words; runs add up in 8 longs with
    counters of 8 bits, or in 16 with counters of 16 bits for long lines.  These are decided by
    adding the same number to all and looking at a high bit.  Up to FEW words have a column each, as
    Spark compiles sums of columns but interprets functions of array elements.
    """
    nothing = F.lit(0).cast("bigint")
    starts = F.sequence(F.lit(0), F.expr(f"(size(x) - 1) div {RUN}"))
    many = F.size("x") > FEW
    word = [F.when(~many, F.coalesce(F.get("x", F.lit(k)), nothing)).alias(f"w{k}") for k in range(FEW)]
    rows = rows.select(*keep, F.when(F.col("x").isNotNull(), F.size("x")).alias("n"), F.when(many, F.transform(starts, lambda i: F.slice("x", i * RUN + 1, RUN))).alias("r"), *word)

    def lane(h: Column, j: int) -> Column:
        return F.shiftrightunsigned(h, j).bitwiseAND(F.lit(NIBBLES))

    def count(j: int) -> Column:
        return F.transform("r", lambda run: F.aggregate(run, nothing, lambda t, h: t + lane(h, j)))

    runs = range(0, FEW, RUN)
    few = [reduce(add, [lane(F.col(f"w{k}"), j) for k in range(i, min(i + RUN, FEW))]).alias(f"l{j}_{i}") for j in range(4) for i in runs]
    rows = rows.select(*keep, "n", *[count(j).alias(f"l{j}") for j in range(4)], *few)

    def majority(width: int, mask: int, ones: int, total: Callable[[int, int, int], Column]) -> Column:
        """From counters of `width` bits; counter i of the long for (j, k) is that of bit i * width + 4 * k + j."""
        more = (F.lit((1 << (width - 2)) - 1) - F.expr("n div 2")).cast("bigint") * F.lit(ones)
        out = nothing
        for i in range(width):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(total(i % 4, i // 4 * 4, mask) + more, width - 2).bitwiseAND(F.lit(ones)), i))
        return out

    def of_columns(j: int, shift: int, mask: int) -> Column:
        return reduce(add, [F.shiftrightunsigned(F.col(f"l{j}_{i}"), shift).bitwiseAND(F.lit(mask)) for i in runs])

    def of_arrays(j: int, shift: int, mask: int) -> Column:
        return F.aggregate(f"l{j}", nothing, lambda t, v: t + F.shiftrightunsigned(v, shift).bitwiseAND(F.lit(mask)))

    short, middle, long_ = majority(8, BYTES, 0x0101010101010101, of_columns), majority(16, WIDE, 0x0001000100010001, of_arrays), nothing
    for bit in range(BITS):
        long_ = long_.bitwiseOR(F.when(of_arrays(bit % 4, bit // 4 * 4, 15) * 2 > F.col("n"), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return rows.select(*keep, F.when(F.col("n") <= FEW, short).when(F.col("n") <= MOST, middle).when(F.col("n") > MOST, long_).alias("s"))


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, line, h (of the normalised line), s (its SimHash; null for short lines) for all lines but white space; no shuffle."""
    lines = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = lines.where(F.col("raw").rlike(r"[^\s\p{Z}]")).select("doc_id", "line", "raw", words(F.col("raw")).alias("w"))
    lines = lines.select("doc_id", "line", "raw", "w", F.array_join("w", " ").alias("norm"))
    few = F.size("w") < MIN_WORDS
    short = few & (F.length("norm") < MIN_CHARS)
    # an h of its own kind: no normalised line has it
    exact = F.xxhash64(F.lit("short"), F.trim(F.regexp_replace(F.lower("raw"), r"[\s\p{Z}]+", " ")))
    lines = lines.select("doc_id", "line", "w", few.alias("few"), F.when(short, exact).otherwise(F.xxhash64("norm")).alias("h"), F.when(few & ~short, F.split("norm", "")).alias("c"))
    threes = F.transform("c", lambda c, i: F.xxhash64(c, F.get("c", i + 1), F.get("c", i + 2)))
    lines = lines.select("doc_id", "line", "h", F.when(F.col("few"), threes).otherwise(F.transform("w", lambda w: F.xxhash64(w))).alias("x"))
    # each word once: else a few frequent words would decide on long lines, and all of these would be near
    return simhash(lines.withColumn("x", F.array_distinct("x")), ["doc_id", "line", "h"])


def block_keys(s: Column) -> Column:
    """Array of join keys: each choice of blocks with its number; near SimHashes share one."""
    cuts = [round(BITS * i / BLOCKS) for i in range(BLOCKS + 1)]
    width = max(b - a for a, b in zip(cuts, cuts[1:]))
    block = [F.shiftrightunsigned(s, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for k, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - NEAR_BITS)):
        key = F.lit(k).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, width).bitwiseOR(block[i])
        keys.append(key)
    return F.array(*keys)


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= NEAR_BITS


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) whose texts are similar enough."""
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("norm").alias("ta")), "a").join(texts.select(F.col("h").alias("b"), F.col("norm").alias("tb")), "b")
    longer = F.greatest(F.length("ta"), F.length("tb"))
    both = both.where(longer * 2 - F.length("ta") - F.length("tb") <= F.floor(longer * (1 - SIMILARITY) + 1e-9))
    both = both.select("a", "b", F.floor(longer * (1 - SIMILARITY) + 1e-9).cast("int").alias("most"), F.split("ta", " ").alias("wa"), F.split("tb", " ").alias("wb"))
    # changing word after word is one way from a to b, and changing all between the first and the last
    # different word another: their costs prove most pairs; the others are measured between these words,
    # as what both texts begin and end with adds nothing
    change = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.when(x == y, 0).otherwise(F.greatest(F.length(x), F.length(y)))), F.lit(0), lambda t, x: t + x)
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda v, w: v.eqNullSafe(w)), F.lit(False)).cast("int") - 1
    both = both.select("*", same(F.col("wa"), F.col("wb")).alias("p"), same(F.reverse("wa"), F.reverse("wb")).alias("q"))
    both = both.withColumn("tail", F.least("q", F.least(F.size("wa"), F.size("wb")) - F.col("p")))
    between = lambda w: F.array_join(F.slice(w, F.col("p") + 1, F.greatest(F.size(w) - F.col("p") - F.col("tail"), F.lit(0))), " ")
    both = both.select("*", between("wa").alias("ma"), between("wb").alias("mb"))
    # a word that goes takes a space with it; where nothing is left of one text, the lengths have decided
    middle = F.greatest(F.length("ma"), F.length("mb")) + 1
    near = F.when(middle <= F.col("most"), True).when((F.size("wa") == F.size("wb")) & (change <= F.col("most")), True).otherwise(F.expr("levenshtein(ma, mb, most) >= 0"))
    # exploded, as a plain filter would move into the join with every column above written out wherever it is used
    return both.select("a", "b", F.explode(F.array(near)).alias("near")).where("near").select("a", "b")


def near_edges(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of near different lines that join all near lines; kinds: h, s, doc_id, line of one occurrence."""
    # only SimHashes are dealt out; a bucket is dropped as soon as it has a single one
    keyed = kinds.groupBy("s").agg(F.count("*").alias("m")).select("s", F.explode(block_keys(F.col("s"))).alias("key"))
    mine = Window.partitionBy("key")
    busy = cut(keyed.withColumns({"lo": F.min("s").over(mine), "hi": F.max("s").over(mine)}).where("lo <> hi").select("key", "s"))
    a, b = busy.alias("a"), busy.alias("b")
    near = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.s") != F.col("b.s")) & _near("a.s", "b.s"), "left_semi")
    # lines with one SimHash are near as well: that SimHash is their bucket
    shared = kinds.groupBy("s").agg(F.count("*").alias("m")).where("m > 1").select(F.lit(-1).cast("bigint").alias("key"), "s")
    members = cut(near.unionAll(shared).join(kinds, "s").select("key", "s", "h", "doc_id", "line"))
    members = members.withColumn("key", F.when(F.col("key") < 0, F.xxhash64("s")).otherwise(F.col("key")))
    wanted = cut(members.select("h", "doc_id", "line").distinct())
    few = wanted.count() <= BROADCAST_ROWS
    side = (F.broadcast(wanted) if few else wanted).withColumnRenamed("doc_id", "id")
    source = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text").isNotNull())
    texts = source.select("h", normal(F.get(F.split("text", "\n"), F.col("line"))).alias("norm")).where(F.xxhash64("norm") == F.col("h"))
    texts = cut(texts.groupBy("h").agg(F.min("norm").alias("norm")))
    members = members.select("key", "h", "s")
    first = members.groupBy("key").agg(F.min(F.struct("h", "s")).alias("f"))
    led = cut(members.join(first, "key").select("key", "h", "s", F.col("f.h").alias("fh"), F.col("f.s").alias("fs")))
    star = cut(_verified(led.where((F.col("h") != F.col("fh")) & _near("s", "fs")).select(F.col("fh").alias("a"), F.col("h").alias("b")).distinct(), texts))
    comp = components(star)
    rest = led.where("h <> fh").join(comp, F.col("h") == F.col("node"), "left").select("key", "h", "s", F.coalesce("component", "h").alias("c"))
    mixed = rest.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    rest = cut(rest.join(mixed, "key"))
    a, b = rest.alias("a"), rest.alias("b")
    cross = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.c") != F.col("b.c")) & (F.col("a.h") < F.col("b.h")) & _near("a.s", "b.s"))
    cross = cross.select(F.col("a.h").alias("a"), F.col("b.h").alias("b")).distinct()
    return star.unionAll(cut(_verified(cross, texts)))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, lines: the numbers of the lines that go, for documents that lose any."""
    lines = cut(line_hashes(docs))
    let_go(docs.sparkSession)
    kinds = cut(lines.groupBy("h", "s").agg(F.min(F.struct("doc_id", "line")).alias("k"), F.count("*").alias("n")).select("h", "s", "n", "k.doc_id", "k.line"))
    comp = components(near_edges(kinds.where(F.col("s").isNotNull()), docs))
    grouped = kinds.join(comp, F.col("h") == F.col("node"), "left").select("h", "n", F.coalesce("component", "h").alias("c"), F.col("component").isNotNull().alias("near"), "doc_id", "line")
    keeper = grouped.where("near").groupBy("c").agg(F.min(F.struct("doc_id", "line")).alias("k"))
    keep = grouped.where("near or n > 1").join(keeper, "c", "left").select("h", F.coalesce(F.col("k"), F.struct("doc_id", "line")).alias("k"))
    gone = lines.join(keep, "h").where(~(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("line") == F.col("k.line"))))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup(docs: DataFrame, removed: str = "removed") -> DataFrame:
    """All rows of docs with their columns; text without the lines that go.

    A last column `removed`, the numbers of these lines, takes the place of one of that name.
    """
    own_id, lost = unused(docs, "id"), unused(docs, "gone")
    gone = cut(removed_lines(docs.select("doc_id", "text"))).withColumnsRenamed({"doc_id": own_id, "lines": lost})
    # grows with the input, hence the same plan at every size; texts are hashed to their lines, not sorted
    out = docs.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(own_id)), "left")
    split = unused(docs, "split")
    out = out.withColumn(split, F.when(F.col(lost).isNotNull(), F.split("text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lost))
    # a null text can share its doc_id with one that loses lines
    text = F.when(F.col(split).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(split), i)), "\n"))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != removed], F.coalesce(lost, F.array().cast("array<int>")).alias(removed))
