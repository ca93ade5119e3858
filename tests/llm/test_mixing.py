"""Mixing of sources against targets by resharing, rates by bisection, and limits."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stackloom.llm import mixing, queries
from stackloom.llm.spark import numbered

SCHEMA = "doc_id long, text string, source string, size string, copies string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def reshared(sizes, share=1.5, weights=(5, 2, 1), most=2):
    """Targets by handing out the excess round by round; sizes by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def test_numbers_by_ranges(spark):
    g = random.Random(1)
    names = [f"s{g.randint(0, 10**6)}" for _ in range(3000)] + ["", "é", "\U0001f600", "Z"]
    rows = numbered(spark.createDataFrame([(n,) for n in set(names)], "name string"), "k", "name").collect()
    assert [r.name for r in sorted(rows, key=lambda r: r.k)] == sorted(set(names), key=lambda n: n.encode())
    assert sorted(r.k for r in rows) == list(range(len(rows)))


def test_targets_like_resharing(spark):
    g = random.Random(2)
    for k in (1, 2, 3, 40):
        sizes = {f"s{i}": g.choice([0, 1, 10, 1000, 10**7]) for i in range(k)} | {None: 77}
        df = spark.createDataFrame([("" if s is None else "=" + s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source[1:] or None: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(reshared(sizes))
    none = mixing.targets(spark.createDataFrame([("=a", 0)], "source string, source_size long")).first()
    assert none.target == 0
    full = mixing.targets(spark.createDataFrame([("=a", 3), ("=b", 4)], "source string, source_size long"), share=9.0).collect()
    assert {r.source: r.target for r in full} == {"=a": 6.0, "=b": 8.0}


def test_duals_solve_the_constraints(spark):
    g = random.Random(3)
    rows, sums = [], defaultdict(list)
    for s, ratio in (("a", 0.02), ("b", 0.9), ("c", 1.0), ("d", 1.98), ("e", 0.5)):
        sizes = sorted({int(g.paretovariate(0.7)) + 1 for _ in range(300)})
        n = [g.randint(1, 1000) for _ in sizes]
        total, docs = sum(x * y for x, y in zip(sizes, n, strict=True)), sum(n)
        for x, y in zip(sizes, n, strict=True):
            rows.append((s, x, y, x * docs / total, ratio * total))
            sums[s].append((x, y, x * docs / total, ratio * total))
    lam = {r.source: r.lam for r in mixing.balance(spark.createDataFrame(rows, "source string, size long, n long, x double, target double")).collect()}
    assert len(lam) == 5 and abs(lam["c"]) < 1e-6
    for s, cs in sums.items():
        got = sum(2 * y * x / (1 + math.exp(-min(700, max(-700, lam[s] * z)))) for x, y, z, _ in cs)
        assert abs(got - cs[0][3]) <= max(0.5, 1e-6 * cs[0][3])


def make(seed=4, n=600):
    g = random.Random(seed)
    rows = []
    for i in range(n):
        s = g.choice(["hot", "hot", "hot", "b", "c", "d", "é", "", None])
        rows.append((i, g.choice([None, "", " \n", " ".join("w" * g.randint(1, 3) for _ in range(int(g.paretovariate(0.9))))]), s, "x", "y"))
    # a third of all rows are copies of one text, in the hot source; repeated rows; null ids
    rows += [(n + i, "same words in every copy", "hot", "x", "y") for i in range(n // 2)]
    return rows + [(-7, "one row twice", "b", "x", "y")] * 2 + [(None, "no id at all", "c", "x", "y")]


def test_mix_meets_targets(spark):
    rows = make()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan(docs).collect()
    sizes, of, taken = defaultdict(int), defaultdict(list), defaultdict(int)
    for i, t, s, *_ in rows:
        sizes[s] += words(t)
        of[i].append((s, words(t)))
    aim = reshared(sizes)
    assert len(got) == len(rows)
    smallest = defaultdict(lambda: math.inf)
    for r in got:
        s, n = of[r.doc_id][0]
        assert (r.size, r.source_size) == (n, sizes[s]) and r.target == pytest.approx(aim[s])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        smallest[s] = min(smallest[s], n or math.inf)
    for s in sizes:
        assert abs(taken[s] - aim[s]) <= max(smallest[s] / 2 + 0.5, 0.5), s
    # copies of one text differ by one at most, and reruns agree under another partitioning
    same = [r.copies for r in got if r.doc_id is not None and 600 <= r.doc_id < 900]
    assert max(same) - min(same) <= 1
    again = mixing.plan(docs.repartition(7, F.rand(5))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # the mix itself has the columns of docs, whatever their names, each row as often as planned
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).where("n > 0").count() == sum(v > 0 for v in taken.values())
    assert mixed.count() == sum(r.copies for r in got)


def test_no_words_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "", ""), (2, " ", "a", "", "")], SCHEMA)
    assert {(r.doc_id, r.source_size, r.target, r.taken) for r in mixing.plan(docs).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    assert mixing.plan(docs.limit(0)).count() == 0
    # one very long text alone can't come nearer to 1.5 times its words than by whole copies
    long = spark.createDataFrame([(3, "long " * 60_000, "b", "", "")], SCHEMA)
    assert [(r.doc_id, r.size, r.target, r.copies in (1, 2)) for r in mixing.plan(docs.unionAll(long)).where("size > 0").collect()] == [(3, 60_000, 90_000.0, True)]


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in docs.values():
        sizes[r.source] += words(r.text)
    aim = reshared(sizes)
    for r in queries.op12_source_mixing(spark, sf).collect():
        d = docs[r.doc_id]
        assert r.size == words(d.text) and r.source_size == sizes[d.source] and r.target == pytest.approx(aim[d.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[d.source] += r.taken
    assert all(abs(taken[s] - aim[s]) <= 0.03 * aim[s] for s in sizes)
