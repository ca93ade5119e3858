"""The divergence audit against a version by brute force, and its tries against a dict."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stackloom.llm import kernel, queries, source_audit
from stackloom.llm.source_audit import Trie

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, `Block` string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, min_docs, top):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    seen, count, sources = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(lower(text or ""))
        sources[lang].add(source)
        count[lang, source].update(terms)
        seen.update((lang, t) for t in set(terms))
    out = []
    for lang, names in sources.items():
        kept = [t for (of, t), n in seen.items() if of == lang and n >= min_docs]
        p = {}
        for s in [*names, None]:
            c = count[lang, s] if s is not None else sum((count[lang, x] for x in names), Counter())
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in names:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in names if o != s]
            terms = [(p[s][t] - p[None][t], t) for t in kept if count[lang, s][t] > 0 and p[s][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def some_rows(seed, n):
    g = random.Random(seed)
    vocabulary = ["a", "A", "ab", "abc", "b", "É", "é", "ééa", "日本", "日", "z", "zz", "\U0001f600", "x-y", "a1b", "'q", *(f"w{chr(97 + i)}" for i in range(20))]
    for _ in range(n):
        words = [g.choice(vocabulary) for _ in range(g.randint(0, 30))]
        yield g.choice([None, "", " ".join(words), "  ".join(words)]), g.choice(["en", "en", "fr", "", None]), g.choice(["hot", "hot", "b", "é", "", None])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=60))
def test_tries_like_a_dict(terms):
    whole, halves, want = Trie(), (Trie(), Trie()), defaultdict(list)
    for k, term in enumerate(terms):
        whole.add(term, k)
        half = k >= len(terms) // 2
        halves[half].add(term, k - half * (len(terms) // 2))
        want[term].append(k)
    halves[0].merge(halves[1], len(terms) // 2)
    for trie in (whole, halves[0]):
        assert list(trie.walk()) == sorted(want.items()) and trie.leaves == len(want)


def test_shares_are_exact():
    g = random.Random(1)
    for _ in range(500):
        y = g.randint(1, 10 ** g.randint(1, 15))
        x = g.randint(0, y)
        assert int(source_audit.share(np.array([x]), np.array([y]))[0]) == 1 + 10**9 * x // y


def test_terms_of_a_chunk():
    texts = ["Ab ab-AB", None, "ab éé1éé", "", "x" * 5000 + " ab"]
    c = next(kernel.chunks(pa.array(texts)))
    t = source_audit.chunk_terms(c, np.array([0, 0, 1, 1, 0])).to_pydict()
    assert sorted(zip(t["term"], t["group"], t["docs"], t["n"], strict=True)) == sorted([(b"ab", 0, 2, 4), (b"ab", 1, 1, 1), ("éé".encode(), 1, 1, 2), (b"x" * 5000, 0, 1, 1)])


def test_like_brute_force(spark):
    rows = list(some_rows(2, 400)) + [("only here", "xx", "one"), (None, "yy", "a"), ("rare", "yy", "b"), ("", "yy", None), ("v" * 100_000 + " a ab", "en", "hot")]
    docs = spark.createDataFrame([(i, *r, "t", "b") for i, r in enumerate(rows)], SCHEMA).repartition(5)
    got = source_audit.audit(docs, min_docs=8, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(rows, 8, 5)
    assert sorted(tuple(r) for r in got.collect()) == want
    # languages of several sources without a kept term have pairs of value 0, and nothing is lost in small tries and blocks
    assert [w for w in want if w[0] == "yy"] == [("yy", s, "pair", o, 0, k) for s in ("", "a", "b") for k, o in enumerate((x for x in ("", "a", "b") if x != s), 1)]
    whole = source_audit.kept_terms(source_audit.leaves(docs), 8)
    small = source_audit.kept_terms(source_audit.leaves(docs, 7), 8, 3)
    as_set = lambda df: sorted((r.lang, r.term, r.docs, sorted(zip(r.sources, r.counts, strict=True))) for r in df.collect())
    assert as_set(small) == as_set(whole)
    per_block = Counter(r.block for r in small.collect())
    assert max(per_block.values()) <= 3 and small.select("lang", "block").distinct().count() == small.select("block").distinct().count()


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert source_audit.audit(docs).count() == 0
    assert source_audit.audit(spark.createDataFrame([(1, None, None, None, "", "")], SCHEMA)).count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_source_divergence(spark, sf).collect()) == brute(rows, 30, 50)
