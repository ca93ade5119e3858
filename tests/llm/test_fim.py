"""Fill-in-middle against a version by slices, and its limits."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stackloom.llm import fim, queries

SCHEMA = "doc_id long, text string, `TEXT_` string, form string, n string"
TEXTS = [
    None, "", "a", "ab", "\n", "x\ny\r\n z\u0085", "\x1f", "\x1e", "\x1ee\x1fd\x1e\x1f\x1ed", "\x00a\x00", "日本語の文 𝄞𝄞 é é", "<P", "<S<S>", "a<P>b", "<M>",
    "$1 \\1 \\", "<", "<<<>>>", "P>S>M>", "same", "same",
]


def by_slices(doc_id, text, plain_from=90, spm_below=20):
    t = text or ""
    n = len(t)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < spm_below:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_like_slices(spark):
    # every text under many ids, so that cuts fall on every place, the ends included
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(TEXTS * 40)] + [(None, "null id", "x", "y", "z"), (5, "w" * 300_000 + "\x1f", "x", "y", "z")]
    out = fim.transform(spark.createDataFrame(rows, SCHEMA)).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    got = sorted(tuple(r) for r in out.select(F.coalesce("doc_id", F.lit(-1)), "text", "n", "form", "prefix_chars", "middle_chars", "output", "back").na.fill({"prefix_chars": -1, "middle_chars": -1}).collect())
    want = sorted((-1 if i is None else i, t or "", *(-1 if v is None else v for v in by_slices(i, t)), t or "") for i, t, *_ in rows)
    assert got == want
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_other_units_lose_nothing(spark):
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(TEXTS * 20)], SCHEMA)
    for unit in ("word", "line"):
        out = fim.transform(docs, unit=unit, plain_from=100, spm_below=50).withColumn("back", fim.restore(F.col("output"), F.col("form")))
        assert out.where("back <> text").count() == 0
        assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    n = {r.text: r.n for r in fim.transform(spark.createDataFrame([(1, "a b\nc ", "", "", ""), (2, "\n\nq", "", "", "")], SCHEMA), unit="line").collect()}
    assert n == {"a b\nc ": 2, "\n\nq": 3}


def test_types_and_empty_table(spark):
    docs = spark.createDataFrame([("k1", "some text")], "doc_id string, text string")
    r = fim.digest(fim.transform(docs)).first()
    n, form, a, m, o = by_slices("k1", "some text")
    assert tuple(r) == ("k1", n, form, a, m, sha(o), sha("some text"))
    assert fim.digest(fim.transform(docs.limit(0))).count() == 0
    with pytest.raises(KeyError):
        fim.transform(docs, unit="page")


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in queries.op11_fill_in_middle(spark, sf).na.fill({"prefix_chars": -1, "middle_chars": -1}).collect())
    want = []
    for r in docs:
        n, form, a, m, o = by_slices(r.doc_id, r.text)
        want.append((r.doc_id, n, form, -1 if a is None else a, -1 if m is None else m, sha(o), sha(r.text or "")))
    assert got == sorted(want)
