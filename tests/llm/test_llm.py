"""Operators for training data against versions by brute force, round trips and held-out accuracy."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackloom.llm import chat, decontam, kernel, line_dedup, ngram_join, packing, quality, queries, rules, suffix_dedup, toxicity, url_graph
from stackloom.llm.spark import components

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def tokens():
    return queries.tokenizer_json()


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def some_texts(seed, n, vocabulary=("a", "bb", "ñc", "D", "e.", "\n", "f\tg", "日本"), most=60):
    g = random.Random(seed)
    return [None, "", " \n ", *(" ".join(g.choice(vocabulary) for _ in range(g.randint(0, most))) for _ in range(n))]


# kernel


def test_hash_ranges_and_words():
    texts = ["a b  a", None, "", "b", "ab a"]
    c = next(kernel.chunks(pa.array(texts)))
    start, end, first = c.words(kernel.NOT_SPACE)
    assert first.tolist() == [0, 3, 3, 3, 4, 6]
    h = kernel.hash_of(c.prefix(False), start, end)
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert [k.n for k in kernel.chunks(pa.array(["x" * 10] * 5), 20)] == [2, 2, 1]


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (7, 7), (3, 1), (100, 8), *((i, i + 1) for i in range(200, 240))]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 100: 8, **{i: 200 for i in range(200, 241)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 and 4: classifiers


def area(score, y):
    """Area under the curve: the share of pairs of both classes that are in order."""
    up, down = score[y == 1], score[y == 0]
    return float(((up[:, None] > down) + 0.5 * (up[:, None] == down)).mean())


# at the small size 6 of 70 held-out rows are toxic and 11 of bad quality; at the larger one 97 and 122 of 825
@pytest.mark.parametrize("op,label,sf,recall,precision,auc", [(toxicity, "toxic", BIG, 0.65, 0.5, 0.8), (toxicity, "toxic", "/root/testdata/sf0.1", 0.85, 0.85, 0.95), (quality, "quality", BIG, 0.95, 0.95, 0.9), (quality, "quality", "/root/testdata/sf0.1", 0.95, 0.95, 0.98)])
def test_held_out_accuracy(spark, op, label, sf, recall, precision, auc):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = op.score(docs, labels).join(labels, "doc_id").toPandas()
    assert ((out.held_out) == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = out[out.held_out]
    y, said = held[label].to_numpy(), held.predicted.to_numpy()
    assert len(held) > 50
    assert (said[y == 1]).mean() >= recall and y[said == 1].mean() >= precision and area(held.score.to_numpy(), y) >= auc
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= op.CUTOFF)).all()


def test_samples_are_whole_texts_within_bounds(spark):
    long = "w" * 5000 + " idiot"
    docs = docs_of(spark, ["a b"] * 50 + [long, None, "x" * 20_000])
    labels = spark.createDataFrame([(i, i % 2) for i in range(53)] + [(None, 1), (None, 0), (7, None), (8, 5)], "doc_id long, toxic int")
    rows = quality.sample(docs, labels, "toxic", 100, 1 << 20, 10_000)
    assert {t for t, _ in rows} >= {"a b"} and all(t in ("a b", long, "") for t, _ in rows)
    few = quality.sample(docs, labels, "toxic", 4, 1 << 20, 10_000)
    assert Counter(y for _, y in few)[0] <= 4 and Counter(y for _, y in few)[1] <= 4
    assert sum(len(t) for t, y in quality.sample(docs, labels, "toxic", 100, 30, 10_000) if y) <= 30


@pytest.mark.parametrize("op", [toxicity, quality])
def test_classifiers_take_anything(spark, op):
    texts = [None, "", "x" * 200_000, "a b", "a b", " "]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = op.score(docs_of(spark, texts), none).collect()
    assert len(out) == 6 and {r.score for r in out} == {0.5}
    bad, good = ["%% ## idiot %%"] * 30, ["the quiet river runs"] * 30
    docs = docs_of(spark, [b + f" {i}" for i, b in enumerate(bad + good)] + texts)
    labels = spark.createDataFrame([(i, int(i >= 30), int(i < 30)) for i in range(60)] + [(None, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op.score(docs, labels.withColumn("text", F.lit(1))).collect()}
    assert len(got) == 66 and got[63].score == got[64].score and got[60].score == got[61].score
    assert op.score(docs.limit(0), labels).count() == 0


def test_gradients_are_right():
    p = {k: v.astype(float) for k, v in toxicity._fresh(1).items()}
    g = np.random.default_rng(2)
    x, index, y = g.normal(size=(9, toxicity.DIM_WORD + toxicity.DIM_CHAR)), g.integers(0, 9, (3, toxicity.SPAN)), np.array([0.0, 1, 1])
    index[1, 5:] = -1
    w = np.array([1.0, 2, 1])
    grads, dx, _ = toxicity.gradients(p, x, index, y, w)
    for name, at in (("xf", (3, 4)), ("hb", (1, 5)), ("a", (2, 3)), ("v", (1, 0)), ("o", (4, 0)), ("cb", (7,)), ("b", (0,))):
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        slope = (toxicity.gradients(up, x, index, y, w)[2] - toxicity.gradients(down, x, index, y, w)[2]) / 2e-2
        assert grads[name][at] == pytest.approx(slope, rel=0.05, abs=1e-4), name
    up, down = x.copy(), x.copy()
    up[index[0, 3], 2] += 1e-2
    down[index[0, 3], 2] -= 1e-2
    slope = (toxicity.gradients(p, up, index, y, w)[2] - toxicity.gradients(p, down, index, y, w)[2]) / 2e-2
    assert dx[index[0, 3], 2] == pytest.approx(slope, rel=0.05, abs=1e-4)


def test_windows_cover_every_word():
    c = next(kernel.chunks(pa.array([" ".join(map(str, range(n))) for n in (0, 1, 31, 32, 33, 48, 49, 100)])))
    w = toxicity.Words(c)
    index, doc, full = w.windows()
    assert (full == (index >= 0).all(1)).all()
    for i, n in enumerate((0, 1, 31, 32, 33, 48, 49, 100)):
        seen = set(index[doc == i].ravel().tolist()) - {-1}
        assert seen == set(w.which[w.first[i] : w.first[i + 1]].tolist()) and len(seen) == n


# 2: chat


HARD = ["<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|", "<\\\\|x", "<|part|>", "a\nb", "", None, "<\\.|"]


def test_chat_round_trip(spark):
    g = random.Random(3)
    rows = [(c, t, g.choice(["user", "assistant", None, "we\nird", "<|im_start|>"]), g.choice(HARD), 1) for c in range(40) for t in range(g.randint(1, 9))]
    rows += rows[:5] + [(None, 0, "user", "x", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_turns(turns)).collect()}
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t, role or "", text or ""))
    assert want.keys() == back.keys()
    for c, v in want.items():  # ties of a turn by role and text as they are
        assert back[c] == [(r, x) for _, r, x in sorted(v)], c
    assert chat.format_turns(turns.limit(0)).count() == 0


def test_chat_ties_stand_in_raw_order(spark):
    rows = [(1, 0, "user", "<|x"), (1, 0, "user", "<a"), (1, 0, "user", "<a"), (1, 1, "user", "w " * 50_000)]
    back = chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in back.turns] == ["<a", "<a", "<|x", "w " * 50_000]


def test_chat_merges_and_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b")]
    f = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert f.first()["formatted"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<|part|>b<|im_end|>\n"
    d = chat.digest(chat.read_back(f)).first()
    assert (d.n_turns, d.loss_chars) == (3, 2) and d.loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert d.turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\na\nassistant\nb\n").hexdigest()


# 3: decontamination


def brute_decontam(docs, items, window=10):
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = defaultdict(set)
    for i, t in items:
        w = words(lower(t), pat)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[j : j + k])].add(str(i))
    sizes = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w = words(lower(t), pat)
        hit, found = set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if (x := tuple(w[j : j + k])) in wins:
                    hit.update(range(j, j + k))
                    found |= wins[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_decontamination(spark, block):
    g = random.Random(5)
    vocabulary = ["x", "Yy", "z1", "é", "w", "v"]
    items = [(i, t) for i, t in enumerate([None, "", "!!", "x yy", *(" ".join(g.choice(vocabulary) for _ in range(g.randint(1, 25))) for _ in range(20))])]
    items.append((77, items[-1][1]))
    texts = some_texts(6, 40, vocabulary + ["-", "\n"], 80) + ["zz " + (items[8][1] or "") + " qq"] * 2 + ["w " * 3000]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(docs, bench, block_bytes=block).drop("hits").collect()
    assert sorted(map(tuple, got)) == sorted(brute_decontam(list(enumerate(texts)), items))
    kept = decontam.remove(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.contaminated}
    assert decontam.report(docs.limit(0), bench).count() == 0
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_takes_large_vocabularies(spark):
    w = [f"w{k}" for k in range(70_000)]
    items = [(0, " ".join(w)), (1, "w3 w2 w69999"), (2, " ".join(w[65_530:65_545]))]
    texts = ["a " + " ".join(w[65_532:65_542]) + " b", " ".join(w[65_532:65_541]) + " w9", "w3 w2 w69999", "w2 w3 w69999", " ".join(w[:11]) + " w0"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(docs_of(spark, texts), bench).drop("hits").collect()
    assert sorted(map(tuple, got)) == sorted(brute_decontam(list(enumerate(texts)), items))
    assert [r.n_hit for r in sorted(got)] == [10, 0, 3, 0, 11]


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = docs_of(spark, ["k l m", "n o p", None, "p q " * 40_000]).withColumns({c: F.lit(5) for c in ("n", "spans", "items", "N_", "__n", "__spans", "__items")})
    bench = spark.createDataFrame([(None, "k l"), (3, None), (4, "o"), (4, "p q p")], "item_id long, text string")
    rows = decontam.remove(docs, bench).collect()
    assert [r.asDict() for r in rows] == [r.asDict() for r in docs.where("doc_id = 2").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.report(docs, bench).collect()}
    assert got == {0: (3, 2, 1), 1: (3, 1, 1), 2: (0, 0, 0), 3: (80_000, 79_999 + 0, 1)} or got[3] == (80_000, 79_999, 1)


def test_longest_matches():
    items = [("a", "p q r s t u v w x y z"), ("b", "k l")]
    bench = decontam.Benchmark(items)
    text = "0 p q r s t u v w x y z 1 k l 2 q r s t u v w x y z"
    c = next(kernel.chunks(pa.array([text])))
    h, first = decontam.word_hashes(c)
    got = decontam.longest(decontam.Shard(bench.number(h), first), bench)
    assert sorted(got) == [(0, 0, 1, 11), (0, 1, 16, 10), (1, 0, 13, 2)]


def test_matches_say_where(spark):
    docs = docs_of(spark, ["nothing", None, "x P q r s t u v w, x y z k l"])
    bench = spark.createDataFrame([(4, "p q r s t u v w x y z"), (5, "K L")], "item_id long, text string")
    assert sorted(map(tuple, decontam.matches(docs, bench).collect())) == [(2, "4", 0, 1, 11), (2, "5", 0, 12, 2)]


# 5: n-gram join


def brute_join(docs):
    sets = {}
    for i, t in docs:
        w = words(lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i)) for i in ids}


def near_copies(seed):
    g = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common = [g.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(12):
        base = [g.choice(vocabulary) for _ in range(g.randint(1, 90))] + (common if g.random() < 0.5 else [])
        for _ in range(g.randint(1, 7)):
            w = list(base)
            for _ in range(g.randint(0, 4)):
                w[g.randrange(len(w))] = g.choice(vocabulary)
            out.append(" ".join(w[: len(w) - g.randint(0, 3)]))
    return out


@pytest.mark.parametrize("part_rows", [1000, 2])
def test_ngram_join(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ngram_join, "PART_ROWS", part_rows)
    texts = [None, "", " ", "One two", "one  TWO", "a b c d e", *near_copies(11), "one two"]
    docs = docs_of(spark, texts)
    got = ngram_join.join(docs.withColumn("n", F.lit(0))).collect()
    assert {tuple(r) for r in got} == brute_join(list(enumerate(texts)))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in {tuple(r) for r in got}}


def test_ngram_join_takes_empty_and_repeated(spark):
    docs = docs_of(spark, ["a b c d e f"])
    assert ngram_join.join(docs.limit(0)).count() == 0
    assert [tuple(r) for r in ngram_join.join(docs.unionAll(docs)).collect()] == [(0, 2, 0)] * 2


def test_ngram_join_keeps_columns_of_any_name(spark):
    docs = docs_of(spark, ["a b c d e f"] * 3 + [None, "z " * 60_000]).withColumns({c: F.lit(5) for c in ("id", "ID_", "__id", "component_id", "n_shingles")})
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == {0, 3, 4} and ngram_join.keep_one(docs).columns == docs.columns


def test_rtree_finds_all():
    g = np.random.default_rng(1)
    sets = [np.unique(g.integers(0, 1 << 62, g.integers(20, 200)).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[3:], s[:1] + np.uint64(1)])) for s in sets[:60]]
    forest = ngram_join.Forest([ngram_join.point(s) for s in sets], [len(s) for s in sets])
    for i, s in enumerate(sets):
        near = set(forest.search(i).tolist())
        assert {j for j, t in enumerate(sets) if ngram_join.linked(s, t)} <= near
        assert len(near) < 20, i


def test_linked_sets_share_a_prefix():
    g = random.Random(4)
    levels = np.zeros(ngram_join.SKETCH, np.uint8)
    for _ in range(300):
        n = g.randint(1, 60)
        a = np.unique(kernel.stream(g.randint(0, 9999), n))
        keep = a[np.array([g.random() < 0.9 for _ in a])]
        b = np.unique(np.concatenate([keep, kernel.stream(g.randint(10000, 20000), g.randint(0, max(1, n // 6)))]))
        if len(b) and ngram_join.linked(a, b):
            assert np.intersect1d(ngram_join.prefix(a, levels), ngram_join.prefix(b, levels)).size


# 6: lines


def brute_lines(docs):
    lines = []
    for i, t in docs:
        for k, raw in enumerate((t or "").split("\n")):
            w = [x for x in re.split(r"[\W_]+", raw.lower()) if x]
            if t and len(w) >= line_dedup.MIN_WORDS:
                lines.append((i, k, tuple(w), simhash(w)))
    kinds = {}
    for i, k, w, s in lines:
        kinds[w] = min(kinds.get(w, (i, k, s)), (i, k, s))
    ws = list(kinds)
    parent = {w: w for w in ws}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ws:
        for b in ws:
            x, y = " ".join(a), " ".join(b)
            if a < b and bin(kinds[a][2] ^ kinds[b][2]).count("1") <= 3 and edits(x, y) <= int(max(len(x), len(y)) * (1 - line_dedup.SIMILARITY) + 1e-9):
                parent[root(a)] = root(b)
    keep = {}
    for w in ws:
        keep[root(w)] = min(keep.get(root(w), kinds[w][:2]), kinds[w][:2])
    gone = defaultdict(set)
    for i, k, w, _ in lines:
        if keep[root(w)] != (i, k):
            gone[i].add(k)
    return {i: sorted(gone[i]) for i, _ in docs}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def simhash(ws):
    import xxhash

    counts = [0] * 60
    ws = {*ws}
    for w in ws:
        h = xxhash.xxh64(w.encode(), seed=42).intdigest()
        for k in range(60):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(60) if 2 * counts[k] > len(ws))


def test_line_dedup(spark):
    g = random.Random(8)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    bases = [[g.choice(vocabulary) for _ in range(g.randint(2, 40))] for _ in range(6)]
    bases.append([g.choice(vocabulary) for _ in range(300)])
    assert (line_dedup.NEAR_BITS, line_dedup.BITS, line_dedup.SIMILARITY) == (3, 60, 0.8)

    def line():
        w = list(g.choice(bases))
        if g.random() < 0.5:
            w[g.randrange(len(w))] = g.choice(vocabulary)
        text = " ".join(w)
        return g.choice([text, text.title(), text + ".", "12 " + text, text.replace(" ", ", ")])

    texts = [None, "", "\n\n", *("\n".join(line() for _ in range(g.randint(1, 5))) for _ in range(25))]
    docs = docs_of(spark, texts).withColumn("h", F.lit(1))
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "removed"]
    got = {r.doc_id: (r.removed, r.text) for r in out.collect()}
    want = brute_lines(list(enumerate(texts)))
    assert {i: r for i, (r, _) in got.items()} == want
    for i, t in enumerate(texts):
        assert got[i][1] == (t if not want[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]))
    assert line_dedup.dedup(docs.limit(0)).count() == 0
    assert line_dedup.dedup(docs.unionAll(docs)).count() == 2 * len(texts)


def test_all_simhashes_within_three_bits_meet(spark):
    g = random.Random(12)
    base = g.getrandbits(60)
    far = [base ^ sum(1 << b for b in g.sample(range(60), 3)) for _ in range(300)]
    rows = spark.createDataFrame([(base, x) for x in far], "a long, b long")
    met = F.arrays_overlap(line_dedup.block_keys(F.col("a")), line_dedup.block_keys(F.col("b"))) & line_dedup._near("a", "b")
    assert rows.where(met).count() == len(far)


def test_short_lines_repeat_exactly(spark):
    han = "".join(chr(0x4E00 + 7 * k % 400) for k in range(150))
    texts = ["Read more\n12\n----\n\nPage 1", " read  MORE\n13\n----\n\nPage 2", "Read, more\n12\n--\n \nPage 1", han, "x\n" + han, han[:149] + "\u8000"]
    got = {r.doc_id: r.removed for r in line_dedup.dedup(docs_of(spark, texts)).collect()}
    assert {i: r for i, r in got.items() if i < 5} == {0: [], 1: [0, 2], 2: [1, 4], 3: [], 4: [1]}
    s = {r.doc_id: r.s for r in line_dedup.line_hashes(docs_of(spark, texts[3:])).where("line = 0").collect()}
    assert s[1] is None and (bin(s[0] ^ s[2]).count("1") <= 3) == (got[5] == [0])


def test_simhash_of_long_lines(spark, monkeypatch):
    g = random.Random(14)
    texts = [" ".join(g.sample([f"w{k}" for k in range(17_000)], n)) for n in (4, 15, 16, 45, 46, 127, 128, 300, 17_000)]
    want = {i: simhash(t.split(" ")) for i, t in enumerate(texts)}
    assert {r.doc_id: r.s for r in line_dedup.line_hashes(docs_of(spark, texts)).collect()} == want
    monkeypatch.setattr(line_dedup, "MOST", 127)
    assert {r.doc_id: r.s for r in line_dedup.line_hashes(docs_of(spark, texts[:-1])).collect()} == {i: want[i] for i in range(8)}


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "one two three four five six"
    docs = docs_of(spark, [line + "\nx y", line + "\nz " + "w " * 60_000, None]).withColumns({c: F.lit(5) for c in ("id", "gone", "removed", "__id", "__gone", "line", "h")})
    out = line_dedup.dedup(docs.unionAll(docs.where("doc_id = 2").withColumn("doc_id", F.lit(1).cast("long"))))
    assert out.columns == [*(c for c in docs.columns if c != "removed"), "removed"]
    got = sorted((r.doc_id, r.text is None, r.removed, r.gone) for r in out.collect())
    assert got == [(0, False, [], 5), (1, False, [0], 5), (1, True, [0], 5), (2, True, [], 5)]


def test_digits_count_in_lines(spark):
    texts = ["Total amount due 12 May", "Total amount due 98 May", "Total Amount Due: 12 May"]
    h = {r.doc_id: r.h for r in line_dedup.line_hashes(docs_of(spark, texts)).collect()}
    assert h[0] == h[2] != h[1]


def test_verified_pairs_are_those_of_the_edit_distance(spark):
    g = random.Random(21)
    some = lambda n: [g.choice(["a", "bb", "ccc", "dddd", "\u00e9\u00e8", "ffffffff"]) for _ in range(n)]
    texts, pairs = [], []
    for _ in range(150):
        w = some(g.randint(4, 30))
        i, v = g.randrange(len(w)), list(w)
        v[i : i + g.randint(0, 4)] = some(g.randint(0, 4))
        if g.random() < 0.5:
            v[g.randrange(len(v) or 1) :][:1] = some(1)
        v = v or some(1)
        if v != w:
            pairs.append((len(texts), len(texts) + 1))
            texts += [" ".join(w), " ".join(v)]
    rows = spark.createDataFrame(list(enumerate(texts)), "h long, norm string")
    got = line_dedup._verified(spark.createDataFrame(pairs, "a long, b long"), rows)
    near = {(a, b) for a, b in pairs if edits(texts[a], texts[b]) <= int(max(len(texts[a]), len(texts[b])) * 0.2 + 1e-9)}
    assert {(r.a, r.b) for r in got.collect()} == near and 0 < len(near) < len(pairs)


def test_lines_are_compared_without_repeated_work(spark):
    """A text is split once, however often its words are used, and words of usual lines are counted in columns."""
    pairs, texts = spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(1, "x y"), (2, "x z")], "h long, norm string")
    plan = line_dedup._verified(pairs, texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 2
    plan = line_dedup.simhash(spark.createDataFrame([(1, [1, 2])], "h long, x array<long>"), ["h"])._jdf.queryExecution().optimizedPlan()
    assert "l0_0" in plan.toString() and "w126" in plan.toString()


def test_line_dedup_is_native(spark):
    plan = line_dedup.line_hashes(docs_of(spark, ["a b c d"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# 7: rules


def brute_rules(t):
    w = words(t)
    n5 = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if n5[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def test_rules(spark):
    texts = some_texts(9, 200, ["a", "b\n", "é", "#", "|", "A\n"], 40) + ["word " * 50_000]
    docs = docs_of(spark, texts).withColumn("kept", F.lit(1))
    got = {r.doc_id: r for r in rules.score(docs).collect()}
    for i, t in enumerate(texts):
        r, b = got[i], brute_rules(t)
        assert tuple(r)[1:6] == b, t
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (r.base_failed and r.kept)
    assert {r.doc_id for r in rules.keep(docs).collect()} == {i for i, r in got.items() if r.kept}
    assert rules.keep(docs).columns == docs.columns and rules.score(docs.limit(0)).count() == 0


def test_order_of_rules_changes_nothing():
    column = pa.array(some_texts(10, 100, ["a", "b\n", "é", "#", "!", "AB", "lower", "x y z"]))
    a, b = (rules.verdicts(column, list(o)) for o in (rules.RULES, reversed(rules.RULES)))
    assert (a["kept"] == b["kept"]).all() and 0 < a["kept"].sum() < len(column)
    for order in (list(rules.ALL), list(reversed(rules.ALL))):
        got = [rules.cascade(rules.Features(c), order) for c in kernel.chunks(column, 500)]
        assert (np.concatenate(got) == a["kept"]).all()


def test_cascade_asks_later_rules_for_documents_left_only(monkeypatch):
    c = next(kernel.chunks(pa.array(["a"] * 9 + ["b c d e f g h i j k l"])))
    seen = []
    monkeypatch.setitem(rules.ALL, "bangs", lambda f: seen.append(f.c.n) or np.zeros(f.c.n, bool))
    assert rules.cascade(rules.Features(c), ["few_words", "bangs"]).tolist() == [False] * 9 + [True] and seen == [1]
    assert rules.cascade(rules.Features(c), ["bangs"], np.zeros(10, bool)).sum() == 0 and seen == [1]


def test_rules_keep_good_and_reject_bad(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    out = rules.score(docs).join(labels, "doc_id").toPandas()
    good = out[(out.quality == 1) & ~out.base_failed]
    assert good.kept.mean() > 0.99 and out[out.quality == 0].kept.mean() < 0.1


# 8: packing


def test_ids_are_those_of_the_tokenizer(tokens):
    from tokenizers import Tokenizer

    tok, ids = Tokenizer.from_str(tokens), packing.Ids(tokens)
    pieces = ["a", "B", " ", "  ", "\n", "\t", "1", "é", "×", "...", "'s", "#", "œ", " \n", "\x00", "\x85", "\u00a0", "日本", "<|endoftext|>", "ß"]
    g = random.Random(1)
    texts = ["", *("".join(g.choice(pieces) for _ in range(g.randint(0, 14))) for _ in range(3000))]
    got = [x for c in kernel.chunks(pa.array(texts)) for x in ids.chunk(c)]
    for t, x in zip(texts, got, strict=True):
        assert x.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_packing(spark, tokens):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokens)
    g = random.Random(2)
    texts = [None, "", *(" ".join(g.choice(["the", "word", "éé", "x1"]) for _ in range(g.choice([3, 50, 200, 900, 3000]))) for _ in range(120))]
    docs = docs_of(spark, texts).withColumn("crcs", F.lit(1))
    rows = packing.pieces(docs, tokens, block_rows=40).collect()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    at, seqs = Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    assert dict(at) == {i: len(x) for i, x in ids.items()}
    total = 0
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 1024
        total += end if end & (end - 1) == 0 else 1024
    assert total <= 1.1 * sum(map(len, ids.values()))
    assert packing.pieces(docs.limit(0), tokens).count() == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.pieces(docs, tokens, block_rows=40).collect()))


def test_pack_takes_anything():
    for lengths in ([], [1], [1023] * 3, [512] * 5, [341, 341, 342] * 4, [700, 300, 24, 1]):
        x = np.array(lengths, np.int64)
        seq, off = packing.pack(x)
        assert sorted(lengths) == sorted(x[k] for s in set(seq.tolist()) for k in np.flatnonzero(seq == s))
        assert all(x[seq == s].sum() <= 1024 for s in set(seq.tolist())) and len(seq) == len(off) == len(x)
    assert len(set(packing.pack(np.array([341, 341, 342] * 4))[0].tolist())) == 4


def test_least_squares_finds_repeat_counts():
    count = np.zeros(1025)
    patterns = packing.combinations(np.isin(np.arange(1025), [100, 924, 300, 724, 341, 342]), 1024)
    assert sorted(map(tuple, patterns.tolist())) == [(342, 341, 341), (724, 300, 0), (924, 100, 0)]
    count[[100, 924, 300, 724, 342]], count[341] = [7, 7, 3, 3, 5], 10
    x = dict(zip(map(tuple, patterns.tolist()), packing.nnls(patterns, count)))
    assert x == pytest.approx({(342, 341, 341): 5, (724, 300, 0): 3, (924, 100, 0): 7}, abs=0.05)


def test_pack_fills_windows():
    g = np.random.default_rng(3)
    lengths = g.integers(1, 1024, 8000)
    seq, off = packing.pack(lengths)
    fill = np.bincount(seq, lengths)
    assert fill.max() <= 1024 and len(fill) <= 1.01 * lengths.sum() / 1024 + 2
    for s in range(50):
        k = np.flatnonzero(seq == s)
        k = k[np.argsort(off[k])]
        assert off[k].tolist() == [0, *np.cumsum(lengths[k])[:-1].tolist()]


# 9: suffixes


def brute_spans(texts, n):
    c = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gaps = []
        for i in range(len(t) - n + 1):
            if c[t[i : i + n]] > 1:
                if gaps and i <= gaps[-1][1]:
                    gaps[-1][1] = i + n
                else:
                    gaps.append([i, i + n])
        out.append(gaps)
    return out


def test_sorted_suffixes():
    g = random.Random(4)
    for k in range(30):
        n = g.randint(1, 500)
        buf = np.array([g.choice(b"ab") for _ in range(n)], np.uint8) if k % 2 else np.frombuffer((b"abcabd" * 100)[:n], np.uint8)
        starts = np.sort(np.array(g.sample(range(n), g.randint(1, n))))
        raw = buf.tobytes()
        got = [raw[i : i + 60] for i in suffix_dedup.sort_suffixes(buf, starts, 60)]
        assert got == sorted(raw[i : i + 60] for i in starts)


def test_cover_has_every_difference():
    assert {(a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.V))


def test_suffix_dedup(spark):
    g = random.Random(5)
    rand = lambda n: "".join(g.choice("abcdefghij é\n") for _ in range(n))
    passages = [rand(n) for n in (380, 399, 400, 401, 700, 2500)]
    texts = [None, "", "x", "ab" * 700, "q" * 399, "q" * 400, "q" * 1000, rand(3000), passages[5], passages[5]]
    texts += [rand(g.randint(0, 300)) + g.choice(passages) + rand(g.randint(0, 300)) + g.choice(["", *passages]) for _ in range(30)]
    docs = docs_of(spark, texts).withColumn("d1", F.lit(1))
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, gaps in enumerate(brute_spans(raw, 400)):
        kept, p = b"", 0
        for a, z in gaps:
            kept, p = kept + raw[i][p:a], z
        kept += raw[i][p:]
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw[i]), len(raw[i]) - len(kept), len(gaps)), i
        assert r.kept == kept and r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0
    twice = suffix_dedup.dedup(docs.where("doc_id = 7").unionAll(docs.where("doc_id = 7"))).collect()
    assert [(r.n_removed, r.n_spans) for r in twice] == [(r.n_bytes, 1) for r in twice]


def _suffix_buckets(spark, monkeypatch, texts):
    """Rows of dedup() against brute force; the largest bucket that a task sorts."""
    sizes, found = [0], suffix_dedup._found

    def spy(kinds, tasks):
        sizes.extend(r["count"] for r in kinds.groupBy("key").count().collect())
        return found(kinds, tasks)

    monkeypatch.setattr(suffix_dedup, "_found", spy)
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs_of(spark, texts)).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, gaps in enumerate(brute_spans(raw, 400)):
        kept = b"".join(raw[i][a:z] for a, z in zip([0, *(g[1] for g in gaps)], [*(g[0] for g in gaps), len(raw[i])], strict=True))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept) == (len(raw[i]), len(raw[i]) - len(kept), len(gaps), kept), i
    return max(sizes)


def test_suffix_dedup_splits_a_large_bucket(spark, monkeypatch):
    g = random.Random(11)
    rand = lambda n: "".join(g.choice("abcdefghij é\n") for _ in range(n))
    passage = rand(450)
    texts = [rand(g.randint(150, 250)) + passage + rand(g.randint(150, 250)) for _ in range(suffix_dedup.BUCKET + 50)]
    assert _suffix_buckets(spark, monkeypatch, texts) <= suffix_dedup.BUCKET


def test_suffix_dedup_splits_buckets_of_periodic_and_edited_texts(spark, monkeypatch):
    g = random.Random(12)
    rand = lambda n: "".join(g.choice("abcdefghij é\n") for _ in range(n))
    monkeypatch.setattr(suffix_dedup, "BUCKET", 3)
    long, unit = rand(1500), rand(70)
    texts = [None, "", rand(399), rand(900), long, long]
    texts += [p * (g.randint(450, 900) // len(p)) + g.choice(["", rand(30)]) for p in ("q", "ab", "abcde", unit) for _ in range(6)]
    for _ in range(12):  # near copies
        k = g.randrange(len(long))
        texts.append(long[:k] + "X" + long[k + 1 :])
    texts += [rand(g.randint(0, 99)) + long[g.randint(0, 300) : g.randint(650, 1200)] + rand(g.randint(0, 99)) for _ in range(12)]
    before, passage, after = rand(400), rand(450), rand(400)
    texts += [rand(50) + before + passage + after + rand(50) for _ in range(2)]  # a context that occurs twice in a bucket that is split
    texts += [rand(300) + passage + rand(300) for _ in range(6)]
    assert _suffix_buckets(spark, monkeypatch, texts) <= 3
    for few in (0, 1000):
        monkeypatch.setattr(suffix_dedup, "FEW", few)
        assert suffix_dedup.dedup(docs_of(spark, texts[:20])).count() == 20


# 10: urls


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1?x", "https://example.org/en/12#a", "https://example.org/en/2", "http://org", "http://x.com/de/1", "http://x.com/fr/", "http://x.com?/de/", "ftp://x.net/a//b://c?d", "http://notorg/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = [(r.host, r.path, r.rule) for r in url_graph.judge(pages.withColumn("host", F.lit(1))).orderBy("page_id").collect()]
    assert got == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"),
        ("org", "", None), ("x.com", "/de/1", "com/de/"), ("x.com", "/fr/", "com/fr/"), ("x.com", "", None), ("x.net", "/a//b://c", None), ("notorg", "/", None),
    ]
    assert url_graph.judge(pages.limit(0)).count() == 0


def test_trust_and_distrust_spread(spark):
    def page(i, url, *links):
        return i, url, "".join(f'<a href="{u}">' for u in links)

    rows = [page(0, "http://good.org/", "http://friend.net/"), page(1, "http://friend.net/", "/home", "//FRIEND.net/x"), page(2, "http://bad.com/de/"), page(3, "http://linker.net/", "http://bad.com/de/", "http://bad.com/"), page(4, "http://far.net/", "http://linker.net")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in url_graph.judge(pages).collect()}
    assert got["friend.net"].verdict == "allow" and got["friend.net"].host_trust > 0
    assert got["linker.net"].verdict == got["far.net"].verdict == got["bad.com"].verdict == "block"
    assert got["linker.net"].host_distrust > got["far.net"].host_distrust > 0


# all


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    more = docs_of(spark, [None, "", "q\nq"], 900_001).select(*docs.columns)
    rows = docs.unionAll(more)
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        before = {r.doc_id: r for r in rows.collect()}
        rows = stage(spark, rows, SF).cache()
        assert rows.columns == docs.columns
        after = {r.doc_id: r for r in rows.collect()}
        assert after.keys() <= before.keys() and len(after) > 100
        if k == 0:
            assert 900_001 not in after and 900_002 not in after
        if k != 1:
            assert all(after[i].text == before[i].text for i in after)
        if k == 2:
            assert {c for _, _, c in brute_join([(i, r.text) for i, r in before.items()])} == after.keys()
    assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, rows, SF).collect()} == after.keys()


def test_stages_take_nulls_and_columns_of_any_name(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    good = "The quiet river runs past the old mill and on to the wide and open sea tonight."
    texts = [None, "", good, good, good + "\n" + "A second line of words that stands here only once, as far as we know.", "word " * 50_000]
    docs = docs_of(spark, texts).withColumns({c: F.lit(5) for c in ("id", "gone", "removed", "n", "spans", "items", "__id", "component_id", "kept")})
    docs = docs.unionAll(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    rows = docs
    for _, stage in pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns
        assert all(r.id == r.gone == r.n == r.spans == r.items == r.removed == r["__id"] == 5 for r in rows.collect())
    assert pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count() > 0


def test_pipeline_takes_an_empty_table(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = docs_of(spark, []).limit(0)
    for _, stage in pipeline.STAGES:
        rows = stage(spark, rows, SF)
    assert rows.count() == 0


def test_queries_and_sql_have_the_contract_columns(spark):
    q = queries.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in q) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(q)
    assert json.loads(queries.tokenizer_json())["model"]["type"] == "BPE"
