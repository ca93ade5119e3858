"""The registered queries themselves: against their SQL, or against what the contract says of every row."""

import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from stackloom.llm import packing, queries

SF = "/root/testdata/sf0.001"


def tables():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def as_text(value):
    return f"{value:.9g}" if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    cursor = tables().execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(as_text(r[n]) for n in names) for r in df.collect())
    assert got == sorted(tuple(map(as_text, r)) for r in cursor.fetchall())


@pytest.mark.parametrize("name,cutoff", [("op1_toxicity", 0.5), ("op4_quality_classifier", 0.3)])
def test_scores_of_every_document(spark, name, cutoff):
    rows = queries.queries()[name](spark, SF).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cutoff)


def test_pieces_of_every_document(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(queries.tokenizer_json())
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in queries.op8_packing(spark, SF).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for parts, whole in ((pieces, {k: len(v) for k, v in ids.items()}), (places, None)):
        for key, spans in parts.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == whole[key] if whole else at <= packing.WINDOW
    assert pieces.keys() == ids.keys()


def test_removed_lines_of_every_document(spark):
    """Every document has a row, and what it says to have removed are lines that it has."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op6_line_dedup(spark, SF).collect()}
    assert rows.keys() == docs.keys() and all(r.n_removed == len(r.removed) for r in rows.values())
    assert any(r.n_removed for r in rows.values())
    assert all(len(docs[i].split("\n")) >= r.n_removed for i, r in rows.items())
