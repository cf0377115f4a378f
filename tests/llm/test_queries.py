"""The queries on the smallest tables, and the properties their results must have."""

import base64
import os
from collections import Counter

import duckdb
import pytest

from cuewright.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
COLUMNS = {
    "p1_found": ["item_kind", "media_id", "seg_idx"],
    "p3_found": ["item_kind", "item_key", "seg_idx", "lang"],
    "p4_found": ["media_id", "first_seg_idx", "last_seg_idx"],
    "p5_found": ["media_id", "seg_idx", "speaker_id"],
    "p6_ids": ["doc_id", "ids"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "reading_level"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW \"{name.removesuffix('.parquet')}\" AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_with_its_columns(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        if name != "p6_ids":
            assert max(Counter(rows).values(), default=0) <= (2 if name == "p5_found" else 1)
    if name in ORACLE:
        assert sorted(rows) == sorted(duck.sql(ORACLE[name]).fetchall())


def test_ids_are_those_of_the_public_tokenizer(spark):
    public, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    exact = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    ids = {r.doc_id: r.ids for r in QUERIES["p6_ids"](spark, FOLDER).collect()}
    assert ids == {k: exact.encode_ordinary(t or "") for k, t in texts.items()}


def test_pieces_are_within_limits_and_whole(spark):
    pieces = QUERIES["p1_pieces"](spark, FOLDER).collect()
    limits = {"segment": (400, 60), "transcript": (6000, 300)}
    assert all(len(p.text) <= limits[p.item_kind][0] for p in pieces)
    by = {}
    for p in sorted(pieces, key=lambda p: p.piece):
        by.setdefault((p.item_kind, p.media_id, p.seg_idx), []).append(p)
    for (kind, *_), own in by.items():
        assert [p.piece for p in own] == list(range(own[0].n_pieces))
        assert all(a.text[-limits[kind][1] :] == b.text[: limits[kind][1]] for a, b in zip(own, own[1:]))


def test_runs_cover_every_segment_once(spark):
    events = QUERIES["p4_runs"](spark, FOLDER).collect()
    spans = {}
    for e in events:
        spans.setdefault(e.media_id, []).append((e.first_seg_idx, e.last_seg_idx))
    for own in spans.values():
        own.sort()
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
