"""Encoding against the tokenizer's own library, and exact round trips."""

import base64
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
sys.path.insert(0, "/opt")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def both():
    with open(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tokens.Encoder(), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(both, texts):
    ids, to, _ = both[0].encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[to[i] : to[i + 1]].tolist() == (both[1].encode_ordinary(t) if t else []), t


def test_boundaries_of_every_kind(both):
    same(both, ["", None, " ", "a", "  a", "a  ", "a \n b", "\n\n", "don't", "we'll've'd", "'s's'x ''s \"'s", " 's", "\t's", "a b  c", "x²³ 12a ٣", "naïve—“q”", "🙂🙂 ok", "é", "<|endoftext|>"])


def test_random_texts_near_block_edges(both):
    rng = random.Random(2)
    alphabet = list("  \t\n\r'strevmdll'aé1²٣!-—中😀  ́_�")
    same(both, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=60), max_size=6))
def test_any_text(both, texts):
    same(both, texts)


def test_very_long_slices(both):
    same(both, ["a" * 20000, " " * 5000 + "x", "├─" * 4000, "don't " * 9000, "中" * 3000])


def test_scan_without_a_common_state():
    # blocks that never forget where they began go through the scan of functions
    f = np.array([[1, 0, 2], [0, 1, 2], [2, 2, 2], [1, 0, 2]])
    want, s = [], 0
    for row in f:
        want.append(s)
        s = row[s]
    assert tokens._scan(f).tolist() == want


def test_frame_round_trip_and_offsets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.join(tokens.encode(docs, offsets=True), "doc_id").select("text", "ids", "starts").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tokens.decode(r.ids) == (r.text or "") and len(r.starts) == len(r.ids)
        raw = (r.text or "").encode()
        for k in range(0, len(r.ids), 97):
            piece = tokens.decode_bytes([r.ids[k]])
            assert raw.find(piece, r.starts[k]) >= 0


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, "clash"), (2, "", "c"), (3, "x", None), (3, "x", None)], "doc_id bigint, text string, ids string")
    assert sorted((r.doc_id, r.ids) for r in tokens.encode(df).collect()) == [(1, []), (2, []), (3, [87]), (3, [87])]
    assert tokens.encode(df.limit(0)).count() == 0
    assert {(r.doc_id, r.tokens) for r in tokens.lengths(df).collect()} == {(1, 0), (2, 0), (3, 1)}
