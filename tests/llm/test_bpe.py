import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from dupscan.llm import bpe, q_bpe

PATH = P.path(q_bpe.RANKS)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf_chars,leaf_bytes", [(3, 4), (7, 8), (50, 48), (512, 8), (1 << 15, 1)])
def test_tree_equals_library(reference, monkeypatch, leaf_chars, leaf_bytes):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf_chars)
    monkeypatch.setattr(bpe, "LEAF_BYTES", leaf_bytes)
    coder, rng = bpe.load(PATH, P.PATTERN), random.Random(leaf_chars)
    coder.memory.clear()
    for alphabet in ("ab", "a \n", "ab' st", "é1 a.\t", "aaaaab", "the of and ", "日本 語🙂‍　"):
        for n in (0, 1, 2, 9, 100, 700):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert coder.encode(text) == reference.encode_ordinary(text)
            assert coder.decode(coder.encode(text)).decode() == text


@pytest.mark.parametrize("leaf_chars", [3, 5, 8, 13])
def test_seams_in_contractions(reference, monkeypatch, leaf_chars):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf_chars)
    coder, rng = bpe.load(PATH, P.PATTERN), random.Random(leaf_chars)
    for alphabet in ("'lrev", "we'l ", "'LlvE r", "d's1 \n'm"):
        for n in (4, 7, 20, 60, 300) * 20:
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert coder.pieces(text) == coder.split.findall(text)
            assert coder.encode(text) == reference.encode_ordinary(text)
    text = "we'll go "
    assert all(coder.pieces("x" * k + text) == coder.split.findall("x" * k + text) for k in range(40))


def test_the_tree_runs_on_ordinary_texts(reference, monkeypatch):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    coder = bpe.load(PATH, P.PATTERN)
    coder.memory.clear()
    want = [reference.encode_ordinary(t or "") for t in texts]
    assert [coder.encode(t) for t in texts] == want
    assert [coder.decode(x) for x in want] == [(t or "").encode() for t in texts]
    # without the join of neighbours most texts come out wrong
    monkeypatch.setattr(bpe.ByteBPE, "_join", lambda self, left, right: left + right)
    coder.memory.clear()
    wrong = sum(coder.encode(t) != x for t, x in zip(texts, want, strict=True))
    coder.memory.clear()
    assert wrong > 0.9 * len(texts)


def test_query_and_edge_rows(spark, reference):
    texts = [None, "", " ", "<|endoftext|> x", "a" * 70000, "word " * 9000, "same", "same"]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, decoded int")
    got = {r.doc_id: r for r in q_bpe.digests(df, "doc_id").collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert set(back.columns) == {"doc_id", "text", "ids", "decoded"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert q_bpe.digests(df, "doc_id").collect() == []
