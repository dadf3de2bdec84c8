import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorloom.llm import bpe
from sensorloom.llm.catalog import BPE, op2_bpe
from tests.llm.helpers import AWKWARD, SF, awkward

with open(BPE[0], "rb") as file:
    VOCABULARY = file.read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.splitlines())}
TRUTH = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def same(texts):
    tool = bpe.codec(VOCABULARY, BPE[1])
    for text, ids in zip(texts, tool.encode_batch(texts), strict=True):
        assert ids == TRUTH.encode_ordinary(text)
        assert tool.decode(ids) == text.encode()


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(), max_size=8))
def test_any_text(texts):
    same(texts)


def test_long_runs_and_ties():
    pick = random.Random(3).choice
    same(["", "a" * 5000, "ab" * 4000, "abc" * 3000 + "aab" * 999, " " * 3000, "é" * 1500, "日本語" * 700, "!?" * 900, "<|endoftext|>"])
    same(["".join(pick("thein") for _ in range(n)) for n in range(500, 1100, 7)])


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    same(["one two three four", "five six one", "two"])


def test_awkward_documents(spark):
    for frame in (bpe.encode(awkward(spark), *BPE), awkward(spark, [])):
        frame.collect()
    got = {(r.doc_id, tuple(r.ids)) for r in bpe.encode(awkward(spark), *BPE).collect()}
    assert got == {(d, tuple(TRUTH.encode_ordinary(t or ""))) for d, t, _ in AWKWARD}
    assert bpe.encode(awkward(spark), *BPE).count() == len(AWKWARD)
    assert bpe.encode(awkward(spark, []), *BPE).collect() == []
    back = bpe.decode(bpe.encode(awkward(spark), *BPE), BPE[0])
    assert {(r.doc_id, bytes(r.content)) for r in back.collect()} == {(d, (t or "").encode()) for d, t, _ in AWKWARD}


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op2_bpe(spark, SF).collect():
        ids = TRUTH.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_unknown_id_fails():
    with pytest.raises(IndexError):
        bpe.codec(VOCABULARY, BPE[1]).decode([10**6])
